"""Ranks and running totals over a whole table without a single-task window.

A window with no partition key moves every row into one task. Here rows are range
partitioned first, so a tied or hot key spreads over blocks, and each block only
needs the total of the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halflight.operators.keys import broadcast_if_small, join_null_safe
from halflight.session import cut_lineage

BLOCK_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def ordered_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range blocks: ``_block`` numbers the block, ``_pos`` the row inside it."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return (
        cut_lineage(placed)
        .withColumn("_block", F.shiftright("_at", BLOCK_BITS))
        .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)))
        .drop("_at")
    )


def _offsets(blocks: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Total of all earlier blocks, one row per (key, block): at most keys + blocks rows."""
    per_block = blocks.groupBy(*keys, "_block").agg(*[c.alias(n) for n, c in totals.items()])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return per_block.select(
        *keys, "_block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank of every row in the given total order."""
    blocks = ordered_blocks(df, order)
    offsets = _offsets(blocks, [], {"_before": F.count(F.lit(1))})
    return (
        blocks.join(broadcast_if_small(cut_lineage(offsets)), "_block")
        .withColumn(name, F.col("_before") + F.col("_pos") + F.lit(1))
        .drop("_block", "_pos", "_before")
    )


def with_running_sums(
    df: DataFrame, order: list[Column], sums: dict[str, str], keys: list[str] | None = None
) -> DataFrame:
    """Inclusive running sums (new name -> source column) in the given order, per key.

    The order must be total within a key. Feed it pre-aggregated rows: one per distinct value.
    A null key is a key of its own.
    """
    keys = keys or []
    blocks = ordered_blocks(df, [F.col(k) for k in keys] + order)
    offsets = _offsets(blocks, keys, {f"_o_{n}": F.sum(s) for n, s in sums.items()})
    upto = (
        W.partitionBy(*keys, "_block")
        .orderBy("_pos")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = blocks.select(
        "*", *[F.sum(s).over(upto).alias(f"_l_{n}") for n, s in sums.items()]
    )
    joined = join_null_safe(local, broadcast_if_small(cut_lineage(offsets)), [*keys, "_block"])
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_l_{n}") + F.col(f"_o_{n}"))
    drop = [f"_l_{n}" for n in sums] + [f"_o_{n}" for n in sums]
    return joined.drop("_block", "_pos", *drop)
