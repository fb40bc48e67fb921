"""Seeded balancing, shuffles, splits and pool subsets.

Every sampler orders rows by the md5 of "id-seed", so the result does not depend on
how rows are spread over partitions. The first hex digits of that md5 cut each class
into even buckets; whole buckets are taken or left by their counts alone and only the
one bucket at the border is ranked, so no row outside it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halflight.operators.keys import broadcast_if_small, join_null_safe
from halflight.session import cut_lineage

BUCKET_DIGITS = 3


def hash_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"-{seed}")))


def _bucketed(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    return df.withColumn("_h", hash_key(row_id, seed)).withColumn(
        "_b", F.substring("_h", 1, BUCKET_DIGITS)
    )


def _bucket_offsets(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each bucket, per key: at most 16^digits rows per class."""
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def with_hash_rank(
    df: DataFrame, row_id: str, seed: int = 42, keys: list[str] | None = None, name: str = "rank"
) -> DataFrame:
    """1-based position of every row in seeded order, within each key."""
    keys = keys or []
    marked = _bucketed(df, row_id, seed)
    offsets = _bucket_offsets(marked, keys).drop("_n")
    inside = W.partitionBy(*keys, "_b").orderBy("_h", row_id)
    offsets = broadcast_if_small(cut_lineage(offsets))
    return (
        join_null_safe(marked.withColumn("_r", F.row_number().over(inside)), offsets, [*keys, "_b"])
        .withColumn(name, F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def mark_first(
    df: DataFrame,
    row_id: str,
    quota: Column,
    seed: int = 42,
    keys: list[str] | None = None,
    name: str = "taken",
) -> DataFrame:
    """Flag the first ``quota`` rows of each key in seeded order; a null key is a key of its own.

    ``quota`` may use the key columns and ``_total``, the number of rows of the key.
    """
    keys = keys or []
    marked = _bucketed(df, row_id, seed)
    offsets = _bucket_offsets(marked, keys)
    offsets = offsets.withColumn("_total", F.sum("_n").over(W.partitionBy(*keys)))
    offsets = offsets.select(
        *keys, "_b", "_n", "_before", F.greatest(quota, F.lit(0)).cast("long").alias("_quota")
    )
    # counted once for both branches below; 16^digits rows per class at most, and any number of classes
    offsets = broadcast_if_small(cut_lineage(offsets))
    placed = join_null_safe(marked, offsets, [*keys, "_b"])
    whole = placed.filter(
        (F.col("_before") + F.col("_n") <= F.col("_quota")) | (F.col("_before") >= F.col("_quota"))
    ).withColumn(name, F.col("_before") < F.col("_quota"))
    inside = W.partitionBy(*keys, "_b").orderBy("_h", row_id)
    border = (
        placed.filter(
            (F.col("_before") < F.col("_quota"))
            & (F.col("_before") + F.col("_n") > F.col("_quota"))
        )
        .withColumn("_r", F.row_number().over(inside))
        .withColumn(name, F.col("_before") + F.col("_r") <= F.col("_quota"))
        .drop("_r")
    )
    return whole.unionByName(border).drop("_h", "_b", "_n", "_before", "_quota")


def take_first(df, row_id, quota, seed=42, keys=None) -> DataFrame:
    return mark_first(df, row_id, quota, seed, keys, "_taken").filter("_taken").drop("_taken")


def _class_counts(df: DataFrame, target: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).first()
    return row[0], row[1]


def downsample_majority(df: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """Both classes cut to the size of the smaller one, without replacement."""
    return take_first(df, row_id, F.lit(min(_class_counts(df, target))), seed, [target])


def ratio_balance(
    df: DataFrame,
    target: str,
    row_id: str,
    share_positive: float = 0.6,
    share_negative: float = 0.4,
    seed: int = 42,
) -> DataFrame:
    """Smaller class kept whole, the other cut to the ratio (truncated, capped by its size)."""
    n0, n1 = _class_counts(df, target)
    if n1 < n0:
        keep0, keep1 = min(int(n1 * (share_negative / share_positive)), n0), n1
    else:
        keep0, keep1 = n0, min(int(n0 * (share_positive / share_negative)), n1)
    quota = F.when(F.col(target) == 1, keep1).otherwise(keep0)
    return take_first(df.filter(F.col(target).isin(0, 1)), row_id, quota, seed, [target])


def shuffle_order(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Seeded order kept as a column, because a table has none of its own."""
    return with_hash_rank(df, row_id, seed, name="position")


def stratified_split(
    df: DataFrame, target: str, row_id: str, test_share: float = 0.3, seed: int = 42
) -> DataFrame:
    """``split`` is 'test' for floor(share·n + 0.5) rows of each class, else 'train'."""
    quota = F.floor(F.lit(test_share) * F.col("_total") + F.lit(0.5))
    marked = mark_first(df, row_id, quota, seed, [target], "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop(
        "_test"
    )


def train_val_test_split(
    df: DataFrame, target: str, row_id: str, test_share: float = 0.2, val_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Test rows first, then validation rows out of the remaining training rows."""
    first = stratified_split(df, target, row_id, test_share, seed)
    rest = stratified_split(
        first.filter("split = 'train'").drop("split"), target, row_id, val_share, seed + 1
    ).withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return first.filter("split = 'test'").unionByName(rest)


def random_subset(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    return take_first(df, row_id, F.lit(n), seed)


def stratified_folds(
    df: DataFrame, target: str, row_id: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    ranked = with_hash_rank(df, row_id, seed, [target], "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def usable_folds(df: DataFrame, target: str) -> DataFrame:
    """Folds in which both the held-out part and the rest have two classes."""
    per_fold = df.groupBy("fold").agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )
    totals = per_fold.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    ok = (
        (F.col("pos") > 0) & (F.col("neg") > 0)
        & (F.lit(totals["pos"]) > F.col("pos")) & (F.lit(totals["neg"]) > F.col("neg"))
    )
    return per_fold.withColumn("usable", ok)


def prefix_subset(df: DataFrame, position: str, n: int) -> DataFrame:
    """First n rows by a stored 1-based position; all rows when the pool is smaller."""
    return df.filter(F.col(position) <= n)


def stack_rows(labelled: DataFrame, pool: DataFrame, target: str = "label") -> DataFrame:
    return labelled.unionByName(pool.withColumn(target, F.lit(None).cast("int")))


def pool_minus_selected(pool: DataFrame, selected: DataFrame, row_id: str) -> DataFrame:
    return pool.join(selected.select(row_id), row_id, "left_anti")


def pool_selected(pool: DataFrame, selected: DataFrame, row_id: str) -> DataFrame:
    return pool.join(selected.select(row_id), row_id, "left_semi")


def same_split_check(first: DataFrame, second: DataFrame, row_id: str) -> DataFrame:
    """Rows of each side and how many differ in split or are missing on one side."""
    both = first.select(row_id, F.col("split").alias("_a")).join(
        second.select(row_id, F.col("split").alias("_b")), row_id, "full_outer"
    )
    return both.agg(
        F.count("_a").alias("n_first"),
        F.count("_b").alias("n_second"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"),
    )
