"""Joins on keys that may be null, and broadcasts behind a check of size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that may be sent to every executor.
BROADCAST_ROWS = 100_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys are those of ``left``."""
    if not keys:
        raise ValueError("no keys")
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_k_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is: the join shuffles.

    Counts ``df`` up to the limit, so give it a written or checkpointed table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
