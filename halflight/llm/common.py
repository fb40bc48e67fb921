"""Small helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.session import scratch_path


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def null_safe_key(col: str | Column) -> Column:
    """A string that is equal where the values are equal or both null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def computed_once(value: Column) -> Column:
    """``value``, kept out of the filters above it.

    Catalyst moves a filter on a column below the projection that computes it, and so computes it
    twice, with all that it is computed from written out at each place. It leaves expressions alone
    that depend on the row's place, as this one seems to; the condition is always true.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read from there: columns of arrays take far
    less room than in a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
