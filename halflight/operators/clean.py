"""Row and column cleaning: selection, missing values, clipping, scaling, filters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halflight.functions.scoring import (
    any_positive,
    fill_constant,
    finite_or_null,
    is_finite,
    nan_to_null,
)
from halflight.operators.profile import correlation_pairs
from halflight.operators.quantiles import exact_quantiles


# --- columns -------------------------------------------------------------------------------


def select_features(df: DataFrame, exclude: list[str]) -> DataFrame:
    """All columns except identifiers and targets."""
    return df.select([c for c in df.columns if c not in set(exclude)])


def feature_intersection(df: DataFrame, canonical: list[str]) -> tuple[DataFrame, list[str]]:
    """Available features in canonical order, and the names that are missing."""
    have = set(df.columns)
    missing = [c for c in canonical if c not in have]
    return df.select([c for c in canonical if c in have]), missing


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude or [])
    ]


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per column name with the side(s) that have it."""
    spark = left.sparkSession
    names = T.StructType([T.StructField("column", T.StringType(), False)])
    a = spark.createDataFrame([(c,) for c in left.columns], names)
    b = spark.createDataFrame([(c,) for c in right.columns], names)
    return (
        a.intersect(b).withColumn("side", F.lit("common"))
        .unionByName(a.exceptAll(b).withColumn("side", F.lit("left")))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )


def feature_views(
    available: list[str], first: list[str], second: list[str], min_size: int = 3
) -> tuple[list[str], list[str]]:
    """Two column groups; halves of the list when either group is too small."""
    one = [c for c in first if c in available]
    two = [c for c in second if c in available]
    if min(len(one), len(two)) >= min_size:
        return one, two
    middle = len(available) // 2
    return available[:middle], available[middle:]


# --- rows ----------------------------------------------------------------------------------


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def finite_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose features are all finite; the target stays on the same row."""
    keep = F.lit(True)
    for c in features:
        keep = keep & is_finite(F.col(c))
    return df.filter(keep)


def finite_report(df: DataFrame, features: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c in features:
        keep = keep & is_finite(F.col(c))
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_kept"),
        F.count_if(~keep).alias("rows_removed"),
    )


def null_target(df: DataFrame, name: str = "label") -> DataFrame:
    return df.withColumn(name, F.lit(None).cast("int"))


def any_positive_label(df: DataFrame, assays: list[str], name: str = "label") -> DataFrame:
    """1 when any assay is positive; rows with every assay missing are dropped."""
    labelled = df.withColumn(name, any_positive(*[F.col(c) for c in assays]))
    return labelled.filter(F.col(name).isNotNull()).drop(*assays)


def validate_input(df: DataFrame, text: str, message: str = "input cannot be empty") -> DataFrame:
    """Trimmed text plus an ``error`` column that is NULL for good rows."""
    trimmed = F.trim(F.col(text))
    return df.withColumn(text, trimmed).withColumn(
        "error", F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, message)
    )


def split_valid_invalid(
    df: DataFrame, key: str, text: str, valid: Column, message: str
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and one error row (key, input, message) for each bad one."""
    flagged = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    good = flagged.filter("_ok").drop("_ok")
    bad = flagged.filter(~F.col("_ok")).select(
        F.col(key), F.col(text).alias("input"), F.lit(message).alias("error")
    )
    return good, bad


def dedupe_by_key(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """First row per key. The row limit is applied in each input partition before the
    shuffle (WindowGroupLimit), so a hot key sends one row per partition."""
    first = W.partitionBy(key).orderBy(row_id)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def dedupe_report(df: DataFrame, key: str) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.sum("n") - F.count(F.lit(1))).alias("rows_removed"),
    )


def attach(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns of two tables side by side, matched on the row id."""
    return left.join(right, row_id, "inner")


# --- missing values ------------------------------------------------------------------------


def inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in cols})


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing and infinite values replaced by the column's exact median."""
    clean = inf_to_null(df, cols)
    medians = exact_quantiles(clean, cols, [0.5])
    fill = {c: medians[c][0] for c in cols if medians[c][0] is not None}
    return clean.na.fill(fill) if fill else clean


def fill_table(df: DataFrame, cols: list[str], value: float) -> DataFrame:
    return df.withColumns({c: fill_constant(F.col(c), value) for c in cols})


# --- clipping and scaling ------------------------------------------------------------------


class Clipped(NamedTuple):
    table: DataFrame
    outliers: DataFrame  # one row: outlier_count


def _stats_row(df: DataFrame, cols: list[str], aggs: dict) -> dict[str, Column]:
    """All statistics of all columns in one aggregate; its one row becomes literals.

    Literals keep the plans of composed steps small: a step that embeds the plan of the
    step before once per column grows without bound.
    """
    row = df.agg(
        *[fn(nan_to_null(F.col(c).cast("double"))).alias(f"{name}_{i}")
          for i, c in enumerate(cols) for name, fn in aggs.items()]
    ).first()
    return {k: F.lit(v).cast("double") for k, v in row.asDict().items()}


def clip_outliers(
    df: DataFrame, cols: list[str], k: float = 3.0, fit_on: DataFrame | None = None
) -> Clipped:
    """Values moved to mean ± k sample deviations; columns with infinities stay as they are."""
    stats = _stats_row(
        fit_on if fit_on is not None else df, cols, {"m": F.avg, "s": F.stddev_samp}
    )
    clipped, hits = {}, []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        m, s = stats[f"m_{i}"], stats[f"s_{i}"]
        lo = finite_or_null(m - F.lit(float(k)) * s)
        hi = finite_or_null(m + F.lit(float(k)) * s)
        clipped[c] = F.when(F.isnan(x) | x.isNull() | lo.isNull(), x).otherwise(
            F.least(F.greatest(x, lo), hi)
        )
        hits.append(F.count_if(~F.isnan(x) & ((x < lo) | (x > hi))))
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return Clipped(df.withColumns(clipped), df.agg(total.alias("outlier_count")))


def apply_stats(df: DataFrame, fit_on: DataFrame, cols: list[str]) -> DataFrame:
    """Every value beside its column's mean and deviation from another table."""
    stats = _stats_row(fit_on, cols, {"m": F.avg, "s": F.stddev_samp})
    return df.withColumns(
        {f"{c}_dev": (F.col(c) - stats[f"m_{i}"]) / stats[f"s_{i}"]
         for i, c in enumerate(cols)}
    )


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x − mean) / population deviation, with deviation 0 read as 1."""
    stats = _stats_row(
        fit_on if fit_on is not None else df, cols, {"m": F.avg, "s": F.stddev_pop}
    )
    scaled = {}
    for i, c in enumerate(cols):
        m, s = stats[f"m_{i}"], stats[f"s_{i}"]
        scaled[c] = (F.col(c) - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return df.withColumns(scaled)


# --- feature filters -----------------------------------------------------------------------


def variance_filter(df: DataFrame, cols: list[str], threshold: float = 0.01) -> list[str]:
    """Columns whose population variance is above the threshold."""
    row = df.agg(
        *[F.var_pop(finite_or_null(F.col(c).cast("double"))).alias(f"v{i}")
          for i, c in enumerate(cols)]
    ).first()
    return [c for i, c in enumerate(cols) if row[f"v{i}"] is not None and row[f"v{i}"] > threshold]


def correlation_filter(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """Columns left after dropping the later one of each pair with |r| above the threshold.

    A dropped column still removes later ones: the pair table is read as it stands.
    """
    pairs = correlation_pairs(df, cols)
    dropped = {
        r["feature_2"]
        for r in pairs.filter(F.abs("r") > threshold).select("feature_2").distinct().collect()
    }
    return [c for c in cols if c not in dropped]


def preprocess_descriptors(
    df: DataFrame, cols: list[str], variance: float = 0.01, correlation: float = 0.95
) -> tuple[DataFrame, list[str]]:
    """Variance filter, correlation filter on raw values, median impute, scale."""
    varied = variance_filter(df, cols, variance)
    kept = correlation_filter(df, varied, correlation)
    other = [c for c in df.columns if c not in cols]
    return standard_scale(median_impute(df.select(*other, *kept), kept), kept), kept
