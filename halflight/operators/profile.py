"""Profiles of tables: summaries, class shares, correlations, distribution tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.functions.scoring import nan_to_null
from halflight.operators.keys import join_null_safe
from halflight.operators.ordering import with_running_sums
from halflight.operators.quantiles import exact_quantiles

NARROW = 8  # up to this many columns one aggregate with every pair is cheapest


def _as_double(c: str) -> Column:
    return nan_to_null(F.col(c).cast("double"))


def unpivot(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """Long form (ids, feature, value); NULL and NaN are left out."""
    entry = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), _as_double(c).alias("value")) for c in cols])
    )
    return (
        df.select(*(ids or []), entry.alias("_e"))
        .select(*(ids or []), "_e.feature", "_e.value")
        .filter(F.col("value").isNotNull())
    )


def _spread(row_df: DataFrame, cols: list[str], fields: list[str], extra=None) -> DataFrame:
    """One wide statistics row (field_i columns) turned into one row per feature."""
    extra = extra or {}
    items = [
        F.struct(
            F.lit(c).alias("feature"),
            *[F.col(f"{f}_{i}").alias(f) for f in fields],
            *[F.lit(values[c]).cast("double").alias(f) for f, values in extra.items()],
        )
        for i, c in enumerate(cols)
    ]
    return row_df.select(F.explode(F.array(*items)).alias("_e")).select("_e.*")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of every column."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = _as_double(c)
        aggs += [
            F.count(x).alias(f"count_{i}"),
            F.avg(x).alias(f"mean_{i}"),
            F.stddev_samp(x).alias(f"std_{i}"),
            F.min(x).alias(f"min_{i}"),
            F.max(x).alias(f"max_{i}"),
        ]
    extra = {f"q{int(p * 100)}": {c: quartiles[c][j] for c in cols}
             for j, p in enumerate([0.25, 0.5, 0.75])}
    return _spread(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"], extra)


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values per column, only columns that have any, most first."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        gone = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            gone = gone | F.isnan(F.col(c))
        aggs.append(F.count_if(gone).alias(f"m{i}"))
    items = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"m{i}").alias("missing"),
            (F.col(f"m{i}") * 100.0 / F.nullif(F.col("n"), F.lit(0))).alias("missing_pct"),
        )
        for i, c in enumerate(cols)
    ]
    return (
        df.agg(*aggs)
        .select(F.explode(F.array(*items)).alias("_e"))
        .select("_e.*")
        .filter("missing > 0")
        .orderBy(F.desc("missing"), "feature")
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.withColumn("share", F.col("n") / F.lit(total))


def crosstab(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two-way counts with both margins; a margin row has NULL in the summed-out column."""
    return df.cube(first, second).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")
    )


def imbalance_status(df: DataFrame, target: str, limit: float = 0.3) -> DataFrame:
    n0, n1 = F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)
    gap = F.abs(n0 - n1) / F.nullif(n0 + n1, F.lit(0))
    return df.agg(n0.alias("n0"), n1.alias("n1"), gap.alias("imbalance")).withColumn(
        "status", F.when(F.col("imbalance") > limit, "IMBALANCED").otherwise("BALANCED")
    )


# --- correlation ---------------------------------------------------------------------------


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r of every column pair in position order, over rows where both are present."""
    if len(cols) <= NARROW:
        return _narrow_pairs(df, cols)
    return _wide_pairs(df, cols)


def _narrow_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.agg(
        *[F.corr(_as_double(cols[i]), _as_double(cols[j])).alias(f"r_{i}_{j}") for i, j in pairs]
    )
    items = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"),
            F.lit(cols[i]).alias("feature_1"), F.lit(cols[j]).alias("feature_2"),
            nan_to_null(F.col(f"r_{i}_{j}")).alias("r"),
        )
        for i, j in pairs
    ]
    return row.select(F.explode(F.array(*items)).alias("_e")).select("_e.*")


def _wide_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per-partition matrix products of centred values, summed per pair."""
    width = len(cols)
    centre = df.agg(*[F.avg(_as_double(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([0.0 if v is None else v for v in centre])
    upper = np.triu_indices(width, 1)

    def moments(batches):
        total = np.zeros((6, width, width))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            seen = ~np.isnan(x)
            x = np.where(seen, x - shift, 0.0)
            m = seen.astype(float)
            x2 = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, x2.T @ m, m.T @ x2, x.T @ x])
        flat = total[:, upper[0], upper[1]]
        yield pd.DataFrame(
            {"i": upper[0], "j": upper[1],
             **{name: flat[k] for k, name in enumerate(["n", "sx", "sy", "sxx", "syy", "sxy"])}}
        )

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = df.select([_as_double(c).alias(f"c{i}") for i, c in enumerate(cols)])
    sums = (
        parts.mapInPandas(moments, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(
        "i", "j",
        F.element_at(names, F.col("i") + 1).alias("feature_1"),
        F.element_at(names, F.col("j") + 1).alias("feature_2"),
        F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("r"),
    )


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Full matrix in long form, diagonal included."""
    pairs = correlation_pairs(df, cols).select("feature_1", "feature_2", "r")
    flipped = pairs.select(
        F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "r"
    )
    diagonal = df.agg(
        *[F.corr(_as_double(c), _as_double(c)).alias(f"r_{i}") for i, c in enumerate(cols)]
    )
    items = [
        F.struct(F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"),
                 nan_to_null(F.col(f"r_{i}")).alias("r"))
        for i, c in enumerate(cols)
    ]
    diagonal = diagonal.select(F.explode(F.array(*items)).alias("_e")).select("_e.*")
    return pairs.unionByName(flipped).unionByName(diagonal)


def target_correlation(df: DataFrame, features: list[str], target: str, top: int = 15) -> DataFrame:
    """Features by correlation with the target, largest first."""
    row = df.agg(
        *[F.corr(_as_double(c), _as_double(target)).alias(f"r_{i}")
          for i, c in enumerate(features)]
    )
    return (
        _spread(row, features, ["r"])
        .withColumn("r", nan_to_null(F.col("r")))
        .filter("r is not null")
        .orderBy(F.desc("r"), "feature")
        .limit(top)
    )


def high_corr_pairs(
    df: DataFrame, cols: list[str], threshold: float = 0.5, top: int = 20
) -> DataFrame:
    return (
        correlation_pairs(df, cols)
        .filter(F.abs("r") > threshold)
        .orderBy(F.desc(F.abs("r")), "i", "j")
        .limit(top)
        .drop("i", "j")
    )


# --- groups and populations ----------------------------------------------------------------


def group_profile(df: DataFrame, target: str, cols: list[str], flag: Column) -> DataFrame:
    return df.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(_as_double(c)).alias(f"mean_{c}") for c in cols],
        F.avg(flag.cast("double")).alias("compliant_share"),
    )


def compliance_rate(df: DataFrame, source: str, flag: Column) -> DataFrame:
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flag).alias("compliant"),
        (F.avg(flag.cast("double")) * 100).alias("compliant_pct"),
    )


def dataset_comparison(
    labelled: DataFrame, pool: DataFrame, features: list[str], flag: Column
) -> DataFrame:
    """Metric × {labelled, unlabelled}."""

    def measures(df: DataFrame, name: str) -> DataFrame:
        gone = [F.count_if(_as_double(c).isNull()) for c in features]
        missing = gone[0]
        for g in gone[1:]:
            missing = missing + g
        row = df.agg(
            F.count(F.lit(1)).cast("double").alias("rows"),
            F.lit(float(len(features))).alias("features"),
            missing.cast("double").alias("missing_values"),
            (F.avg(flag.cast("double")) * 100).alias("compliant_pct"),
            *[F.avg(_as_double(c)).alias(f"mean_{c}") for c in features],
        )
        items = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns]
        return row.select(F.explode(F.array(*items)).alias("_e")).select(
            "_e.metric", F.col("_e.value").alias("value"), F.lit(name).alias("population")
        )

    both = measures(labelled, "labelled").unionByName(measures(pool, "unlabelled"))
    return both.groupBy("metric").pivot("population", ["labelled", "unlabelled"]).agg(
        F.first("value")
    )


def histogram(
    df: DataFrame, population: str, cols: list[str], bins: int = 30
) -> DataFrame:
    """Equal-width bins between each feature's overall minimum and maximum, per population."""
    stats = df.agg(
        *[fn(_as_double(c)).alias(f"{n}_{i}")
          for i, c in enumerate(cols) for n, fn in (("lo", F.min), ("hi", F.max))]
    ).first()
    cells = []
    for i, c in enumerate(cols):
        lo, hi = (F.lit(stats[f"{n}_{i}"]).cast("double") for n in ("lo", "hi"))
        at = F.floor((_as_double(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins) + F.lit(1)
        cells.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.when(_as_double(c).isNotNull(),
                       F.least(F.coalesce(at, F.lit(1)), F.lit(bins)).cast("int")).alias("bin"),
            )
        )
    return (
        df.select(population, F.explode(F.array(*cells)).alias("_e"))
        .filter("_e.bin is not null")
        .groupBy(population, F.col("_e.feature").alias("feature"), F.col("_e.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_summary(df: DataFrame, cols: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR, and values beyond the fences."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q1, _, q3 = quartiles[c]
        x = _as_double(c)
        known = q1 is not None and q3 is not None  # a column without values has no fences
        lo = F.lit(q1 - reach * (q3 - q1) if known else None).cast("double")
        hi = F.lit(q3 + reach * (q3 - q1) if known else None).cast("double")
        aggs += [
            F.min(F.when(x >= lo, x)).alias(f"whisker_low_{i}"),
            F.max(F.when(x <= hi, x)).alias(f"whisker_high_{i}"),
            F.count_if((x < lo) | (x > hi)).alias(f"outliers_{i}"),
        ]
    extra = {n: {c: quartiles[c][j] for c in cols} for j, n in enumerate(["q1", "median", "q3"])}
    return _spread(df.agg(*aggs), cols, ["whisker_low", "whisker_high", "outliers"], extra)


def integrity_report(spaces: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Any NaN, any infinity and the overall mean of each feature space."""
    out = None
    for name, (df, cols) in spaces.items():
        xs = [F.col(c).cast("double") for c in cols]
        nans = sum([F.count_if(x.isNull() | F.isnan(x)) for x in xs[1:]],
                   F.count_if(xs[0].isNull() | F.isnan(xs[0])))
        infs = sum([F.count_if(F.abs(x) == F.lit(float("inf"))) for x in xs[1:]],
                   F.count_if(F.abs(xs[0]) == F.lit(float("inf"))))
        totals = [F.sum(nan_to_null(x)) for x in xs]
        seen = [F.count(nan_to_null(x)) for x in xs]
        row = df.agg(
            nans.alias("nan_values"),
            infs.alias("inf_values"),
            (sum(totals[1:], totals[0]) / F.nullif(sum(seen[1:], seen[0]), F.lit(0))).alias("mean"),
        ).select(
            F.lit(name).alias("space"), (F.col("nan_values") > 0).alias("has_nan"),
            (F.col("inf_values") > 0).alias("has_inf"), "mean",
        )
        out = row if out is None else out.unionByName(row)
    return out


# --- distribution tests --------------------------------------------------------------------


def cumulative_share(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Running class totals at every distinct value, ascending."""
    per_value = (
        df.filter(_as_double(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("value"))
        .agg(F.count_if(F.col(flag) == 1).alias("n1"), F.count_if(F.col(flag) == 0).alias("n0"))
    )
    return with_running_sums(per_value, [F.col("value")], {"cum1": "n1", "cum0": "n0"})


def ks_two_sample(first: DataFrame, second: DataFrame, cols: list[str]) -> DataFrame:
    """Largest gap of the two empirical distributions per feature, with the asymptotic p.

    Both samples are reduced to counts per distinct value before anything is ordered.
    """
    tagged = unpivot(first, cols).withColumn("a", F.lit(1)).unionByName(
        unpivot(second, cols).withColumn("a", F.lit(0))
    )
    return ks_from_tagged(tagged, ["feature"])


def ks_from_tagged(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """KS distance per key; ``a`` is 1 for the first sample and 0 for the second."""
    per_value = tagged.groupBy(*keys, "value").agg(
        F.sum("a").alias("n1"), F.sum(F.lit(1) - F.col("a")).alias("n0")
    )
    running = with_running_sums(per_value, [F.col("value")], {"c1": "n1", "c0": "n0"}, keys)
    # from the ordered counts, so the samples themselves are read once
    totals = running.groupBy(*keys).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    gaps = (
        join_null_safe(running, totals, keys)
        .groupBy(*keys)
        .agg(
            F.max(F.abs(F.col("c1") / F.col("t1") - F.col("c0") / F.col("t0"))).alias("d"),
            F.first("t1").alias("t1"),
            F.first("t0").alias("t0"),
        )
    )
    p = kolmogorov_p(F.col("d"), F.col("t1"), F.col("t0"))
    return gaps.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


KOLMOGOROV_TERMS = 100


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value 2 Σ (−1)^(j−1) exp(−2 j² λ²)."""
    lam2 = d * d * n1 * n2 / (n1 + n2)
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * j * j * lam2),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    # below this λ the p-value is 1 to 15 digits and the series no longer converges
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(
        F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0))
    )
