"""Profiles, correlations and distribution tests."""

from pyspark.sql import functions as F

from halflight.functions.scoring import LIPINSKI_LIMITS, rule_flag
from halflight.operators import profile
from halflight.operators.quantiles import exact_quantiles
from halflight.suite.base import (
    DESC,
    FEATS,
    LABELLED,
    NUM,
    descriptors,
    labelled_docs,
    pool_docs,
    q6,
    query,
    r6,
    table,
)
from halflight.suite.cleaning import ODD, RULE, _pairs_sql, odd_rows, rounded, ruled_lines


def long_sql(cols, source, ids=""):
    return (f"UNPIVOT (SELECT {ids}{', '.join(cols)} FROM {source}) ON {', '.join(cols)}"
            " INTO NAME feature VALUE x")


@query("describe", f"""
WITH long AS ({long_sql(NUM, "lineitem")})
SELECT feature, count(x) AS "count", {q6("avg(x)", "mean")}, {q6("stddev_samp(x)", "std")},
  {q6("min(x)", "min")}, {q6("max(x)", "max")}, {q6("quantile_cont(x, 0.25)", "q25")},
  {q6("quantile_cont(x, 0.5)", "q50")}, {q6("quantile_cont(x, 0.75)", "q75")}
FROM long GROUP BY feature""")
def describe(spark, sf):
    return rounded(profile.describe(table(spark, sf, "lineitem"), NUM),
                   ["mean", "std", "min", "max", "q25", "q50", "q75"])


@query("missing_report", f"""
WITH {ODD}, m AS (
  SELECT 'x' AS feature, count(*) FILTER (x IS NULL OR isnan(x)) AS missing, count(*) AS n FROM odd
  UNION ALL SELECT 'y', count(*) FILTER (y IS NULL OR isnan(y)), count(*) FROM odd)
SELECT feature, missing, {q6("missing * 100.0 / n", "missing_pct")} FROM m WHERE missing > 0""")
def missing_report(spark, sf):
    return rounded(profile.missing_report(odd_rows(spark, sf), ["x", "y"]), ["missing_pct"])


@query("class_distribution", f"""
SELECT toxic, count(*) AS n, {q6("count(*) / (SELECT count(*) FROM labels)", "share")}
FROM labels GROUP BY toxic""")
def class_distribution(spark, sf):
    return rounded(profile.class_distribution(table(spark, sf, "labels"), "toxic"), ["share"])


@query("crosstab", """
SELECT quality, toxic, count(*) AS n, grouping(quality, toxic) AS level
FROM labels GROUP BY CUBE (quality, toxic)""")
def crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "labels"), "quality", "toxic")


@query("imbalance_status", f"""
WITH c AS (SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1 FROM labels)
SELECT n0, n1, {q6("abs(n0 - n1) / (n0 + n1)", "imbalance")},
  CASE WHEN abs(n0 - n1) / (n0 + n1) > 0.3 THEN 'IMBALANCED' ELSE 'BALANCED' END AS status FROM c""")
def imbalance_status(spark, sf):
    return rounded(profile.imbalance_status(table(spark, sf, "labels"), "toxic"), ["imbalance"])


@query("correlation_matrix", f"""
WITH pairs AS ({_pairs_sql(NUM, "lineitem")})
SELECT f1 AS feature_1, f2 AS feature_2, {q6("r")} FROM pairs
UNION ALL SELECT f2, f1, {q6("r")} FROM pairs
UNION ALL SELECT unnest({NUM}), unnest({NUM}), 1.0""")
def correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(table(spark, sf, "lineitem"), NUM), ["r"])


WIDE = DESC + ["n_chars", "t_ratio"]
WIDE_CTE = f"""{FEATS}, wide AS (
  SELECT f.*, d.n_chars, CASE WHEN t_lines > 3 THEN t_chars / t_lines END AS t_ratio
  FROM feats f JOIN documents d USING (doc_id))"""


@query("correlation_matrix_wide", f"""
WITH {WIDE_CTE}, pairs AS ({_pairs_sql(WIDE, "wide")})
SELECT f1 AS feature_1, f2 AS feature_2, {q6("r")} FROM pairs""")
def correlation_matrix_wide(spark, sf):
    """More columns than the single-aggregate form takes, some values missing."""
    rows = descriptors(spark, sf).join(
        table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    ).withColumn("t_ratio", F.when(F.col("t_lines") > 3, F.col("t_chars") / F.col("t_lines")))
    return rounded(profile.correlation_pairs(rows, WIDE).drop("i", "j"), ["r"])


@query("target_correlation", f"""
WITH {LABELLED}, r AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, label) AS r FROM labelled" for c in DESC)})
SELECT feature, {q6("r")} FROM r WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY r DESC LIMIT 5""")
def target_correlation(spark, sf):
    return rounded(
        profile.target_correlation(labelled_docs(spark, sf), DESC, "label", top=5), ["r"])


@query("high_corr_pairs", f"""
WITH {FEATS}, pairs AS ({_pairs_sql(DESC, "feats")})
SELECT f1 AS feature_1, f2 AS feature_2, {q6("r")} FROM pairs WHERE abs(r) > 0.5
ORDER BY abs(r) DESC, i, j LIMIT 20""")
def high_corr_pairs(spark, sf):
    return rounded(profile.high_corr_pairs(descriptors(spark, sf), DESC), ["r"])


@query("group_profile", f"""
WITH {RULE} SELECT l_returnflag, count(*) AS n, {q6('avg("MolWt")', '"mean_MolWt"')},
  {q6('avg("LogP")', '"mean_LogP"')}, {q6("avg(ok::INT)", "compliant_share")}
FROM ruled GROUP BY l_returnflag""")
def group_profile(spark, sf):
    return rounded(
        profile.group_profile(ruled_lines(spark, sf), "l_returnflag", ["MolWt", "LogP"],
                              rule_flag(LIPINSKI_LIMITS)),
        ["mean_MolWt", "mean_LogP", "compliant_share"])


@query("compliance_rate", f"""
WITH {RULE} SELECT l_returnflag, count(*) AS n, count(*) FILTER (ok) AS compliant,
  {q6("avg(ok::INT) * 100", "compliant_pct")} FROM ruled GROUP BY l_returnflag""")
def compliance_rate(spark, sf):
    return rounded(
        profile.compliance_rate(ruled_lines(spark, sf), "l_returnflag",
                                rule_flag(LIPINSKI_LIMITS)), ["compliant_pct"])


def _measures(source):
    items = [("rows", "count(*)"), ("features", "max(8)"),
             ("missing_values", "max(0)"),
             ("compliant_pct", "avg((t_words <= 500 AND t_upper <= 0.05)::INT) * 100")]
    items += [(f"mean_{c}", f"avg({c})") for c in DESC]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, CAST({e} AS DOUBLE) AS v FROM {source}" for n, e in items)


@query("dataset_comparison", f"""
WITH {LABELLED}, a AS ({_measures("labelled")}), b AS ({_measures("pool")})
SELECT metric, {q6("a.v", "labelled")}, {q6("b.v", "unlabelled")} FROM a JOIN b USING (metric)""")
def dataset_comparison(spark, sf):
    flag = rule_flag({"t_words": 500, "t_upper": 0.05})
    return rounded(
        profile.dataset_comparison(labelled_docs(spark, sf), pool_docs(spark, sf), DESC, flag),
        ["labelled", "unlabelled"])


@query("histogram", f"""
WITH long AS ({long_sql(["l_quantity", "l_extendedprice"], "lineitem", "l_returnflag, ")}),
b AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY feature)
SELECT l_returnflag, feature,
  CAST(least(floor((x - lo) / (hi - lo) * 30) + 1, 30) AS INT) AS bin, count(*) AS n
FROM long JOIN b USING (feature) GROUP BY ALL""")
def histogram(spark, sf):
    return profile.histogram(
        table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])


@query("box_summary", f"""
WITH long AS ({long_sql(["l_quantity", "l_extendedprice"], "lineitem")}),
q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, median(x) AS median,
  quantile_cont(x, 0.75) AS q3 FROM long GROUP BY feature)
SELECT feature, {q6("min(x) FILTER (x >= q1 - 1.5 * (q3 - q1))", "whisker_low")},
  {q6("max(x) FILTER (x <= q3 + 1.5 * (q3 - q1))", "whisker_high")},
  count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers,
  {q6("any_value(q1)", "q1")}, {q6("any_value(median)", "median")}, {q6("any_value(q3)", "q3")}
FROM long JOIN q USING (feature) GROUP BY feature""")
def box_summary(spark, sf):
    return rounded(
        profile.box_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]),
        ["whisker_low", "whisker_high", "q1", "median", "q3"])


@query("integrity_report", f"""
WITH {ODD}
SELECT 'orders' AS space, true AS has_nan, true AS has_inf,
  CAST(NULL AS DOUBLE) AS mean
UNION ALL SELECT 'lineitem', false, false, {q6("(sum(l_quantity) + sum(l_tax)) / (2 * count(*))", "m")}
FROM lineitem""")
def integrity_report(spark, sf):
    report = profile.integrity_report({
        "orders": (odd_rows(spark, sf), ["x", "y"]),
        "lineitem": (table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])})
    finite = F.abs("mean") < F.lit(float("inf"))
    return report.withColumn("mean", F.when(finite, F.round("mean", 6)))


KS_TERMS = """least(greatest(list_sum(list_transform(range(1, 101),
  lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * lam2))), 0.0), 1.0)"""


def ks_sql(tagged: str, key: str) -> str:
    """KS distance and p per key from a CTE ``tagged`` with (key, x, a)."""
    return f"""
per AS (SELECT {key}, x, sum(a) AS n1, sum(1 - a) AS n0 FROM {tagged} GROUP BY {key}, x),
cum AS (SELECT {key}, sum(n1) OVER w AS c1, sum(n0) OVER w AS c0,
  sum(n1) OVER (PARTITION BY {key}) AS t1, sum(n0) OVER (PARTITION BY {key}) AS t0
  FROM per WINDOW w AS (PARTITION BY {key} ORDER BY x)),
gap AS (SELECT {key}, max(abs(c1 / t1 - c0 / t0)) AS d, max(t1) AS t1, max(t0) AS t0
  FROM cum GROUP BY {key}),
lam AS (SELECT {key}, d, t1, t0, d * d * t1 * t0 / (t1 + t0) AS lam2 FROM gap),
ks AS (SELECT *, CASE WHEN lam2 < 0.04 THEN 1.0 ELSE {KS_TERMS} END AS p_value FROM lam)"""


@query("ks_two_sample", f"""
WITH {LABELLED},
tagged AS (SELECT *, 1 AS a FROM ({long_sql(DESC, "labelled")})
  UNION ALL SELECT *, 0 FROM ({long_sql(DESC, "pool")})),
{ks_sql("tagged", "feature")}
SELECT feature, {q6("d")}, t1::BIGINT AS t1, t0::BIGINT AS t0, {q6("p_value")},
  p_value < 0.05 AS significant FROM ks""")
def ks_two_sample(spark, sf):
    return rounded(
        profile.ks_two_sample(labelled_docs(spark, sf), pool_docs(spark, sf), DESC),
        ["d", "p_value"])


@query("cumulative_share", f"""
WITH per AS (SELECT value, count(*) FILTER (event_type = 'error') AS n1,
    count(*) FILTER (event_type <> 'error') AS n0 FROM events GROUP BY value)
SELECT {q6("value")}, n1, n0, (sum(n1) OVER (ORDER BY value))::BIGINT AS cum1,
  (sum(n0) OVER (ORDER BY value))::BIGINT AS cum0 FROM per""")
def cumulative_share(spark, sf):
    rows = table(spark, sf, "events").select(
        "value", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flag"))
    return profile.cumulative_share(rows, "value", "flag").withColumn("value", r6("value"))


PROBS = [0.0, 0.05, 0.5, 0.95, 1.0]


@query("bracketed_quantiles", "WITH l AS (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, "
       "l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount "
       "INTO NAME feature VALUE x), p AS (SELECT unnest([0.0, 0.05, 0.5, 0.95, 1.0]::DOUBLE[]) AS prob) "
       "SELECT feature, prob, round(CASE prob WHEN 0.0 THEN quantile_cont(x, 0.0) "
       "WHEN 0.05 THEN quantile_cont(x, 0.05) WHEN 0.5 THEN quantile_cont(x, 0.5) "
       "WHEN 0.95 THEN quantile_cont(x, 0.95) ELSE quantile_cont(x, 1.0) END, 6) + 0.0 AS value "
       "FROM l, p GROUP BY feature, prob")
def bracketed_quantiles(spark, sf):
    """Quantiles by the way of large tables: ranks bracketed by the sketch, few rows inside."""
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    found = exact_quantiles(table(spark, sf, "lineitem"), cols, PROBS, direct_rows=500)
    rows = [(c, p, v) for c, values in found.items() for p, v in zip(PROBS, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, prob double, value double").withColumn(
        "value", F.round("value", 6))
