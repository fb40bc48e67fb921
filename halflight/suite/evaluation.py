"""Metrics, curves, result tables and reports."""

from pyspark.sql import functions as F

from halflight.functions.scoring import decide
from halflight.operators import evaluate
from halflight.session import cut_lineage
from halflight.suite.base import LINES, q6, query, r6, scored_lines, table
from halflight.suite.cleaning import rounded

SCORES = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
METRICS = ", ".join(q6(c) for c in SCORES)


def areas_sql(keys: str, source: str = "scored", label: str = "label", p: str = "p1",
              name: str = "areas") -> str:
    """ROC-AUC by mid-rank pair counts and average precision, per key."""
    by = f"PARTITION BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""
{name}_per AS (SELECT {cols}{p} AS s, sum({label}) AS pos, sum(1 - {label}) AS neg
  FROM {source} GROUP BY {cols}{p}),
{name}_cum AS (SELECT *, sum(pos) OVER (up) AS tp, sum(neg) OVER (up) AS fp,
    sum(pos) OVER ({by}) AS all_pos, sum(neg) OVER ({by}) AS all_neg
  FROM {name}_per WINDOW up AS ({by} ORDER BY s DESC)),
{name} AS (SELECT {cols}count(*) AS n_scores,
    CASE WHEN count(*) > 2 AND NOT bool_and(s IN (0, 1)) AND max(all_pos) > 0
      AND max(all_neg) > 0
      THEN sum(pos * (all_neg - fp + neg / 2)) / max(all_pos) / max(all_neg) END AS roc_auc,
    CASE WHEN count(*) > 2 AND NOT bool_and(s IN (0, 1)) AND max(all_pos) > 0
      THEN sum(pos / all_pos * tp / (tp + fp)) END AS pr_auc
  FROM {name}_cum {"GROUP BY " + keys if keys else ""})"""


def counts_sql(keys: str, source: str = "scored", label: str = "label", pred: str = "p1 >= 0.5",
               name: str = "counts") -> str:
    cols = f"{keys}, " if keys else ""
    return f"""
{name}_raw AS (SELECT {cols}count(*) AS n,
    count(*) FILTER ({label} = 1 AND {pred}) AS tp, count(*) FILTER ({label} = 0 AND {pred}) AS fp,
    count(*) FILTER ({label} = 1 AND NOT ({pred})) AS fn,
    count(*) FILTER (({label} = 1) = ({pred})) AS hit
  FROM {source} {"GROUP BY " + keys if keys else ""}),
{name} AS (SELECT {cols}n, hit / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {name}_raw)"""


RUNS = f"""{counts_sql("method, n_unlabeled")}, {areas_sql("method, n_unlabeled")},
runs AS (SELECT * FROM counts JOIN areas USING (method, n_unlabeled))"""

BASE = "method = 'A' AND n_unlabeled = (SELECT min(n_unlabeled) FROM runs)"


def runs(spark, sf):
    """One metrics row per method and run size of the scored lines."""
    scored = scored_lines(spark, sf).withColumn("pred", decide(F.col("p1")))
    return cut_lineage(
        evaluate.evaluate_scores(scored, "label", "pred", "p1", ["method", "n_unlabeled"]))


def baseline(results):
    return (F.col("method") == "A") & (
        F.col("n_unlabeled") == results.agg(F.min("n_unlabeled")).first()[0])


def scored(spark, sf):
    return scored_lines(spark, sf).withColumn("pred", decide(F.col("p1")))


@query("confusion_matrix", f"""
WITH {LINES}, grid AS (SELECT a.x AS actual, p.x AS predicted FROM (VALUES (0), (1)) a(x),
  (VALUES (0), (1)) p(x)),
c AS (SELECT label, CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n
  FROM scored GROUP BY ALL)
SELECT actual, predicted, coalesce(n, 0) AS n,
  {q6("coalesce(n, 0) * 100.0 / (SELECT count(*) FROM scored)", "pct")}
FROM grid LEFT JOIN c ON actual = label AND predicted = pred""")
def confusion_matrix(spark, sf):
    return rounded(evaluate.confusion_matrix(scored(spark, sf), "label", "pred"), ["pct"])


@query("classification_metrics", f"""
WITH {LINES}, {counts_sql("method")}
SELECT method, n, {", ".join(q6(c) for c in SCORES[:4])} FROM counts""")
def classification_metrics(spark, sf):
    return rounded(
        evaluate.classification_metrics(scored(spark, sf), "label", "pred", ["method"]),
        SCORES[:4])


@query("roc_auc", f"WITH {LINES}, {areas_sql('')} SELECT {q6('roc_auc')} FROM areas")
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(scored(spark, sf), "label", "p1"), ["roc_auc"])


@query("pr_auc", f"WITH {LINES}, {areas_sql('')} SELECT {q6('pr_auc')} FROM areas")
def pr_auc(spark, sf):
    return rounded(evaluate.pr_auc(scored(spark, sf), "label", "p1"), ["pr_auc"])


@query("roc_curve", f"""
WITH {LINES}, {areas_sql("")}
SELECT {q6("s", "threshold")}, {q6("fp / all_neg", "fpr")}, {q6("tp / all_pos", "tpr")}
FROM areas_cum""")
def roc_curve(spark, sf):
    return rounded(evaluate.roc_curve(scored(spark, sf), "label", "p1"),
                   ["threshold", "fpr", "tpr"])


@query("class_weights", f"""
SELECT toxic, count(*) AS n, {q6("(SELECT count(*) FROM labels) / (2 * count(*))", "weight")}
FROM labels GROUP BY toxic""")
def class_weights(spark, sf):
    return rounded(evaluate.class_weights(table(spark, sf, "labels"), "toxic"), ["weight"])


@query("composite_score", f"""
WITH {LINES}, {RUNS}
SELECT method, n_unlabeled, {q6("(f1 + coalesce(roc_auc, f1)) / 2", "chosen_by")},
  {q6("(f1 + coalesce(roc_auc, 0.5)) / 2", "saved_as")} FROM runs""")
def composite_score(spark, sf):
    results = runs(spark, sf)
    both = evaluate.with_composite(results, "f1").withColumnRenamed("composite", "chosen_by")
    return evaluate.with_composite(both, "half").select(
        "method", "n_unlabeled", r6("chosen_by"), r6("composite", "saved_as"))


GAINS = ["f1", "roc_auc"]


@query("compare_to_baseline", f"""
WITH {LINES}, {RUNS}, b AS (SELECT * FROM runs WHERE {BASE})
SELECT r.method, r.n_unlabeled, {", ".join(q6(
    f"coalesce((r.{c} - b.{c}) / nullif(b.{c}, 0) * 100, 0)", f"{c}_gain_pct") for c in GAINS)}
FROM runs r, b""")
def compare_to_baseline(spark, sf):
    results = runs(spark, sf)
    return rounded(
        evaluate.compare_to_baseline(results, baseline(results), GAINS).select(
            "method", "n_unlabeled", "f1_gain_pct", "roc_auc_gain_pct"),
        ["f1_gain_pct", "roc_auc_gain_pct"])


@query("best_per_method", f"""
WITH {LINES}, {RUNS}, c AS (SELECT *, (f1 + coalesce(roc_auc, f1)) / 2 AS composite FROM runs)
SELECT method, n_unlabeled, {q6("composite")} FROM (
  SELECT *, row_number() OVER (PARTITION BY method ORDER BY composite DESC, n_unlabeled) AS rn
  FROM c) WHERE rn = 1""")
def best_per_method(spark, sf):
    scored_runs = evaluate.with_composite(runs(spark, sf), "f1")
    return evaluate.best_per_method(scored_runs, "method", "composite", "n_unlabeled").select(
        "method", "n_unlabeled", r6("composite"))


@query("leaderboard", f"""
WITH {LINES}, {RUNS}, b AS (SELECT * FROM runs WHERE {BASE})
SELECT r.method, r.n_unlabeled, rank() OVER (ORDER BY r.f1 DESC) AS "rank",
  {q6("coalesce((r.f1 - b.f1) / nullif(b.f1, 0) * 100, 0)", "f1_gain_pct")} FROM runs r, b""")
def leaderboard(spark, sf):
    results = runs(spark, sf)
    return evaluate.leaderboard(results, "f1", baseline(results), ["f1"]).select(
        "method", "n_unlabeled", "rank", r6("f1_gain_pct"))


@query("top_n", f"""
WITH {LINES}, {RUNS} SELECT method, n_unlabeled, {q6("f1")} FROM runs
ORDER BY runs.f1 DESC, method, n_unlabeled LIMIT 5""")
def top_n(spark, sf):
    best = evaluate.top_n(runs(spark, sf), [F.desc("f1"), F.col("method"),
                                            F.col("n_unlabeled")], 5)
    return best.select("method", "n_unlabeled", r6("f1"))


@query("combine_results", f"""
WITH {LINES}, {RUNS}
SELECT method, n_unlabeled, {q6("f1")}, CASE method WHEN 'R' THEN n END AS final_train_size,
  CASE method WHEN 'R' THEN NULL ELSE {q6("roc_auc", "_")[:-5]} END AS roc_auc FROM runs""")
def combine_results(spark, sf):
    results = runs(spark, sf)
    one = results.filter("method <> 'R'").select("method", "n_unlabeled", "f1", "roc_auc")
    two = results.filter("method = 'R'").select(
        "method", "n_unlabeled", "f1", F.col("n").alias("final_train_size"))
    return rounded(evaluate.combine_results(one, two), ["f1", "roc_auc"])


@query("select_best_model", f"""
WITH {LINES}, long AS (SELECT method, label, p1 AS p, 'quantity' AS space FROM scored
  UNION ALL SELECT method, label, p2, 'tax' FROM scored
  UNION ALL SELECT method, label, p3, 'mixed' FROM scored),
{areas_sql("method, space", "long", p="p")}
SELECT method AS model, space, {q6("roc_auc")} FROM areas
ORDER BY areas.roc_auc DESC, method, space LIMIT 1""")
def select_best_model(spark, sf):
    lines = scored_lines(spark, sf)
    long = lines.select(
        F.col("method").alias("model"), "label",
        F.explode(F.array(*[F.struct(F.lit(n).alias("space"), F.col(p).alias("p"))
                            for n, p in (("quantity", "p1"), ("tax", "p2"), ("mixed", "p3"))])
                  ).alias("_e")).select("model", "label", "_e.*")
    table_ = evaluate.ranking_metrics(long, "label", "p", ["model", "space"])
    return evaluate.select_best_model(table_).select("model", "space", r6("roc_auc"))


@query("experiment_report", f"""
WITH {LINES}, {RUNS}, c AS (SELECT *, (f1 + coalesce(roc_auc, 0.5)) / 2 AS composite FROM runs),
b AS (SELECT * FROM c WHERE {BASE}),
ssl AS (SELECT c.* FROM c, b WHERE NOT (c.method = b.method AND c.n_unlabeled = b.n_unlabeled)),
best AS (SELECT * FROM ssl ORDER BY composite DESC, n_unlabeled LIMIT 1)
SELECT best.method AS method, best.n_unlabeled AS n_unlabeled_used,
  {q6("best.composite", "composite_score")}, {q6("b.composite", "baseline_composite")},
  {q6("(best.composite - b.composite) / b.composite * 100", "improvement_composite_pct")},
  {q6("(best.f1 - b.f1) / b.f1 * 100", "improvement_f1_pct")},
  {q6("coalesce((best.roc_auc - b.roc_auc) / b.roc_auc * 100, 0)", "improvement_roc_pct")},
  (SELECT string_agg(DISTINCT method, ',' ORDER BY method) FROM ssl) AS methods,
  (SELECT count(*) FROM ssl) AS runs,
  format('Best Method: {{}} with {{:,}} unlabeled samples.', best.method, best.n_unlabeled) AS finding
FROM best, b""")
def experiment_report(spark, sf):
    results = runs(spark, sf)
    report = evaluate.experiment_report(results, baseline(results), "lines")
    best = F.col("best_model")
    pct = ["improvement_composite_pct", "improvement_f1_pct", "improvement_roc_pct"]
    return report.select(
        best["method"].alias("method"), best["n_unlabeled_used"].alias("n_unlabeled_used"),
        r6(best["composite_score"], "composite_score"),
        r6(best["baseline_composite"], "baseline_composite"),
        *[r6(best[c], c) for c in pct],
        F.array_join("methods_tested", ",").alias("methods"), "runs",
        F.col("key_findings")[0].alias("finding"))
