"""Exact evaluation of scored rows, result tables, leaderboards and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halflight.functions.scoring import composite_score, improvement_pct, nan_to_null
from halflight.operators.keys import join_null_safe
from halflight.operators.ordering import with_running_sums


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """All four cells, empty ones included, with their share of the total."""
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    row = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if((F.col(label) == a) & (F.col(pred) == p)).alias(f"n{a}{p}")
          for a, p in cells],
    )
    items = [
        F.struct(
            F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{a}{p}").alias("n"),
            (F.col(f"n{a}{p}") * 100.0 / F.nullif(F.col("total"), F.lit(0))).alias("pct"),
        )
        for a, p in cells
    ]
    return row.select(F.explode(F.array(*items)).alias("_e")).select("_e.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_metrics(
    df: DataFrame, label: str, pred: str, keys: list[str] | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1; a zero denominator gives 0."""
    y, p = F.col(label), F.col(pred)
    counts = df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == p).alias("hit"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *(keys or []), "n",
        _ratio(F.col("hit"), F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def score_curve(
    df: DataFrame, label: str, score: str, keys: list[str] | None = None
) -> DataFrame:
    """Counts at every distinct score, and how many rows score at least as high.

    Rows are reduced to one per distinct score first, so tied scores cost nothing.
    """
    keys = keys or []
    per_score = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    running = with_running_sums(
        per_score, [F.desc("score")], {"tp": "pos", "fp": "neg"}, keys
    )
    # from the ordered counts, so the scored rows themselves are read once
    totals = running.groupBy(*keys).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("all_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("all_neg"),
    )
    if keys:
        return join_null_safe(running, totals, keys)
    whole = totals.first()
    return running.withColumns({c: F.lit(whole[c]) for c in ("all_pos", "all_neg")})


def _areas(curve: DataFrame, keys: list[str]) -> DataFrame:
    pos, neg, tp, fp = F.col("pos"), F.col("neg"), F.col("tp"), F.col("fp")
    all_pos, all_neg = F.col("all_pos"), F.col("all_neg")
    # negatives strictly below a score, plus half of the tied ones
    wins = pos * (all_neg - fp + neg / 2)
    step = pos / F.nullif(all_pos, F.lit(0)) * tp / (tp + fp)
    usable = (F.count(F.lit(1)) > 2) & ~F.bool_and(F.col("score").isin(0.0, 1.0))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return curve.groupBy(*keys).agg(
        F.when(usable & both, F.sum(wins) / F.max(all_pos) / F.max(all_neg)).alias("roc_auc"),
        F.when(usable & (F.max("all_pos") > 0), F.sum(step)).alias("pr_auc"),
    )


def ranking_metrics(df, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties at mid-rank) and average precision; NULL without real scores."""
    return _areas(score_curve(df, label, score, keys), keys or [])


def roc_auc(df, label, score, keys=None) -> DataFrame:
    return ranking_metrics(df, label, score, keys).drop("pr_auc")


def pr_auc(df, label, score, keys=None) -> DataFrame:
    return ranking_metrics(df, label, score, keys).drop("roc_auc")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    return score_curve(df, label, score).select(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.col("all_neg")).alias("fpr"),
        (F.col("tp") / F.col("all_pos")).alias("tpr"),
    )


def evaluate_scores(
    df: DataFrame, label: str, pred: str, score: str, keys: list[str] | None = None
) -> DataFrame:
    """One metrics row per run (or one row when no run key is given)."""
    keys = keys or []
    base = classification_metrics(df, label, pred, keys)
    areas = ranking_metrics(df, label, score, keys)
    if keys:
        return join_null_safe(base, areas, keys)
    both = areas.first()
    return base.withColumns(
        {c: F.lit(both[c]).cast("double") for c in ("roc_auc", "pr_auc")}
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (k · n_c) per class."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return counts.withColumn("weight", F.lit(whole["n"]) / (F.lit(whole["k"]) * F.col("n")))


# --- result tables -------------------------------------------------------------------------


def combine_results(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_composite(results: DataFrame, missing: str = "f1") -> DataFrame:
    """(F1 + AUC) / 2; a missing AUC is read as F1 (choosing) or as 0.5 (saving)."""
    stand_in = F.col("f1") if missing == "f1" else F.lit(0.5)
    return results.withColumn(
        "composite", composite_score(F.col("f1"), F.col("roc_auc"), stand_in)
    )


def compare_to_baseline(results: DataFrame, is_baseline: Column, cols: list[str]) -> DataFrame:
    """Improvement over the baseline row in percent; 0 where either value is missing."""
    base = results.filter(is_baseline).agg(
        *[F.max(nan_to_null(F.col(c))).alias(c) for c in cols]
    ).first()
    return results.withColumns(
        {f"{c}_gain_pct": improvement_pct(
            nan_to_null(F.col(c)), F.lit(base[c]).cast("double")) for c in cols}
    )


def best_per_method(results: DataFrame, method: str, score: str, tie: str) -> DataFrame:
    best = W.partitionBy(method).orderBy(F.desc_nulls_last(score), F.col(tie))
    return results.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def leaderboard(
    results: DataFrame, score: str, is_baseline: Column, cols: list[str]
) -> DataFrame:
    """Rank of every run by score, with its gain over the baseline.

    A results table has one row per run, so its rank is counted from the distinct scores.
    """
    compared = compare_to_baseline(results, is_baseline, cols)
    per_score = results.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    running = with_running_sums(per_score, [F.desc_nulls_last("_s")], {"_upto": "_n"})
    ranks = running.select("_s", (F.col("_upto") - F.col("_n") + 1).alias("rank"))
    return compared.join(ranks, F.col(score).eqNullSafe(F.col("_s"))).drop("_s")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def select_best_model(results: DataFrame, score: str = "roc_auc") -> DataFrame:
    """The run with the largest score over all models and feature spaces."""
    return results.orderBy(F.desc_nulls_last(score), "model", "space").limit(1)


def experiment_report(
    results: DataFrame, is_baseline: Column, experiment: str, method: str = "method"
) -> DataFrame:
    """One nested row: best run, its settings and its gain over the baseline."""
    scored = with_composite(results, "half")
    compared = compare_to_baseline(scored, is_baseline, ["composite", "f1", "roc_auc"])
    runs = compared.filter(~is_baseline)
    order = F.struct(F.col("composite"), -F.col("n_unlabeled"))
    best = runs.agg(
        F.max_by(F.struct("*"), order).alias("best"),
        F.sort_array(F.collect_set(F.col(method))).alias("methods_tested"),
        F.count(F.lit(1)).alias("runs"),
    )
    base = F.lit(scored.filter(is_baseline).agg(F.max("composite")).first()[0]).cast("double")
    b = F.col("best")
    return best.select(
        F.lit(experiment).alias("experiment_type"),
        F.struct(
            b[method].alias("method"),
            b["n_unlabeled"].alias("n_unlabeled_used"),
            b["composite"].alias("composite_score"),
            b["f1"].alias("f1_score"),
            b["roc_auc"].alias("roc_auc"),
            base.alias("baseline_composite"),
            b["composite_gain_pct"].alias("improvement_composite_pct"),
            b["f1_gain_pct"].alias("improvement_f1_pct"),
            b["roc_auc_gain_pct"].alias("improvement_roc_pct"),
        ).alias("best_model"),
        "methods_tested",
        "runs",
        # Texts of the findings.
        F.array(
            F.format_string(
                "Best Method: %s with %,d unlabeled samples.", b[method],
                b["n_unlabeled"].cast("long"),
            ),
            F.format_string(
                "Composite Score improved by %+.2f%% (from %.4f to %.4f).",
                b["composite_gain_pct"], base, b["composite"],
            ),
            F.format_string("F1-Score improved by %+.2f%%.", b["f1_gain_pct"]),
        ).alias("key_findings"),
    )


def generation_stats(population: DataFrame) -> DataFrame:
    """Spread of feature counts and of fitness per generation."""
    aggs = []
    for c in ("n_selected", "fitness"):
        aggs += [
            F.avg(c).alias(f"{c}_avg"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"), F.stddev_pop(c).alias(f"{c}_std"),
        ]
    return population.groupBy("generation").agg(*aggs)


def generation_gain(stats: DataFrame, generation: str, best: str) -> DataFrame:
    """Change of the best fitness against the first generation, and the best generation."""
    whole = stats.agg(
        F.min_by(best, generation).alias("first"),
        F.max_by(generation, F.struct(F.col(best), -F.col(generation))).alias("top"),
    ).first()
    first = F.lit(whole["first"])
    return stats.select(
        generation, best,
        ((F.col(best) - first) / F.nullif(first, F.lit(0.0)) * 100).alias("gain_pct"),
        (F.col(generation) == F.lit(whole["top"])).alias("is_best"),
    )
