"""Supervised models, their comparison, and searches over settings and features."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.functions.scoring import confidence, decide
from halflight.operators.evaluate import (
    compare_to_baseline,
    evaluate_scores,
    score_curve,
)
from halflight.operators.forest import ForestTrials, GrownForest, forest_predict, grow_forests
from halflight.operators.graph import knn_classify
from halflight.operators.search import search, trials_table
from halflight.session import cut_lineage, gathered


#: More values of a target than this are not classes.
MAX_CLASSES = 1000


class Spread(NamedTuple):
    """What one pass over the training rows tells: rows per class, and per feature the number, mean
    and sum of squared deviations of its finite values."""

    classes: dict
    features: list[tuple[int, float, float]]


def _finite(column: str) -> str:
    x = f"CAST(`{column}` AS DOUBLE)"
    return f"CASE WHEN abs({x}) < CAST('Infinity' AS DOUBLE) THEN {x} END"


def _spread(rows: DataFrame, values: list[Column], target: str) -> Spread:
    aggs = [f(v).alias(f"{n}{i}") for i, v in enumerate(values)
            for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    groups = rows.groupBy(target).agg(F.count(F.lit(1)).alias("rows"), *aggs).limit(MAX_CLASSES + 1).collect()
    if len(groups) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} values")
    found = [_merged([(g[f"n{i}"], g[f"m{i}"], g[f"v{i}"]) for g in groups]) for i in range(len(values))]
    return Spread({g[target]: g["rows"] for g in groups}, found)


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def fit_inputs(
    train: DataFrame, features: list[str], target: str, clip: float | None = None, scale: bool = False
) -> tuple[SQLTransformer, Spread]:
    """A transformer that adds ``_x0, _x1, ...``: the features as a model reads them.

    Missing and infinite values become the training mean (0 if the column has none), then values are
    clipped to mean ± ``clip`` sample deviations, then scaled to mean 0 and deviation 1. All numbers
    are those of ``train`` and are part of the transformer, so they are saved with the model and
    hold for every table it scores. No row is dropped.
    """
    spread = _spread(train, [F.expr(_finite(c)) for c in features], target)
    exprs = [f"coalesce({_finite(c)}, {_number(mean)})"
             for c, (_, mean, _) in zip(features, spread.features, strict=True)]
    if clip is not None:
        for i, (n, mean, squares) in enumerate(spread.features):
            reach = clip * math.sqrt(squares / (n - 1)) if n > 1 else 0.0
            exprs[i] = (f"least(greatest({exprs[i]}, {_number(mean - reach)}), {_number(mean + reach)})")
    if scale:
        clipped = _spread(train, [F.expr(e) for e in exprs], target) if clip is not None else spread
        for i, (n, mean, squares) in enumerate(clipped.features):
            deviation = math.sqrt(squares / n) if n else 0.0
            exprs[i] = f"({exprs[i]} - {_number(mean)}) / {_number(deviation or 1.0)}"
    named = ", ".join(f"{e} AS _x{i}" for i, e in enumerate(exprs))
    return SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__"), spread


def apply_inputs(df: DataFrame, inputs: SQLTransformer, features: list[str]) -> DataFrame:
    """``df`` with its features as the fitted transformer makes them."""
    made = inputs.transform(df)
    return made.withColumns({c: F.col(f"_x{i}") for i, c in enumerate(features)}).drop(
        *[f"_x{i}" for i in range(len(features))])


def _fitted(rows: DataFrame, inputs: SQLTransformer, features: list[str], model) -> PipelineModel:
    assembler = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))],
                                outputCol="features", handleInvalid="error")
    return Pipeline(stages=[inputs, assembler, model]).fit(rows)


def with_class_weight(
    df: DataFrame, target: str, name: str = "weight", classes: dict | None = None
) -> DataFrame:
    """Balanced weight n / (k · n_c) on every row; ``classes`` may give the rows per class."""
    if classes is None:
        classes = _spread(df, [], target).classes
    classes = {c: n for c, n in classes.items() if c is not None}
    weight, total = F.lit(None).cast("double"), sum(classes.values())
    for c, n in classes.items():
        weight = F.when(F.col(target) == F.lit(c), total / (len(classes) * n)).otherwise(weight)
    return df.withColumn(name, weight)


def random_forest(
    train: DataFrame, features: list[str], target: str, trees: int = 100, max_depth: int = 10,
    min_leaf: int = 1, subset: str = "sqrt", balanced: bool = True, seed: int = 42,
    clip: float | None = None, scale: bool = False,
) -> PipelineModel:
    """Forest over the named columns; ``max_depth`` may be at most 30 in Spark. Rows without a
    target do not teach; gaps in features are filled as ``fit_inputs`` says."""
    rows = train.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    inputs, spread = fit_inputs(rows, features, target, clip, scale)
    forest = RandomForestClassifier(
        labelCol="_y", featuresCol="features", numTrees=trees, maxDepth=max_depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed,
        cacheNodeIds=True,  # else every level walks each row down every tree again from its root
    )
    if balanced:
        rows = with_class_weight(rows, target, "_weight", spread.classes)
        forest = forest.setWeightCol("_weight")
    return _fitted(rows, inputs, features, forest)


def grown_forest(
    train: DataFrame, features: list[str], target: str, trees: int = 100, max_depth: int = 10,
    min_leaf: int = 1, subset: str = "sqrt", balanced: bool = True, seed: int = 42,
    clip: float | None = None, scale: bool = False,
) -> GrownForest:
    """``random_forest`` with its trees grown in tasks, as ``operators/forest.py`` says: for loops and searches."""
    if clip is None and not scale:
        return grow_forests(train, [features], target, trees, max_depth, min_leaf, subset, balanced, seed)[0]
    inputs, _ = fit_inputs(train.filter(F.col(target).isNotNull()), features, target, clip, scale)
    made = [f"_x{i}" for i in range(len(features))]
    model, = grow_forests(inputs.transform(train), [made], target, trees, max_depth, min_leaf, subset, balanced, seed)
    model.inputs = inputs
    return model


def logistic_regression(
    train: DataFrame, features: list[str], target: str, c: float = 1.0, max_iter: int = 1000,
    clip: float | None = None, scale: bool = False,
) -> PipelineModel:
    """L2 logistic regression; C of the usual form becomes regParam 1/(C·n). Rows without a target do
    not teach; gaps in features are filled as ``fit_inputs`` says."""
    rows = train.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    inputs, spread = fit_inputs(rows, features, target, clip, scale)
    model = LogisticRegression(
        labelCol="_y", maxIter=max_iter, standardization=False,
        regParam=1.0 / (c * max(1, sum(spread.classes.values()))),
    )
    return _fitted(rows, inputs, features, model)


def positive_probability(scored: DataFrame) -> DataFrame:
    """``p1`` from the probability vector; 0 when the model only saw class 0."""
    return scored.withColumn(
        "p1", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    )


def predict(model: PipelineModel | GrownForest, df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns plus p1, prediction and confidence."""
    if isinstance(model, GrownForest):
        return forest_predict(model, df, keep)
    p = F.col("p1")
    return positive_probability(model.transform(df)).select(
        *keep, "p1", decide(p).alias("prediction"), confidence(p).alias("confidence")
    )


# --- kernel machine and neighbours ---------------------------------------------------------


def fourier_features(
    features: list[str], gamma: float, size: int = 256, seed: int = 42
) -> Column:
    """Random Fourier features of the RBF kernel, one matrix product per Arrow batch."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, math.sqrt(2.0 * gamma), (len(features), size))
    shifts = rng.uniform(0.0, 2.0 * math.pi, size)

    @F.pandas_udf("array<double>")
    def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, len(features)))
            yield pd.Series(list(np.cos(x @ directions + shifts) * math.sqrt(2.0 / size)))

    return lift(F.array(*[F.col(c).cast("double") for c in features]))


def rbf_svm(
    train: DataFrame, test: DataFrame, features: list[str], target: str, keep: list[str],
    c: float = 1.0, size: int = 128, max_iter: int = 100, folds: int = 3, seed: int = 42,
) -> DataFrame:
    """RBF-kernel SVM scores with calibrated probabilities.

    γ is 1 / (columns · variance of all values); the kernel is approximated by random Fourier
    features. The margin is calibrated by a one-variable logistic fit on rows that the margin's own
    fit has not seen, fold by fold. Gaps in features are filled by training means.
    """
    inputs, spread = fit_inputs(train, features, target)
    k, n = len(features), max(1, sum(spread.classes.values()))
    centre = sum(mean for _, mean, _ in spread.features) / k
    variance = sum(squares / max(1, seen) + (mean - centre) ** 2
                   for seen, mean, squares in spread.features) / k
    gamma = 1.0 / (k * variance) if variance > 0 else 1.0

    def lifted(df):
        return apply_inputs(df, inputs, features).withColumn(
            "lifted", array_to_vector(fourier_features(features, gamma, size, seed)))

    rows = lifted(gathered(train, n)).select("lifted", F.col(target).cast("double").alias("_y"), F.pmod(
        F.xxhash64("lifted", F.lit(seed)), F.lit(folds)).alias("_fold"))
    rows = cut_lineage(rows.filter("_y is not null"))

    def margin(fit_on, df):
        model = LinearSVC(featuresCol="lifted", labelCol="_y", maxIter=max_iter, tol=1e-3,
                          regParam=1.0 / (c * n)).fit(fit_on)
        return model.transform(df).withColumn(
            "margin", array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1)))

    def unseen_by(fold):
        held, rest = rows.filter(F.col("_fold") == fold), rows.filter(F.col("_fold") != fold)
        if held.isEmpty() or rest.select("_y").distinct().count() < 2:
            return None
        return margin(rest, held).select("_y", "margin")

    with ThreadPoolExecutor(folds + 1) as pool:  # a fit is hundreds of short jobs: these share the cluster
        whole = pool.submit(lambda: margin(rows, lifted(test)).select(*keep, "margin"))
        parts = [part for part in pool.map(unseen_by, range(folds)) if part is not None]
    unseen = reduce(DataFrame.unionByName, parts or [margin(rows, rows).select("_y", "margin")])
    calibrated = LogisticRegression(
        featuresCol="margin", labelCol="_y", rawPredictionCol="_raw", probabilityCol="_prob",
        predictionCol="_pred").fit(gathered(unseen, n))
    scored = calibrated.transform(whole.result())
    p = F.col("p1")
    return scored.withColumn("p1", vector_to_array("_prob")[1]).select(
        *keep, "p1", decide(p).alias("prediction"), confidence(p).alias("confidence")
    )


def compare_models(
    split: DataFrame, spaces: dict[str, list[str]], target: str, row_id: str,
    trees: int = 100, seed: int = 42,
) -> DataFrame:
    """Four classifiers on every feature space over one split; one metrics row each.

    ``split`` has the features, the target, the row id and a 'split' column.
    """
    split = cut_lineage(gathered(split, split.count()))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    keep = [row_id, target]
    scored = None
    for space, features in spaces.items():
        vec = lambda df: df.select(*keep, F.array(*[F.col(c) for c in features]).alias("v"))
        neighbours = knn_classify(vec(test), vec(train), row_id, "v", target, 5)
        runs = {
            "Random Forest": predict(
                random_forest(train, features, target, trees=trees, balanced=False, seed=seed),
                test, keep),
            "SVM": rbf_svm(train, test, features, target, keep, seed=seed),
            "Logistic Regression": predict(
                logistic_regression(train, features, target), test, keep),
            "KNN": test.select(*keep).join(neighbours, row_id).select(
                *keep, "p1", decide(F.col("p1")).alias("prediction"),
                confidence(F.col("p1")).alias("confidence")),
        }
        for name, df in runs.items():
            part = df.withColumn("model", F.lit(name)).withColumn("space", F.lit(space))
            scored = part if scored is None else scored.unionByName(part)
    return evaluate_scores(scored, target, "prediction", "p1", ["model", "space"])


# --- search over settings ------------------------------------------------------------------


#: Effort of the rungs of a forest's trial, in shares of its trees.
RUNGS = (1 / 3, 1.0)


def hyperparameter_search(
    train: DataFrame, validate: DataFrame, features: list[str], target: str, space: dict,
    n_trials: int = 20, parallel: int = 4, rungs: tuple[float, ...] = RUNGS, seed: int = 42,
) -> DataFrame:
    """One row per trial (settings as JSON, F1, ROC-AUC, its effort and whether a rung stopped it), the
    best of full effort marked.

    Settings are proposed from the trials before them, as ``operators/search.py`` says. Every trial is a
    Spark job; a few run at a time so the cluster stays busy. A rung gives a trial that share of its trees,
    which score the validation rows where they grow and never reach the driver.
    """
    trials_of = ForestTrials(train, validate, features, target)

    def evaluate(settings: dict, effort: float):
        fewer = {**settings, "trees": max(1, round(settings.get("trees", 100) * effort))}
        scored = trials_of.scores(seed=seed, **fewer).withColumn("prediction", decide(F.col("p1")))
        got = evaluate_scores(scored, target, "prediction", "p1").first()
        return got["f1"], {"f1": got["f1"], "roc_auc": got["roc_auc"]}

    trials = search(space, evaluate, n_trials, parallel, rungs, seed=seed)
    return trials_table(train.sparkSession, trials, "f1 double, roc_auc double").drop("score")


def refit_best(
    search: DataFrame, train: DataFrame, features: list[str], target: str, seed: int = 42, **named
) -> tuple[GrownForest, dict]:
    """(forest of the settings that ``hyperparameter_search`` marked, fitted on ``train``; settings)."""
    settings = json.loads(search.filter("is_best").first()["settings"])
    return grown_forest(train, features, target, seed=seed, **settings, **named), settings


# --- search over feature subsets -----------------------------------------------------------


def fold_statistics(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per held-out fold: discriminant weight of each feature from the other folds.

    Count, mean and squared deviations per class and fold come from one aggregate; the training part of
    a fold merges those of the other folds, so that columns far from zero lose no digits. Weight =
    (mean1 − mean0) / pooled within-class variance, 0 where nothing varies within the classes.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    # one row per fold and class
    groups = df.filter(F.col(target).isin(0, 1)).groupBy("fold", F.col(target).alias("y")).agg(*aggs).collect()
    rows = []
    for fold in sorted({g["fold"] for g in groups}, key=lambda f: (f is None, f)):
        rest = {y: [g for g in groups if g["fold"] != fold and g["y"] == y] for y in (0, 1)}
        if any(sum(g["n"] for g in part) < 2 for part in rest.values()):
            continue
        weights = []
        for i in range(len(features)):
            (n0, m0, q0), (n1, m1, q1) = (_merged([(g[f"n{i}"], g[f"m{i}"], g[f"v{i}"]) for g in rest[y]])
                                          for y in (0, 1))
            within, spread = q0 + q1, n0 * m0 * m0 + n1 * m1 * m1
            # rounding leaves a constant column slightly off zero
            varies = n0 and n1 and n0 + n1 > 2 and within > spread * 1e-24 and within > 0
            weights.append((m1 - m0) / (within / (n0 + n1 - 2)) if varies else 0.0)
        rows.append((fold, weights))
    fold_type = dict(df.dtypes)["fold"]
    return df.sparkSession.createDataFrame(rows, f"fold {fold_type}, w array<double>")


def _merged(parts: list[tuple]) -> tuple[int, float, float]:
    """(number, mean, squared deviations) of parts given as (number, mean, variance)."""
    n, mean, squares = 0, 0.0, 0.0
    for k, m, v in parts:
        if k:
            gap = m - mean
            squares += v * k + gap * gap * n * k / (n + k)
            mean += gap * k / (n + k)
            n += k
    return n, mean, squares


def ga_fitness(
    df: DataFrame, features: list[str], target: str, masks: list[list[int]]
) -> DataFrame:
    """Fitness of every feature mask in one job.

    Mean held-out ROC-AUC of a diagonal linear discriminant over the folds, minus
    0.01·(k/n) when more than half of the features are chosen; 0 for an empty mask.
    ``df`` has the features, the target and a 'fold' column. The masks are a population
    of a few hundred bit lists, so they travel as one literal array.
    """
    spark = df.sparkSession
    width = len(features)
    stats = fold_statistics(df, features, target)
    weight_of = F.lit(None).cast("array<double>")
    for r in stats.collect():  # one row per fold
        weight_of = F.when(
            F.col("fold") == r["fold"], F.array(*[F.lit(x) for x in r["w"]])
        ).otherwise(weight_of)
    bits = F.array(*[F.lit("".join(map(str, m))) for m in masks])
    products = df.select(
        "fold", F.col(target).alias("y"),
        F.zip_with(
            F.array(*[F.col(c).cast("double") for c in features]),
            weight_of, lambda x, w: x * w,
        ).alias("xw"),
    ).filter("xw is not null")
    terms = [
        F.when(F.substring("_m", i + 1, 1) == "1", F.get(F.col("xw"), F.lit(i))).otherwise(0.0)
        for i in range(width)
    ]
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    scored = products.select("fold", "y", "xw", F.posexplode(bits).alias("mask_id", "_m")).select(
        "mask_id", "fold", "y", score.alias("score")
    )
    aucs = plain_auc(scored, "y", "score", ["mask_id", "fold"])
    mean = aucs.groupBy("mask_id").agg(F.avg("roc_auc").alias("auc"))
    table = spark.createDataFrame(
        [(i, "".join(map(str, m)), sum(m)) for i, m in enumerate(masks)],
        "mask_id int, mask string, n_selected int",
    )
    share = F.col("n_selected") / F.lit(width)
    penalty = F.when(share > 0.5, share * 0.01).otherwise(0.0)
    return table.join(mean, "mask_id", "left").select(
        "mask_id", "mask", "n_selected",
        F.when((F.col("n_selected") == 0) | F.col("auc").isNull(), 0.0)
        .otherwise(F.col("auc") - penalty).alias("fitness"),
    )


def plain_auc(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """ROC-AUC per key without the distinct-score guard; constant scores give no row value."""
    curve = score_curve(df, label, score, keys)
    wins = F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2)
    return curve.groupBy(*keys).agg(
        F.when(
            (F.count(F.lit(1)) > 1) & (F.max("all_pos") > 0) & (F.max("all_neg") > 0),
            F.sum(wins) / F.max("all_pos") / F.max("all_neg"),
        ).alias("roc_auc")
    )


def ga_feature_select(
    df: DataFrame, features: list[str], target: str, population_size: int = 100,
    generations: int = 20, cross_prob: float = 0.8, mutate_prob: float = 0.2,
    elite_size: int = 5, tournament: int = 3, seed: int = 42,
) -> DataFrame:
    """Evolve feature masks; returns every individual of every generation with its fitness.

    One Spark job scores all new masks of a generation; known masks are not scored again.
    """
    spark = df.sparkSession
    rng = random.Random(seed)
    width = len(features)
    known: dict[tuple, float] = {}

    def score(masks):
        new = sorted({tuple(m) for m in masks} - set(known))
        if new:
            got = ga_fitness(df, features, target, [list(m) for m in new]).collect()
            for r in got:
                known[new[r["mask_id"]]] = r["fitness"]

    def ranked(masks):
        return sorted({tuple(m) for m in masks}, key=lambda m: (-known[m], m))

    population = [[rng.randint(0, 1) for _ in range(width)] for _ in range(population_size)]
    score(population)
    hall = ranked(population)[:elite_size]
    history = [(0, list(m)) for m in population]
    for generation in range(1, generations + 1):
        parents = [
            list(max(rng.sample(population, min(tournament, len(population))),
                     key=lambda m: known[tuple(m)]))
            for _ in range(population_size - len(hall))
        ]
        for one, two in zip(parents[::2], parents[1::2]):
            if rng.random() < cross_prob:
                for i in range(width):
                    if rng.random() < 0.5:
                        one[i], two[i] = two[i], one[i]
        for child in parents:
            if rng.random() < mutate_prob:
                for i in range(width):
                    if rng.random() < 0.05:
                        child[i] = 1 - child[i]
        population = parents + [list(m) for m in hall]
        score(population)
        hall = ranked([list(m) for m in hall] + population)[:elite_size]
        history += [(generation, list(m)) for m in population]
    rows = [
        (g, i, "".join(map(str, m)), sum(m), float(known[tuple(m)]))
        for i, (g, m) in enumerate(history)
    ]
    return spark.createDataFrame(
        rows,
        "generation int, individual int, mask string, n_selected int, fitness double",
    )


def retrain_selected(
    split: DataFrame, features: list[str], chosen: list[str], target: str, row_id: str,
    trees: int = 100, seed: int = 42,
) -> DataFrame:
    """All features against the chosen ones on one split: metrics and the change in percent."""
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    parts = []
    for name, cols in (("all", features), ("chosen", chosen)):
        model = random_forest(train, cols, target, trees=trees, seed=seed)
        parts.append(predict(model, test, [row_id, target]).withColumn("space", F.lit(name)))
    table = evaluate_scores(
        parts[0].unionByName(parts[1]), target, "prediction", "p1", ["space"]
    )
    return compare_to_baseline(table, F.col("space") == "all", ["accuracy", "f1", "roc_auc"])
