"""Proposals against random draws, rungs, and statistics of the genetic search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.operators import models
from halflight.operators.search import best_trial, propose, search, trials_table

SPACE = {"a": (0.0, 1.0), "b": (0.001, 0.5, "log"), "c": ["x", "y", "z"], "d": [1, 2, 3, 4]}


def hill(s, effort=1.0):
    """Highest, 1, at a = 0.7, b = 0.02, c = y and d = 3."""
    far = (s["a"] - 0.7) ** 2 * 4 + (math.log(s["b"] / 0.02) / 3) ** 2
    score = math.exp(-far) - 0.3 * (s["c"] != "y") - 0.1 * abs(s["d"] - 3)
    return score - 0.2 * (1 - effort), {"far": far}


@pytest.mark.parametrize("n", [20, 50])
def test_guided_trials_beat_random_draws_at_equal_budget(n):
    best = lambda guided, seed: best_trial(search(SPACE, hill, n, seed=seed, guided=guided)).score
    guided, random = ([best(g, seed) for seed in range(20)] for g in (True, False))
    assert np.mean(guided) > np.mean(random) + 0.02
    assert sum(a >= b for a, b in zip(guided, random)) >= 12


def test_same_seed_same_trials_inside_the_space():
    one, two = (search(SPACE, hill, 30, parallel=3, seed=5) for _ in range(2))
    assert one == two and [t.number for t in one] == list(range(30))
    for t in one:
        s = t.settings
        assert 0 <= s["a"] <= 1 and 0.001 <= s["b"] <= 0.5 and s["c"] in "xyz" and s["d"] in (1, 2, 3, 4)


def test_rungs_stop_the_worse_trials():
    spent = []

    def costly(settings, effort):
        spent.append(effort)
        return hill(settings, effort)

    trials = search(SPACE, costly, 24, rungs=(0.25, 1.0), seed=1)
    stopped = [t for t in trials if t.stopped]
    assert 3 <= len(stopped) <= 18 and {t.effort for t in stopped} == {0.25}
    assert spent.count(0.25) == 24 and spent.count(1.0) == 24 - len(stopped)
    assert best_trial(trials).score == max(t.score for t in trials if not t.stopped)
    with pytest.raises(ValueError):
        search(SPACE, hill, 2, rungs=(0.5,))


def test_a_choice_that_always_wins_is_proposed():
    import random

    finished = [({"c": c}, float(c == "y")) for c in "xyz" * 6]
    picks = [propose({"c": ["x", "y", "z"]}, finished, random.Random(i))["c"] for i in range(20)]
    assert picks.count("y") == 20


def test_table_marks_the_best_of_full_effort(spark):
    trials = search(SPACE, hill, 12, rungs=(0.5, 1.0), seed=3)
    rows = trials_table(spark, trials, "far double").collect()
    assert len(rows) == 12 and [r.trial for r in rows if r.is_best] == [best_trial(trials).number]
    assert not any(r.stopped for r in rows if r.is_best)


def test_forest_search_stores_settings_of_the_space(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal() + (i % 2)), float(rng.normal()), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, label int").repartition(1).cache()
    space = {"trees": [3, 6], "max_depth": [2, 3], "subset": ["sqrt", "log2"]}
    got = models.hyperparameter_search(df, df, ["a", "b"], "label", space, 7, parallel=3)
    assert got.count() == 7 and got.filter("is_best").count() == 1
    assert got.filter("f1 is null or roc_auc is null").count() == 0
    _, settings = models.refit_best(got, df, ["a", "b"], "label")
    assert set(settings) == set(space)


def test_a_column_far_from_zero_separates_as_well(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal() + 3 * (i % 2)), i % 2, i % 4 // 2) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, label int, fold int")
    far = df.withColumn("x", F.col("x") + 1e9)
    near_fit, far_fit = (models.ga_fitness(d, ["x"], "label", [[1]]).first().fitness for d in (df, far))
    assert near_fit > 0.9 and far_fit == pytest.approx(near_fit, abs=1e-6)
    constant = df.withColumn("x", F.lit(1e9))
    assert models.fold_statistics(constant, ["x"], "label").first().w == [0.0]


def test_semi_supervised_trials(spark):
    from halflight.operators import selftrain

    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal() + 3 * (i % 2)), float(rng.normal()), i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(1).cache()
    pool = df.filter("id >= 80").drop("label").withColumn("position", F.col("id") - 79)
    space = {"ssl_method": ["label_propagation", "self_training"], "n_unlabeled": [30, 1000],
             "lp_gamma": (0.01, 0.5, "log"), "lp_max_iter": [5, 10], "st_threshold": (0.7, 0.95), "st_max_iter": [1, 2]}
    got = selftrain.semi_supervised_search(
        df.filter("id < 40"), df.filter("id between 40 and 79"), pool, ["a", "b"], "label", "id", space, 8,
        forest={"trees": 4, "max_depth": 3}, landmarks=50).collect()
    assert len(got) == 8 and sum(r.is_best for r in got) == 1
    assert all(0 <= r.n_pseudo_labeled <= 80 and r.f1 > 0.5 for r in got)
    assert {__import__("json").loads(r.settings)["ssl_method"] for r in got} == {"label_propagation", "self_training"}
