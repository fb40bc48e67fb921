"""Candidates tested in leaves against a plain loop, and the choice that rests on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.operators import leaves, models, selftrain


def loop(train, validate, cands, weights, trees):
    """{candidate: f1} and the F1 without any, from (id, label, tuple of leaves)."""
    def p1(rows, of):
        share = 0.0
        for t in range(trees):
            n = [sum(weights[y] for _, y, at in rows if at[t] == of[t] and y == c) for c in (0, 1)]
            share += n[1] / sum(n) if sum(n) else 0.0
        return round(share / trees, 12)

    def f1(rows):
        said = [(y, p1(rows, at) >= 0.5) for _, y, at in validate]
        tp, fp, fn = (sum(1 for y, s in said if (y, s) == k) for k in ((1, True), (0, True), (1, False)))
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    return {c[0]: f1([*train, c]) for c in cands}, f1(train)


def table(spark, rows, trees):
    return spark.createDataFrame([(i, y, t, at[t]) for i, y, at in rows for t in range(trees)],
                                 "id long, label int, tree int, leaf int").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_every_candidate_against_a_loop(spark, seed):
    rng, trees = np.random.default_rng(seed), 4
    draw = lambda n, start: [(start + i, int(rng.integers(2)), tuple(int(x) for x in rng.integers(6, size=trees)))
                             for i in range(n)]
    train, validate, cands = draw(40, 0), draw(50, 1000), draw(30, 2000)
    cands.append((5000, 1, (9, 9, 9, 9)))  # leaves without training or validation rows
    n = [sum(y == c for _, y, _ in train) for c in (0, 1)]
    weights = {c: 40 / (2 * n[c]) for c in (0, 1)}
    want, base = loop(train, validate, cands, weights, trees)
    got = leaves.candidate_f1(*(table(spark, r, trees) for r in (train, validate, cands)), "id", "label").collect()
    assert len(got) == len(cands)
    assert {r.id: r.f1 for r in got} == pytest.approx(want)
    assert got[0].base_f1 == pytest.approx(base)
    assert len(set(want.values())) > 2


def test_choice_takes_rows_that_keep_quality_first(spark):
    rows = [(i, 1 - i / 100, 1) for i in range(20)]
    scored = spark.createDataFrame(rows, "id long, confidence double, prediction int")
    keeps = lambda cands: cands.filter("id % 2 = 1").select("id")
    got = selftrain.select_beneficial(scored, "id", 6, 0.5, keeps).orderBy("rank")
    # of the 12 most confident, the odd ones pass; nothing else is needed
    assert [r.id for r in got.collect()] == [1, 3, 5, 7, 9, 11]
    got = selftrain.select_beneficial(scored, "id", 8, 0.5, lambda c: c.filter("id = 9").select("id"))
    assert {r.id for r in got.collect()} == {0, 1, 2, 3, 4, 5, 6, 9}
    assert selftrain.select_beneficial(scored, "id", 30, 0.5, keeps).count() == 20


def test_leaves_of_a_forest_hold_its_training_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal() + (i % 2)), float(rng.normal()), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    forest = models.random_forest(df, ["a", "b"], "label", trees=5, max_depth=4)
    found = leaves.forest_leaves(forest, df, ["id", "label"])
    assert found.count() == 1000 and found.groupBy("id").agg(F.countDistinct("tree").alias("n")).filter("n <> 5").count() == 0
    counts = leaves.leaf_counts(found, "label", {0: 1.0, 1: 1.0})
    assert counts.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] == 1000
    keeps = selftrain.forest_quality_test(forest, df.filter("id < 120"), df.filter("id between 120 and 159"),
                                          df.filter("id >= 160"), "label", "id")
    cands = df.filter("id >= 160").select("id", F.col("label").alias("prediction"))
    passed = keeps(cands)
    assert 0 < passed.count() <= 40 and passed.count() == passed.distinct().count()
