"""Forests grown in tasks against plain loops and Spark's own, and texts measured over Arrow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.functions import text
from halflight.operators import evaluate, forest, models, selftrain
from halflight.plans import training
from halflight.session import scratch_path
from halflight.sources import models as bundles


def rows_of(spark, n=3000, seed=1, start=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0.3).astype(int)
    return spark.createDataFrame([(start + i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, d double, y int").repartition(3).localCheckpoint()


def jobs_of(spark, run):
    """(what ``run`` gives, Spark jobs it started)."""
    spark.sparkContext.setJobGroup("counted", "counted")
    out = run()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(found)


def test_a_tree_takes_the_best_cut_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(0, forest.BINS, (3, 400)).astype(np.uint8)
    y = ((x[1] > 11) ^ (rng.random(400) < 0.1)).astype(np.intp)
    plan = forest.Plan([0, 1, 2], 1, 1, 5, 3, np.array([1.0, 2.0]), 7)
    tree = forest.grow_tree(x, y, 2, plan, np.random.default_rng(5))
    times = np.random.default_rng(5).poisson(1.0, 400)
    w = times * plan.weights[y]

    def impurity(rows):
        whole = w[rows].sum()
        return whole - (np.bincount(y[rows], w[rows], 2) ** 2).sum() / whole

    best = min((impurity(x[f] <= b) + impurity(x[f] > b), f, b) for f in range(3) for b in range(forest.BINS - 1)
               if min(times[x[f] <= b].sum(), times[x[f] > b].sum()) >= 5)
    assert (tree.feature[0], tree.cut[0]) == best[1:] and list(tree.below) == [1, 1, 2]
    for node, rows in ((1, x[best[1]] <= best[2]), (2, x[best[1]] > best[2])):
        assert tree.p[node] == pytest.approx(w[rows & (y == 1)].sum() / w[rows].sum())
    out = np.zeros(400)
    forest.add_scores(x, [tree], out)
    assert np.allclose(out, np.where(x[best[1]] <= best[2], tree.p[1], tree.p[2]))


def test_nodes_in_groups_and_rows_in_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, forest.BINS, (2, 4000)).astype(np.uint8)
    y = (rng.random(4000) < 0.4).astype(np.intp)
    plan = forest.Plan([0, 1], 1, 30, 1, 2, np.ones(2), 7)  # every feature at every node: nothing is drawn but rows

    def scores():
        tree = forest.grow_tree(x, y, 2, plan, np.random.default_rng(5))
        out = np.zeros(4000)
        forest.add_scores(x, [tree], out)
        return out, len(tree.p)

    want, nodes = scores()
    monkeypatch.setattr(forest, "NODES", 3)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 17)
    monkeypatch.setattr(forest, "SCORED_ROWS", 100)
    got, again = scores()
    assert np.array_equal(want, got) and nodes == again > 500


def test_cuts_are_those_of_spark_where_few_values_differ(spark):
    df = spark.createDataFrame([(float(i % 5), None if i % 7 == 0 else float(i), i % 2) for i in range(100)],
                               "a double, b double, y int")
    cuts = forest.fit_cuts(df, ["a", "b"], "y")
    assert cuts.cuts[0].tolist() == [0.5, 1.5, 2.5, 3.5] and cuts.classes == {0: 50, 1: 50}
    assert len(cuts.cuts[1]) == forest.BINS - 1 and np.all(np.diff(cuts.cuts[1]) > 0)
    bins = np.bincount(forest._binned([np.zeros(85), np.arange(85.0) * 100 / 85], cuts)[1], minlength=forest.BINS)
    assert bins.min() >= 1 and bins.max() <= 6
    with pytest.raises(ValueError):
        forest.fit_cuts(df.limit(0), ["a"], "y")


def test_grown_forests_are_as_good_as_sparks(spark):
    train, test = rows_of(spark), rows_of(spark, 2000, seed=2)
    auc = {}
    for name, model in (("spark", models.random_forest(train, list("abcd"), "y", trees=40)),
                        ("grown", models.grown_forest(train, list("abcd"), "y", trees=40))):
        auc[name] = evaluate.evaluate_scores(models.predict(model, test, ["y"]), "y", "prediction", "p1").first().roc_auc
    assert auc["grown"] > auc["spark"] - 0.01 and auc["grown"] > 0.85


def test_the_same_rows_make_the_same_forest_however_they_are_dealt(spark):
    train = rows_of(spark, 500)
    fit = lambda rows: [t.p.tolist() for t in models.grown_forest(rows, list("abcd"), "y", trees=4).trees]
    assert fit(train) == fit(train.orderBy(F.desc("id")).repartition(5).localCheckpoint())


def test_two_forests_take_a_few_jobs_and_no_job_a_level(spark):
    train = rows_of(spark, 500)
    (one, two), jobs = jobs_of(spark, lambda: forest.grow_forests(train, [["a", "b"], ["c", "d"]], "y", trees=7))
    assert jobs <= 6  # two fits of Spark's forest at this depth take over twenty
    assert len(one.trees) == len(two.trees) == 7
    assert {int(f) for t in one.trees for f in t.feature[t.below != np.arange(len(t.below))]} <= {0, 1}
    both = forest.forest_scores(train, {"p": one, "q": two})
    alone = models.predict(one, train, ["id"]).withColumnRenamed("p1", "p")
    assert dict(both.select("id", "p").collect()) == dict(alone.select("id", "p").collect())


def test_co_training_fits_both_views_at_once(spark):
    train, pool = rows_of(spark, 300), rows_of(spark, 400, seed=2, start=1000).drop("y")
    run = lambda rounds: selftrain.co_training(train, pool, ["a", "b"], ["c", "d"], "y", "id", threshold=0.6,
                                               per_round=10, max_iter=rounds, trees=10)
    (_, one), few = jobs_of(spark, lambda: run(1))
    (pair, pseudo), jobs = jobs_of(spark, lambda: run(3))
    rows = pseudo.collect()
    assert {r["round"] for r in rows} == {1, 2, 3} and len({r["id"] for r in rows}) == len(rows)
    assert max(np.bincount([10 * r["round"] + r["teacher"] for r in rows])) <= 10
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in rows if r["round"] == 1)
    assert (jobs - few) / 2 <= 24  # two fits of Spark's forest alone are over thirty


def test_texts_over_arrow_equal_the_expressions(spark):
    texts = [None, "", " ", "a", "\n", "\n\n a", "é ü  é", "ÀB C9!,", "a\x0bb a\x0cb", "x y x", "\t\r\n",
             "word " * 50, "日本語 テキスト 日本語", "A1!", "z" * 3000, "one\ntwo\rthree\tone"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    want = df.select("id", *text.text_descriptors(F.col("text"))).orderBy("id").collect()
    got = training.describe_documents(df, "id")
    assert got.dtypes == df.select("id", *text.text_descriptors(F.col("text"))).dtypes
    assert [tuple(r) for r in got.orderBy("id").collect()] == [tuple(r) for r in want]


def test_blocks_of_texts_of_any_size(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["ab c" * k for k in range(40)] + [None, "", "Z 9"])
    want = text._measured(texts)
    monkeypatch.setattr(text, "MEASURED_BYTES", 50)
    got = text._measured(pa.concat_arrays([pa.array(["cut off"]), texts]).slice(1))
    assert all(want[c].equals(got[c]) for c in want)


def test_a_stored_forest_scores_as_before(spark):
    train = rows_of(spark, 600)
    model = models.grown_forest(train, list("abcd"), "y", trees=5, max_depth=15, clip=2.0, scale=True)
    path = scratch_path(spark, "bundle")
    bundles.save_model(model, path, "m", "RandomForest", "t", "y", list("abcd"), {"f1": 1.0}, spark)
    again, info = bundles.load_model(spark, path)
    score = lambda m: sorted(tuple(r) for r in models.predict(m, train, ["id"]).collect())
    assert score(again) == score(model) and info.first()["name"] == "m"
    assert again.getNumTrees == 5 and again.getOrDefault("maxDepth") == 15


def test_trees_too_large_for_the_driver_stay_a_table(spark, monkeypatch):
    train = rows_of(spark, 600)
    settings = dict(trees=9, max_depth=20, seed=3)
    small = models.grown_forest(train, list("abcd"), "y", **settings)
    monkeypatch.setattr(forest, "SMALL_BYTES", 0)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 100)
    large = models.grown_forest(train, list("abcd"), "y", **settings)
    assert isinstance(small.trees, list) and not isinstance(large.trees, list)
    path = scratch_path(spark, "large")
    bundles.save_model(large, path, "m", "RandomForest", "t", "y", list("abcd"), {}, spark)
    score = lambda m: {r.id: r.p1 for r in models.predict(m, train, ["id", "y"]).collect()}
    want = score(small)
    for model in (large, bundles.load_model(spark, path)[0]):
        assert not isinstance(model.trees, list)
        got = score(model)
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-12


def test_a_trial_has_the_scores_of_its_forest_and_collects_no_tree(spark, monkeypatch):
    train, judged = rows_of(spark, 500), rows_of(spark, 300, seed=2)
    settings = dict(trees=6, max_depth=14, min_leaf=2, subset="log2", seed=5)
    model = models.grown_forest(train, list("abcd"), "y", **settings)
    want = sorted(round(r.p1, 9) for r in models.predict(model, judged, ["id"]).collect())
    monkeypatch.setattr(forest, "_tree", None)  # nobody reads a tree back
    got = forest.ForestTrials(train, judged, list("abcd"), "y").scores(**settings)
    assert sorted(round(r.p1, 9) for r in got.collect()) == want and got.columns == ["y", "p1"]
    space = {"trees": [2], "max_depth": [3, 30]}
    assert models.hyperparameter_search(train, judged, list("abcd"), "y", space, 4).count() == 4


def test_a_round_of_self_training_is_a_few_jobs_over_rows_written_once(spark):
    train, pool = rows_of(spark, 300), rows_of(spark, 600, seed=2, start=1000).drop("y")
    run = lambda rounds: selftrain.self_training(train, pool, list("abcd"), "y", "id", 0.85, rounds, trees=10)
    (_, one), few = jobs_of(spark, lambda: run(1))
    (model, pseudo), jobs = jobs_of(spark, lambda: run(3))
    rows = pseudo.collect()
    assert {r["round"] for r in rows} == {1, 2, 3} and len({r["id"] for r in rows}) == len(rows)
    assert all(r["confidence"] > 0.85 for r in rows)
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in rows if r["round"] == 1)
    assert (jobs - few) / 2 <= 12  # a fit of Spark's forest alone is over fifteen


def watched_fits(monkeypatch, name):
    """Rows of every fit that ``selftrain`` starts by this name."""
    seen, fit = [], getattr(selftrain, name)

    def counted(rows, *args, **named):
        seen.append(rows.count())
        return fit(rows, *args, **named)

    monkeypatch.setattr(selftrain, name, counted)
    return seen


def test_trials_start_from_one_forest_of_the_labelled_rows(spark, monkeypatch):
    df = rows_of(spark, 400)
    pool = df.filter("id >= 200").drop("y").withColumn("position", F.col("id") - 199)
    seen = watched_fits(monkeypatch, "grown_forest")
    space = {"ssl_method": ["self_training"], "n_unlabeled": [50, 200], "st_threshold": (0.6, 0.7), "st_max_iter": [1, 2]}
    got = selftrain.semi_supervised_search(df.filter("id < 120"), df.filter("id between 120 and 199"), pool, list("abcd"),
                                           "y", "id", space, 3, forest={"trees": 4, "max_depth": 4}).collect()
    assert len(got) == 3 and all(r.n_pseudo_labeled > 0 for r in got)
    assert seen.count(120) == 1 and len(seen) > 3


def test_sizes_of_a_sweep_start_from_the_same_models(spark, monkeypatch):
    df = rows_of(spark, 300)
    pool = df.filter("id >= 150").drop("y").withColumn("position", F.col("id") - 149)
    alone, both = watched_fits(monkeypatch, "grown_forest"), watched_fits(monkeypatch, "grow_forests")
    got = selftrain.unlabelled_size_sweep(
        df.filter("id < 100"), df.filter("id between 100 and 149"), pool, list("abcd"), "y", "id", [0, 40, 150],
        (["a", "b"], ["c", "d"]), methods=("Self-Training", "Co-Training"), threshold=0.6, trees=4, max_iter=1, co_rounds=1).collect()
    assert len(got) == 6 and all(r.n_pseudo_labeled > 0 for r in got if r.n_unlabeled)
    assert alone.count(100) == 1 and both.count(100) == 1 and len(alone) == len(both) == 3


def test_trees_grown_together_are_trees(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, forest.BINS, (3, 2000)).astype(np.uint8)
    y = ((x[0] > 9) ^ (x[2] > 20)).astype(np.intp)
    plan = forest.Plan([0, 1, 2], 1, 8, 1, 2, np.ones(2), 7)
    trees = forest.grow_trees(x, y, 2, plan, np.random.default_rng(5), 4)
    for tree in trees:
        inner = np.flatnonzero(tree.below != np.arange(len(tree.below)))
        assert sorted([0, *tree.below[inner], *(tree.below[inner] + 1)]) == list(range(len(tree.below)))
        out = np.zeros(2000)
        forest.add_scores(x, [tree], out)
        assert ((out > 0.5) == y).mean() > 0.95
