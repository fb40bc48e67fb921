"""Steps whose cost a review measured: same results, less work."""

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from halflight.operators import clusters, graph, models
from halflight.plans import training


def noisy_rows(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame(
        [(i, *map(float, x[i]), int(y[i])) for i in range(n)], "id int, a double, b double, c double, y int")


def test_a_forest_keeps_the_node_of_each_row(spark):
    rows = noisy_rows(spark).repartition(3).localCheckpoint()
    model = models.random_forest(rows, ["a", "b", "c"], "y", trees=6, max_depth=6)
    forest = model.stages[-1]
    assert forest.getCacheNodeIds()
    weighed = models.with_class_weight(rows.withColumn("_y", F.col("y").cast("double")), "y", "_weight")
    made = model.stages[1].transform(model.stages[0].transform(weighed))
    plain = models.RandomForestClassifier(
        labelCol="_y", weightCol="_weight", numTrees=6, maxDepth=6, featureSubsetStrategy="sqrt", seed=42).fit(made)
    assert plain.toDebugString.split("\n")[1:] == forest.toDebugString.split("\n")[1:]


def test_a_row_is_sent_to_blocks_and_not_to_cells():
    x = np.random.default_rng(3).normal(size=(4000, 24))  # nothing that cells could rule out
    pivots = x[:math.ceil(math.sqrt(len(x)))]
    cell = graph._squared(x, pivots).argmin(1)
    r = np.sqrt(np.square(x - pivots[cell]).sum(1))
    cells = {c: {"n": int((cell == c).sum()), "rmin": r[cell == c].min(), "rmax": r[cell == c].max(),
                 "radii": sorted(r[cell == c])[:9]} for c in set(cell.tolist())}
    first, cuts = graph._packed(pivots, {c: v["n"] for c, v in cells.items()}, 800)
    send = graph._sender(graph._router(pivots, cells, 8), first, cuts)
    rows = next(send([pd.DataFrame({"id": range(100), "v": list(x[:100])})]))
    reached = np.unpackbits(np.frombuffer(b"".join(rows["near"]), np.uint8).reshape(100, -1), axis=1).sum(1)
    assert reached.mean() > 40 and max(map(len, rows["blocks"])) <= 8
    packed = np.bincount(first[cell], minlength=1)
    assert packed.sum() == 4000 and packed.max() <= 800


def test_neighbours_in_folds_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12))
    x[700:1000] = x[3]  # ties over the edge of k
    x[5, 0] = np.inf  # no neighbour of any row
    ids = np.arange(1500) * 2
    got = graph.knn_edges(spark.createDataFrame(
        [(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, v array<double>"), "id", "v", 5)
    mine = {}
    for row in got.orderBy("src", "dist", "dst").collect():
        mine.setdefault(row.src // 2, []).append(row.dst // 2)
    for i in [0, 3, 4, 699, 700, 999, 1499]:
        gaps = np.sqrt(np.square(x - x[i]).sum(1))
        want = sorted((g, j) for j, g in enumerate(gaps) if j != i and np.isfinite(g))[:5]
        assert mine[i] == [j for _, j in want]
    assert 5 not in {j for found in mine.values() for j in found}


def test_a_pass_of_kmeans_has_the_rows_of_one_part_in_all_tasks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(900, 3))
    rows = spark.createDataFrame([([float(a) for a in v],) for v in x], "v array<double>").coalesce(1)
    dealt = []
    assigned = clusters._assigned

    def seen(rows, shift, places):
        sizes = rows.rdd.map(lambda r: len(r["row"]) // 8).glom().map(sum).collect()
        dealt.append(sizes)
        return assigned(rows, shift, places)

    monkeypatch.setattr(clusters, "_assigned", seen)
    runs = clusters.cluster_runs(rows.select(array_to_vector("v").alias("features")), ks=range(2, 4), seedings=2, rounds=2)
    assert all(sum(sizes) == 900 and max(sizes) < 450 for sizes in dealt)
    for run in runs:
        gaps = np.square(x[:, None] - np.array(run.centres)[None]).sum(2)
        assert abs(run.inertia - gaps.min(1).sum()) < 1e-6


def test_preparing_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, "a b " * (i % 5 + 1), int(i % 3 == 0), 0) for i in range(60)],
                                 "id int, text string, toxic int, low int")
    out = training.prepare_labelled(rows, "id", "text", clean("text"), ["toxic", "low"], [F.length("text").alias("n")])
    found = {(r["id"], r["label"], r["n"]) for r in out.collect()}
    assert len(found) == 40 and all(n == 4 * (i % 5 + 1) and label == (i % 3 == 0) for i, label, n in found)
    assert read.value <= 120


def test_fits_read_few_partitions_whatever_their_rows_came_in(spark, monkeypatch):
    seen = []

    def watched(model):
        class Watched(model):
            def fit(self, rows, *args):
                seen.append(rows.rdd.getNumPartitions())
                return super().fit(rows, *args)
        return Watched

    for name in ("LinearSVC", "LogisticRegression", "Pipeline"):
        monkeypatch.setattr(models, name, watched(getattr(models, name)))
    rows, few = noisy_rows(spark), spark.sparkContext.defaultParallelism
    many = rows.repartition(5 * few, "id").localCheckpoint()
    scores = [{r.id: r.p1 for r in models.rbf_svm(part, rows, ["a", "b"], "y", ["id"], max_iter=20).collect()}
              for part in (many, rows.coalesce(1).localCheckpoint())]
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 0.02
    split = many.withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    got = models.compare_models(split, {"two": ["a", "b"]}, "y", "id", trees=3)
    assert sorted(r.model for r in got.collect()) == ["KNN", "Logistic Regression", "Random Forest", "SVM"]
    assert len(seen) == 18 and max(seen) <= few
