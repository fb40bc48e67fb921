"""No row is lost to a null key, a gap or an odd shape, and streams read tables of many files."""

import json

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_splits_keep_rows_without_a_target(spark):
    from halflight.operators import sample

    df = spark.range(100).select(
        "id", F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("label"))
    assert sample.stratified_split(df, "label", "id").count() == 100
    folds = sample.stratified_folds(df, "label", "id", 4)
    assert folds.count() == 100 and folds.groupBy("label", "fold").count().count() == 12
    assert sample.train_val_test_split(df, "label", "id").count() == 100


def test_metrics_of_a_run_without_a_name(spark):
    from halflight.operators import evaluate, profile

    rows = [(None if n % 2 else "a", n / 40, int(n % 3 == 0)) for n in range(40)]
    df = spark.createDataFrame(rows, "run string, p1 double, label int").withColumn(
        "prediction", (F.col("p1") > 0.5).cast("int"))
    got = evaluate.evaluate_scores(df, "label", "prediction", "p1", ["run"]).collect()
    assert {r.run for r in got} == {None, "a"} and all(r.roc_auc is not None for r in got)
    tagged = df.select("run", F.col("p1").alias("value"), F.col("label").alias("a"))
    assert {r.run for r in profile.ks_from_tagged(tagged, ["run"]).collect()} == {None, "a"}


def test_models_score_rows_with_gaps(spark):
    from halflight.operators import models

    rows = [(n, float(n) if n % 4 else None, float("nan") if n % 7 == 0 else float(n % 3),
             float("inf") if n == 5 else None, int(n > 20)) for n in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    for model in (models.random_forest(df, ["a", "b", "c"], "label", trees=3),
                  models.logistic_regression(df, ["a", "b", "c"], "label", clip=2.0, scale=True)):
        got = models.predict(model, df, ["id"])
        assert got.count() == 40 and got.filter("p1 is null or isnan(p1)").count() == 0


def test_fitted_inputs_use_training_numbers(spark):
    from halflight.operators import models

    train = spark.createDataFrame([(float(x), x % 2) for x in range(11)] + [(None, 1)], "a double, y int")
    inputs, spread = models.fit_inputs(train, ["a"], "y", clip=1.0, scale=False)
    other = spark.createDataFrame([(None,), (100.0,), (-100.0,), (5.5,)], "a double")
    got = [r.a for r in models.apply_inputs(other, inputs, ["a"]).collect()]
    reach = 11 ** 0.5  # sample deviation of 0 to 10
    assert got == pytest.approx([5.0, 5 + reach, 5 - reach, 5.5]) and spread.classes == {0: 6, 1: 6}
    scaled, _ = models.fit_inputs(train, ["a"], "y", scale=True)
    row = models.apply_inputs(train, scaled, ["a"]).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(row[0]) < 1e-12


def test_every_request_is_answered(spark):
    from halflight.sources.tables import request_batch

    rows = [(1, ["a"] * 101), (2, []), (3, None), (4, ["x", "y"]), (5, ["a"] * 100)]
    items, errors = request_batch(spark.createDataFrame(rows, "id long, molecules array<string>"), "molecules")
    assert items.groupBy("id").count().orderBy("id").collect() == [(4, 2), (5, 100)]
    assert {(r.id, r.n_items) for r in errors.collect()} == {(1, 101), (2, 0), (3, 0)}


def test_csv_keeps_line_breaks_quotes_and_empty_texts(spark, tmp_path):
    from halflight.sources.tables import read_table, write_table

    rows = [(1, 'two\nlines, "quoted"'), (2, "  blanks  "), (3, ""), (4, None), (5, "back\\slash\r\n\"")]
    df = spark.createDataFrame(rows, "id long, text string")
    write_table(df, str(tmp_path / "t.csv"), "csv")
    got = read_table(spark, str(tmp_path / "t.csv"), df.schema).collect()
    assert {r.id: r.text for r in got} == dict(rows)


def test_box_summary_of_a_column_without_values(spark):
    from halflight.operators.profile import box_summary

    df = spark.createDataFrame([(1.0, None), (2.0, None), (30.0, None)], "a double, b double")
    got = {r.feature: r for r in box_summary(df, ["a", "b"]).collect()}
    assert got["b"].q1 is None and got["a"].median == 2.0


def test_nearest_of_many_centres(spark, monkeypatch):
    from halflight.operators import domain

    monkeypatch.setattr(domain, "CENTRE_BLOCK", 400)
    centres = spark.range(1001).select(
        F.col("id").cast("int").alias("centre_id"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("centre"))
    df = spark.createDataFrame([(1, [0.2, 1.0]), (2, [999.6, 0.0]), (3, [500.5, 0.0]), (4, None)],
                               "id long, v array<double>")
    got = {r.id: (r.centre_id, r.dist) for r in domain.nearest_centroid(df, "v", centres).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [0, 1000, 500, None] and got[4][1] is None
    assert domain.nearest_centroid(df, "v", centres.limit(0)).count() == 4


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_a_folder_of_files(spark, tmp_path, files):
    from halflight.streaming import monitor

    path = str(tmp_path / "events.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(files).write.parquet(path)
    got = monitor.run_to_table(monitor.read_log_stream(spark, path, events.schema), "events")
    assert got.count() == events.count()


def test_drift_ignores_missing_values(spark):
    from halflight.streaming import monitor

    train = spark.createDataFrame([(1.0,)] * 100, "x double")
    serving = spark.createDataFrame(
        [("w", 1.0)] * 100 + [("w", None)] * 100 + [("w", float("nan"))] * 5 + [(None, 1.0)], "w string, x double")
    got = {r.w: r.d for r in monitor.drift_score(train, serving, "x", "w").collect()}
    assert got == {"w": 0.0, None: 0.0}


def test_co_training_metrics(spark):
    from halflight.operators import selftrain

    df = spark.range(60).select("id", (F.col("id") % 10).cast("double").alias("a"),
                                (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    train, pool = df.filter("id < 30"), df.filter("id >= 30").drop("y")
    models, pseudo = selftrain.co_training(train, pool, ["a"], ["b"], "y", "id", threshold=0.6, max_iter=2, trees=5)
    row = selftrain.co_training_metrics(models, df.filter("id >= 30"), "y", "id").first()
    assert row.n == 30 and row.accuracy > 0.7 and pseudo.count() == pseudo.select("id").distinct().count()


def test_sweep_runs_all_methods_over_clipped_sizes(spark):
    from halflight.operators import selftrain

    df = spark.range(80).select("id", (F.col("id") % 10).cast("double").alias("a"),
                                (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    pool = df.filter("id >= 40").drop("y").withColumn("position", F.col("id") - 39)
    got = selftrain.unlabelled_size_sweep(
        df.filter("id < 20"), df.filter("id between 20 and 39"), pool, ["a", "b"], "y", "id", [0, 10, 500, 1000],
        (["a"], ["b"]), trees=5, max_iter=2, co_rounds=2).collect()
    assert sorted((r.method, r.n_unlabeled) for r in got) == sorted(
        (m, n) for m in selftrain.METHODS for n in (0, 10, 40))
    assert all(r.n == 20 and r.final_train_size == 20 + r.n_pseudo_labeled for r in got)


def test_learning_queries_run_full_rounds_and_sizes(spark, monkeypatch):
    from halflight.suite import learning

    class Stop(Exception):
        pass

    def seen(*args, **named):
        raise Stop(args, named)

    df = spark.range(3).withColumnRenamed("id", "doc_id")
    monkeypatch.setattr(learning, "parts", lambda spark, sf: (df, df, df))
    for name, query in (("co_training", learning.co_training_result),
                        ("unlabelled_size_sweep", learning.unlabelled_size_sweep)):
        monkeypatch.setattr(learning.selftrain, name, seen)
        with pytest.raises(Stop) as stop:
            query(spark, "")
        args, named = stop.value.args
        assert "max_iter" not in named and named["trees"] == 100
    assert 10000 in args[6] and args[6][-1] == 30000


def test_settings_search_spans_the_space_and_stores_the_winner(spark, monkeypatch):
    from halflight.sources import models as bundles
    from halflight.suite import learning

    space = learning.FOREST_SPACE
    assert max(space["trees"]) == 200 and max(space["max_depth"]) == 30
    few = {"trees": [3], "max_depth": [1, 12], "min_leaf": [1], "subset": ["log2"]}
    asked, whole = [], learning.models.hyperparameter_search

    def small(train, validate, features, target, given, n):
        asked.append((given, n))
        return whole(train, validate, features, target, few, 4)

    monkeypatch.setattr(learning.models, "hyperparameter_search", small)
    rows = learning.hyperparameter_search(spark, SF).collect()
    assert asked == [(space, 20)] and len(rows) == 4
    best, = [r for r in rows if r.is_best]
    model, info = bundles.load_model(spark, best.best_model)
    settings = json.loads(best.settings)
    forest = model.stages[-1]
    assert forest.getNumTrees == 3 and forest.getOrDefault("maxDepth") == settings["max_depth"]
    assert set(info.first()["metrics"]) == {"f1", "roc_auc"}
    assert models_score(model, spark) > 0


def models_score(model, spark):
    from halflight.operators.models import predict
    from halflight.suite.base import pool_docs

    return predict(model, pool_docs(spark, SF), ["doc_id"]).count()
