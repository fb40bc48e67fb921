"""Publishing after a crash and by two at once, logs without a run, ids of any type."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.operators import graph
from halflight.session import scratch_path
from halflight.sources import tables
from halflight.streaming.monitor import retrain_decision


def test_a_run_that_died_half_way_blocks_nobody(spark):
    base, df = scratch_path(spark, "published"), spark.range(3)
    assert tables.publish_dataset(df, base, "a") == 1
    df.write.parquet(f"{base}/a/data/half")  # data without a number
    assert tables.claim(spark, f"{base}/a/claims/2")  # a number without a log row
    assert tables.latest_version(spark, base, "a") == 1
    assert tables.publish_dataset(spark.range(5), base, "a") == 3
    assert tables.use_dataset(spark, base, "a:latest").count() == 5
    assert tables.use_dataset(spark, base, "a:1").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.use_dataset(spark, base, "a:2")


def test_two_writers_at_once_get_two_versions(spark):
    base = scratch_path(spark, "published")
    with ThreadPoolExecutor(4) as threads:
        got = list(threads.map(lambda n: tables.publish_dataset(spark.range(n), base, "b"), (1, 2, 3, 4)))
    assert sorted(got) == [1, 2, 3, 4]
    assert [tables.use_dataset(spark, base, f"b:{v}").count() for v in got] == [1, 2, 3, 4]
    assert tables.use_dataset(spark, base, "b").count() == 1 + got.index(4)


def test_decision_on_a_newest_run_without_a_name(spark):
    rows = [("a", 1, 0.9, 0.1, 5.0), (None, 2, 0.1, 0.9, 5.0)]
    log = spark.createDataFrame(rows, "run string, ts int, confidence double, drift double, latency_ms double")
    row = retrain_decision(log, "run", "ts").first()
    assert row.decision == "retrain" and row.n == 1
    assert retrain_decision(log.limit(0), "run", "ts").first().decision == "none"


def test_neighbours_of_rows_with_names(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    x[7] = x[6]
    rows = [(f"r{i:02d}", i, [float(a) for a in r], i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, id long, v array<double>, y int")
    named = graph.knn_edges(df, "name", "v", 3).select("src", "dst", "dist")
    plain = graph.knn_edges(df, "id", "v", 3)
    at = lambda c: F.concat(F.lit("r"), F.lpad(F.col(c).cast("string"), 2, "0")).alias(c)
    assert sorted(named.collect()) == sorted(plain.select(at("src"), at("dst"), "dist").collect())
    votes = graph.knn_classify(df.filter("id < 10"), df.filter("id >= 10"), "name", "v", "y", 3)
    assert votes.count() == 10 and dict(votes.dtypes)["name"] == "string"
    nodes = df.select(F.col("name").alias("id"), "v", F.when(F.col("id") < 2, F.col("y")).alias("label"))
    edges = graph.rbf_edges(nodes, "id", "v", 0.5, 5, include_self=True)
    assert graph.label_propagation(nodes, edges, 20).count() == 40
