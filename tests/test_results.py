"""Arithmetic of published result rows, and tables that come back as written."""

import pytest
from pyspark.sql import functions as F

from halflight.operators import evaluate
from halflight.session import scratch_path
from halflight.sources import tables
from halflight.streaming import monitor

# method, n_unlabeled, f1, roc_auc, published composite
ROWS = [
    ("Baseline", 0, 0.7764705882352941, 0.8230706075533661, 0.7997705978943301),
    ("Label Propagation", 500, 0.75, 0.8087027914614122, 0.7793513957307061),
    ("Label Spreading", 500, 0.75, 0.8156814449917897, 0.7828407224958949),
    ("Self-Training", 1000, 0.8192771084337349, 0.8173234811165845, 0.8183002947751596),
    ("Self-Training", 5000, 0.8333333333333334, 0.811576354679803, 0.8224548440065682),
    ("Co-Training", 500, 0.8351648351648352, 0.7873563218390804, 0.8112605785019578),
]


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        ROWS, "method string, n_unlabeled long, f1 double, roc_auc double, published double")


def test_composite_and_gains(spark, results):
    scored = evaluate.with_composite(results, "half")
    assert scored.filter(F.abs(F.col("composite") - F.col("published")) > 1e-12).count() == 0
    report = evaluate.experiment_report(results, F.col("method") == "Baseline", "approval").first()
    best = report.best_model
    assert (best.method, best.n_unlabeled_used) == ("Self-Training", 5000)
    assert best.improvement_composite_pct == pytest.approx(2.84, abs=0.01)
    assert best.improvement_f1_pct == pytest.approx(7.32, abs=0.01)
    assert best.improvement_roc_pct == pytest.approx(-1.40, abs=0.01)


def test_missing_auc_rules(spark):
    row = spark.createDataFrame([(0.8, None)], "f1 double, roc_auc double")
    assert evaluate.with_composite(row, "f1").first().composite == 0.8
    assert evaluate.with_composite(row, "half").first().composite == 0.65


def test_leaderboard_ranks_ties_alike(spark, results):
    rows = evaluate.leaderboard(results, "f1", F.col("method") == "Baseline", ["f1"]).collect()
    ranks = {(r.method, r.n_unlabeled): r["rank"] for r in rows}
    assert ranks[("Co-Training", 500)] == 1 and ranks[("Label Propagation", 500)] == 5
    assert ranks[("Label Spreading", 500)] == 5


def test_dataset_versions(spark):
    base = scratch_path(spark, "t")
    assert tables.latest_version(spark, base, "d") is None
    tables.publish_dataset(spark.range(3), base, "d")
    tables.publish_dataset(spark.range(5), base, "d")
    assert tables.use_dataset(spark, base, "d:latest").count() == 5
    assert tables.use_dataset(spark, base, "d:1").count() == 3


def test_smi_lines_and_optional_table(spark):
    path = scratch_path(spark, "smi")
    spark.createDataFrame([(" CCO  64-17-5\t0",), ("c1ccccc1 71-43-2 1",), ("",)],
                          "value string").write.text(path)
    got = {tuple(r) for r in tables.read_smi(spark, path).collect()}
    assert got == {("CCO", "64-17-5", 0), ("c1ccccc1", "71-43-2", 1)}
    assert tables.read_optional(spark, path + "-none", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_optional(spark, path + "-none", "a int", required=True)


def test_retraining_decisions(spark):
    schema = "run string, ts timestamp, latency_ms double, confidence double, drift double"
    log = spark.sql("""SELECT * FROM VALUES
      ('a', timestamp'2024-01-01 00:00:00', 10D, 0.9D, 0.1D),
      ('b', timestamp'2024-01-02 00:00:00', 10D, 0.6D, 0.3D)
      AS t(run, ts, latency_ms, confidence, drift)""")
    row = monitor.retrain_decision(log, "run", "ts").first()
    assert row.decision == "retrain"
    assert row.reasons == "Low confidence: 0.6000 < 0.7, High drift: 0.3000 > 0.25"
    fine = monitor.retrain_decision(log.filter("run = 'a'"), "run", "ts").first()
    assert (fine.decision, fine.reasons) == ("healthy", "")
    empty = monitor.retrain_decision(spark.createDataFrame([], schema), "run", "ts").first()
    assert empty.decision == "none"
