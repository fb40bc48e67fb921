"""Queries of every area against their SQL on the smallest tables."""

import pytest
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # the smallest log has no slow request
NAMES = [
    "read_smi", "request_batch", "versioned_dataset", "feature_metadata", "median_impute",
    "clip_outliers", "split_valid_invalid", "dedupe_by_key", "nearest_centroid", "describe",
    "crosstab", "histogram", "ks_two_sample", "ratio_balance", "train_val_test_split",
    "stratified_folds", "classification_metrics", "best_per_method", "experiment_report",
    "score_complete", "hetero_and_halogen_counts", "reason_list", "featurize", "knn_edges",
    "label_propagation", "label_spreading_rbf", "uncertainty_order", "ga_fitness",
    "applicability_domain", "monitor_window", "drift_score",
    "process_enhanced",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    import __spark_entry__ as entry

    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_latency_alerts_from_a_stream(spark):
    import __spark_entry__ as entry

    got = entry.queries()["latency_alerts"](spark, LARGER)
    assert compare(got, connect(LARGER), entry.oracle_sql()["latency_alerts"]) is None


def test_every_query_has_a_function_and_the_flagship_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).first()
    assert row.n > 0 and 0 <= row.f1 <= 1


def test_pseudo_labels_come_from_the_pool_once(spark):
    from halflight.functions.text import VIEW_SIZE, VIEW_STYLE
    from halflight.operators import selftrain
    from halflight.suite.learning import parts

    train, _, pool = parts(spark, SF)
    _, pseudo = selftrain.co_training(train, pool, VIEW_SIZE, VIEW_STYLE, "label", "doc_id",
                                      per_round=20, max_iter=2, trees=5, max_depth=4)
    assert pseudo.join(train, "doc_id").count() == 0
    assert pseudo.count() == pseudo.select("doc_id").distinct().count()
    per_round = {r["round"]: r["count"] for r in pseudo.groupBy("round").count().collect()}
    assert all(n <= 40 for n in per_round.values())
