import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.operators import evaluate, ordering, quantiles, sample, selftrain


def test_global_rank_with_a_hot_tie(spark):
    df = spark.range(3000).withColumn("s", F.when(F.col("id") % 3 == 0, 0.5).otherwise(
        F.col("id") / 3000.0))
    got = ordering.with_global_rank(df, [F.desc("s"), F.col("id")]).collect()
    want = sorted(((r.s, r.id) for r in got), key=lambda t: (-t[0], t[1]))
    assert [i for _, i in want] == [r.id for r in sorted(got, key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))


def test_running_sums_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"),
                                  F.lit(1).alias("n"))
    got = ordering.with_running_sums(df, [F.col("v")], {"c": "n"}, ["k"]).collect()
    assert all(r.c == r.v // 4 + 1 for r in got) and len(got) == 1000


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=700), np.full(500, 0.25), rng.exponential(size=301)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, ["x"], probs, direct_rows=limit)["x"]
    assert got == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / len(pos) / len(neg)


def test_auc_with_ties_and_guard(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 500), np.floor(rng.random(500) * 20) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc(y, s))
    two = df.withColumn("s", F.when(F.col("s") > 0.5, 0.9).otherwise(0.1))
    assert evaluate.roc_auc(two, "y", "s").first()[0] is None


def test_split_is_stratified_and_stable(spark):
    df = spark.range(997).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    one = sample.stratified_split(df, "y", "id", 0.3)
    two = sample.stratified_split(df.repartition(13), "y", "id", 0.3)
    rows = lambda d: sorted((r.id, r.split) for r in d.collect())
    assert rows(one) == rows(two) and len(rows(one)) == 997
    for y in (0, 1):
        n = df.filter(F.col("y") == y).count()
        took = one.filter((F.col("y") == y) & (F.col("split") == "test")).count()
        assert took == int(0.3 * n + 0.5)


def test_balance(spark):
    df = spark.range(500).withColumn("y", (F.col("id") < 60).cast("int"))
    count = lambda d: {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    assert count(sample.downsample_majority(df, "y", "id")) == {0: 60, 1: 60}
    assert count(sample.ratio_balance(df, "y", "id")) == {0: 40, 1: 60}
    assert sample.random_subset(df, "id", 1000).count() == 500


def test_first_teacher_wins(spark):
    scored = spark.createDataFrame(
        [(1, 0.95, 0.05), (2, 0.5, 0.9), (3, 0.8, 0.2), (4, 0.1, 0.5)],
        "id int, p_first double, p_second double")
    got = selftrain.co_training_round(scored, "id").orderBy("id").collect()
    # 0.8 is not above the threshold
    assert [(r.id, r.label, r.teacher) for r in got] == [(1, 1, 1), (2, 1, 2), (4, 0, 1)]


def test_beneficial_choice_with_more_confident_rows_than_wanted(spark):
    scored = spark.createDataFrame([(i, 0.99 - i / 1000) for i in range(20)],
                                   "id int, confidence double")
    odd = lambda batch: batch.first()["id"] % 2 == 1
    got = selftrain.select_beneficial(scored, "id", 4, 0.9, odd).collect()
    assert sorted(r.id for r in got) == [1, 3, 5, 7]
    few = selftrain.select_beneficial(scored, "id", 6, 0.9, lambda b: b.first()["id"] == 9)
    assert sorted(r.id for r in few.collect()) == [0, 1, 2, 3, 4, 9]
    assert selftrain.select_beneficial(scored, "id", 50, 0.9, odd).count() == 20
