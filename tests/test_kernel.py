"""Propagation over the whole kernel against plain matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.operators import kernel


def nodes(spark, n=60, seed=8):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n // 2, 2)), rng.normal(size=(n // 2, 2)) + 4])
    x[5] = x[4]  # equal rows
    labels = {0: 0, 3: 0, n // 2: 1, n - 1: 1}
    rows = [(f"r{i:03d}", [float(a) for a in r], labels.get(i)) for i, r in enumerate(x)]
    y = np.zeros((n, 2))
    for i, c in labels.items():
        y[i, c] = 1.0
    return x, y, sorted(labels), spark.createDataFrame(rows, "id string, v array<double>, label int").repartition(3)


def full(x, gamma):
    return np.exp(-gamma * np.square(x[:, None] - x[None]).sum(2))


def rounds(k, y, known, method, alpha, max_iter, tolerance):
    f, n = y.copy(), 0
    if method == "spreading":
        k = k - np.eye(len(k))
        side = np.sqrt(k.sum(0))
        k = k / side[:, None] / side[None]
    for n in range(1, max_iter + 1):
        new = k @ f
        if method == "propagation":
            new /= new.sum(1, keepdims=True)
            new[known] = y[known]
        else:
            new = alpha * new + (1 - alpha) * y
        moved, f = np.abs(new - f).sum(), new
        if tolerance is not None and moved < tolerance:
            break
    return f / f.sum(1, keepdims=True), f


@pytest.mark.parametrize("method, tolerance", [
    ("propagation", None), ("propagation", 1e-3), ("spreading", None), ("spreading", 1e-3)])
def test_all_landmarks_equal_the_kernel_of_all_pairs(spark, method, tolerance):
    x, y, known, df = nodes(spark)
    out, model = kernel.kernel_learn(df, method, 0.5, len(x), 0.6, 40, tolerance)
    want, state = rounds(full(x, 0.5), y, known, method, 0.6, 40, tolerance)
    got = np.array([(r.f0, r.f1) for r in out.orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-7)
    new = np.array([[0.5, 0.5], [4.0, 3.0], [1e4, 1e4]])
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(new)], "i int, v array<double>")
    p = [r.p for r in frame.select("i", kernel.kernel_predict(F.col("v"), model).alias("p")).orderBy("i").collect()]
    share = np.exp(-0.5 * np.square(new[:2, None] - x[None]).sum(2)) @ state
    assert np.allclose(p[:2], share[:, 1] / share.sum(1), atol=1e-6) and p[2] == 0.5


def test_few_landmarks_separate_two_groups_and_tell_their_error(spark):
    x, _, _, df = nodes(spark, 400)
    graph = kernel.kernel_graph(df, 0.5, 60)
    error = kernel.kernel_error(df, graph, 400)
    phi = graph.lift(x)
    gap = np.abs(phi @ phi.T - full(x, 0.5)).max()
    assert error["largest"] == pytest.approx(gap) and 0 < error["rms"] < 0.05
    assert kernel.kernel_error(df, kernel.kernel_graph(df, 0.5, 400), 400)["largest"] < 1e-8
    out, _ = kernel.kernel_learn(df, "propagation", 0.5, 60, max_iter=30)
    got = out.orderBy("id").collect()
    assert np.mean([(r.f1 > 0.5) == (i >= 200) for i, r in enumerate(got)]) > 0.95


def test_no_rows_and_no_labels(spark):
    _, _, _, df = nodes(spark)
    bare = df.withColumn("label", F.lit(None).cast("int"))
    out, model = kernel.kernel_learn(bare, "propagation", 0.5, 10, max_iter=5)
    assert {(r.known, r.f0, r.f1) for r in out.collect()} == {(False, 0.0, 0.0)}
    assert out.count() == 60 and model.moved == 0.0
    assert kernel.kernel_learn(df.limit(0), "spreading", 0.5, 10, max_iter=2)[0].count() == 0
    with pytest.raises(ValueError):
        kernel.kernel_learn(df, "guessing", 0.5)


@pytest.mark.parametrize("at_once", [3, 128])
def test_rounds_without_rows_stop_where_rounds_with_rows_do(spark, monkeypatch, at_once):
    monkeypatch.setattr(kernel, "ROUNDS_AT_ONCE", at_once)
    x, y, known, df = nodes(spark, 80, seed=9)
    for max_iter, tolerance in ((200, 1e-2), (7, None), (2, None), (1, None)):
        out, model = kernel.kernel_learn(df, "propagation", 2.0, len(x), max_iter=max_iter, tolerance=tolerance)
        want, state = rounds(full(x, 2.0), y, known, "propagation", 0, max_iter, tolerance)
        assert np.allclose([(r.f0, r.f1) for r in out.orderBy("id").collect()], want, atol=1e-7)
        assert np.allclose(model.last, model.graph.lift(x).T @ state, atol=1e-6)
