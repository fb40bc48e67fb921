import numpy as np
import pytest

from halflight.operators import graph


def brute(ids, x, k, skip_self=True):
    out = {}
    for i, a in zip(ids, x):
        d = np.sqrt(np.square(a - x).sum(1))
        order = sorted((dist, j) for dist, j in zip(d, ids) if not (skip_self and i == j))
        out[i] = [j for _, j in order[:k]]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame(
        [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, v array<double>")


@pytest.mark.parametrize("block_rows", [25, 5000])
def test_neighbours_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 3)) * 20
    x = np.concatenate([c + rng.normal(size=(30, 3)) for c in centres])
    # a third of all rows is one and the same vector
    x = np.concatenate([x, np.tile(x[0], (90, 1))])
    ids = np.arange(len(x)) * 3
    got = graph.knn_edges(frame(spark, ids, x), "id", "v", 7, block_rows=block_rows).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.src, r.dist, r.dst)):
        mine.setdefault(r.src, []).append(r.dst)
    assert mine == brute(ids, x, 7)


def test_pruning_drops_far_cells(spark):
    pivots = np.array([[0.0], [100.0]])
    cells = {c: {"rmin": 0.0, "rmax": 1.0, "radii": [0.0, 0.5, 1.0]} for c in (0, 1)}
    import pandas as pd

    rows = pd.DataFrame({"id": [1, 2], "v": [[0.3], [99.8]]})
    out = next(graph._router(pivots, cells, 2)([rows]))
    assert list(out["cells"]) == [[0], [1]]


def nodes(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 6])
    rows = [(i, [float(a) for a in r], {0: 0, 25: 1}.get(i)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, label int")


def test_kernel_propagation_matches_numpy(spark):
    x, df = nodes(spark)
    w = np.exp(-0.5 * np.square(x[:, None] - x[None]).sum(2))
    y = np.zeros((40, 2))
    y[0, 0] = y[25, 1] = 1.0
    f = y.copy()
    for _ in range(3):
        f = w @ f
        f /= f.sum(1, keepdims=True)
        f[[0, 25]] = y[[0, 25]]
    got = graph.label_propagation(df, graph.rbf_edges(df, "id", "v", 0.5, 40, include_self=True), 3, tolerance=None).orderBy("id").collect()
    assert np.allclose([r.f1 for r in got], f[:, 1])


def test_spreading_separates_two_groups(spark):
    _, df = nodes(spark)
    got = graph.label_spreading(df, graph.rbf_edges(df, "id", "v", 0.5, 40, include_self=True), max_iter=30).orderBy("id").collect()
    assert all((r.f1 > 0.5) == (r.id >= 20) for r in got)
