"""Propagation and spreading over the whole RBF kernel, without edges.

The kernel of all pairs of rows is K = exp(-γ d²). A bounded number of rows are landmarks; with C the
kernel between a row and the landmarks and W that among them, K is taken as C W⁺ Cᵀ, so that a row is
a vector φ of at most as many numbers as landmarks and K between two rows is φ · φ'. K F is then φ
times the sum of φ F over all rows: a round is one aggregate of landmarks x 2 numbers, and a row's
distribution follows from its vector, its label and the sums so far. Nothing but sums is written, and
the work grows with rows x landmarks. When all rows are landmarks the kernel is exact;
``kernel_error`` tells how far it is from that otherwise.

In propagation every distribution sums to 1 after the first round, so that each further round is the
same linear map of the sums, landmarks x landmarks numbers from one aggregate. Rounds then need no
rows; how far the rows move is read off for many rounds at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.operators.sample import hash_key
from halflight.session import cut_lineage

LANDMARKS = 512
#: Rows whose kernel to the landmarks is held at a time.
BLOCK_ROWS = 4096
#: Rounds whose movement is read off in one pass over the rows.
ROUNDS_AT_ONCE = 128
#: Directions of the landmarks' kernel below this share of the strongest are rounding.
NOISE = 1e-12


class KernelGraph(NamedTuple):
    """Landmarks, the map from the kernel with them to φ, and γ."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * _squared(v, self.landmarks)) @ self.root


class KernelModel(NamedTuple):
    """What propagation or spreading leaves: the sums of every round, and those of the last state."""

    graph: KernelGraph
    method: str
    alpha: float
    degree: np.ndarray
    sums: list[np.ndarray]
    last: np.ndarray
    moved: float


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gaps = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(gaps, 0.0)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def kernel_graph(points: DataFrame, gamma: float, landmarks: int = LANDMARKS, seed: int = 7) -> KernelGraph:
    """``landmarks`` rows of ``points`` (id, v), the first by hash, so many of which reach the driver.

    Equal rows and rows that others nearly span add no direction of their own and do no harm.
    """
    if landmarks < 1:
        raise ValueError("no landmarks")
    chosen = points.orderBy(hash_key("id", seed), "id").limit(landmarks).select(
        F.col("v").cast("array<double>").alias("v")).collect()
    at = np.array([r["v"] for r in chosen], dtype=float)
    if not len(chosen):
        return KernelGraph(np.zeros((0, 0)), np.zeros((0, 0)), gamma)
    values, vectors = np.linalg.eigh(np.exp(-gamma * _squared(at, at)))
    kept = values > NOISE * values[-1]
    return KernelGraph(at, vectors[:, kept] / np.sqrt(values[kept]), gamma)


def kernel_error(points: DataFrame, graph: KernelGraph, rows: int = 2000, seed: int = 11) -> dict[str, float]:
    """Largest and root-mean-square difference between kernel and low-rank kernel over all pairs of
    ``rows`` rows, the first by another hash."""
    some = points.orderBy(hash_key("id", seed), "id").limit(rows).select(
        F.col("v").cast("array<double>").alias("v")).collect()
    at = np.array([r["v"] for r in some], dtype=float)
    phi = graph.lift(at)
    gap = phi @ phi.T - np.exp(-graph.gamma * _squared(at, at))
    return {"largest": float(np.abs(gap).max()), "rms": float(np.sqrt(np.square(gap).mean()))}


def _total(points: DataFrame, graph: KernelGraph, size: int, part) -> np.ndarray:
    """Sum over all rows of ``part(φ, one-hot labels, is labelled)``, which gives ``size`` numbers."""

    def partial(batches):
        total = np.zeros(size)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                total += part(*_block(pdf["v"].iloc[at:at + BLOCK_ROWS], pdf["label"].iloc[at:at + BLOCK_ROWS], graph))
        yield pd.DataFrame({"at": np.arange(size), "x": total})

    sums = points.select("v", "label").mapInPandas(partial, "at int, x double").groupBy("at").agg(
        F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in sums:
        out[r["at"]] = r["x"]
    return out


def _block(v: pd.Series, label: pd.Series, graph: KernelGraph):
    y = label.to_numpy(dtype=float, na_value=np.nan)
    known = ~np.isnan(y)
    hot = np.column_stack([(y == 0), (y == 1)]).astype(float)
    return graph.lift(_matrix(v, graph.landmarks.shape[1])), hot, known


def _propagated(phi, hot, known, sums: np.ndarray | None) -> np.ndarray:
    """State after the round that read ``sums``; before the first round the labels."""
    if sums is None:
        return hot
    share = phi @ sums
    whole = share.sum(1, keepdims=True)
    share = np.divide(share, whole, out=np.zeros_like(share), where=whole > 0)
    return np.where(known[:, None], hot, share)


def _spread(phi, hot, sums: list[np.ndarray], degree: np.ndarray, alpha: float):
    """(state after the rounds that read ``sums``, the state before the last, root of the degrees)."""
    own = np.square(phi).sum(1, keepdims=True)
    weight = phi @ degree[:, None] - own
    weight = np.where(weight > NOISE, weight, 1.0)
    side = np.sqrt(weight)
    state = before = hot
    for s in sums:
        before = state
        state = alpha * (phi @ s / side - own / weight * state) + (1.0 - alpha) * hot
    return state, before, side


def learn_kernel(
    nodes: DataFrame, method: str, graph: KernelGraph, alpha: float = 0.2, max_iter: int = 1000,
    tolerance: float | None = 1e-3,
) -> KernelModel:
    """'propagation' (labels clamped) or 'spreading' over ``nodes`` (v and a nullable label 0 or 1)
    until all distributions together move by less than ``tolerance``; ``None`` runs ``max_iter`` rounds.

    Give it a written table: each round reads it.
    """
    if method not in ("propagation", "spreading"):
        raise ValueError(f"unknown method: {method}")
    points = nodes.select(F.col("v").cast("array<double>").alias("v"), F.col("label").cast("double").alias("label"))
    learn = _learn_spreading if method == "spreading" else _learn_propagation
    return learn(points, graph, alpha, max_iter, tolerance)


def _settled(moved: float, tolerance: float | None) -> bool:
    return tolerance is not None and moved < tolerance


def _learn_spreading(points, graph, alpha, max_iter, tolerance) -> KernelModel:
    width, sums = graph.root.shape[1], []
    degree = _total(points, graph, width, lambda phi, hot, known: phi.sum(0))

    def part(phi, hot, known):
        state, before, side = _spread(phi, hot, sums, degree, alpha)
        return np.append((phi.T @ (state / side)).ravel(), np.abs(state - before).sum())

    found = _total(points, graph, 2 * width + 1, part)
    for _ in range(max_iter):
        sums.append(found[:-1].reshape(width, 2))
        found = _total(points, graph, 2 * width + 1, part)
        if _settled(found[-1], tolerance):
            break
    # new rows see the state itself
    last = _total(points, graph, 2 * width, lambda phi, hot, known: (
        phi.T @ _spread(phi, hot, sums, degree, alpha)[0]).ravel()).reshape(width, 2)
    return KernelModel(graph, "spreading", alpha, degree, sums, last, float(found[-1]))


def _learn_propagation(points, graph, alpha, max_iter, tolerance) -> KernelModel:
    width = graph.root.shape[1]
    found = _total(points, graph, 3 * width, lambda phi, hot, known: np.concatenate(
        [phi.sum(0), (phi.T @ hot).ravel()]))
    degree, labels = found[:width], found[width:].reshape(width, 2)
    sums = [labels]

    def one_round(phi, hot, known):
        state = _propagated(phi, hot, known, sums[-1])
        before = _propagated(phi, hot, known, sums[-2] if len(sums) > 1 else None)
        # a row that labels do not reach yet, though other rows do
        left = ((state.sum(1) == 0) & (phi @ degree > 0)).sum()
        return np.concatenate([(phi.T @ state).ravel(), [np.abs(state - before).sum(), left]])

    def model(used, last, moved):
        return KernelModel(graph, "propagation", alpha, degree, [used], last, float(moved))

    for number in range(1, max_iter + 1):
        found = _total(points, graph, 2 * width + 2, one_round)
        after, moved, left = found[:-2].reshape(width, 2), found[-2], found[-1]
        if _settled(moved, tolerance) or number == max_iter:
            return model(sums[-1], after, moved)
        sums = [sums[-1], after]
        if left == 0 and number > 1:  # from here on rounds are linear
            break
    else:
        return model(labels, labels, 0.0)

    carried = _linear_round(points, graph, degree)
    before, now = sums  # what the last round read, and what the next one reads
    while number < max_iter:
        steps = [before, now]
        for _ in range(min(ROUNDS_AT_ONCE, max_iter - number)):
            steps.append(labels + carried @ steps[-1])
        gaps = np.concatenate([b - a for a, b in zip(steps[:-2], steps[1:-1], strict=True)], axis=1)
        n = len(steps) - 2

        def movement(phi, hot, known, gaps=gaps, n=n):
            free, whole = phi[~known], (phi @ degree)[~known]
            moves = np.abs(free @ gaps).reshape(-1, n, 2).sum(2)
            return np.divide(moves, whole[:, None], out=np.zeros_like(moves), where=whole[:, None] > 0).sum(0)

        moves = _total(points, graph, n, movement)
        ends = [i for i, m in enumerate(moves) if _settled(m, tolerance)]
        taken = ends[0] + 1 if ends else n
        number += taken
        before, now = steps[taken], steps[taken + 1]
        moved = moves[taken - 1]
        if ends:
            break
    return model(before, now, moved)


def _linear_round(points: DataFrame, graph: KernelGraph, degree: np.ndarray) -> np.ndarray:
    """What one round makes of the sums, labels aside: Σ φ φᵀ / (φ · degree) over rows without a label.

    Every partition gives its sum as one row for each number of φ; as many rows reach the driver.
    """
    width = graph.root.shape[1]

    def partial(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                phi, _, known = _block(pdf["v"].iloc[at:at + BLOCK_ROWS], pdf["label"].iloc[at:at + BLOCK_ROWS], graph)
                whole = phi @ degree
                free = ~known & (whole > 0)
                total += (phi[free] / whole[free, None]).T @ phi[free]
        yield pd.DataFrame({"at": np.arange(width), "x": [r.tobytes() for r in total]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["x"])
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "x": [total.tobytes()]})

    schema = "at int, x binary"
    rows = points.select("v", "label").mapInPandas(partial, schema).groupBy("at").applyInPandas(added, schema)
    out = np.zeros((width, width))
    for r in rows.collect():
        out[r["at"]] = np.frombuffer(r["x"])
    return out


def kernel_distributions(nodes: DataFrame, model: KernelModel) -> DataFrame:
    """``id, known, f0, f1`` of the rows that the model was learnt from; rows sum to 1 where any label
    reached them."""
    graph, sums = model.graph, model.sums

    @F.pandas_udf("f0 double, f1 double")
    def state(v: pd.Series, label: pd.Series) -> pd.DataFrame:
        parts = [np.zeros((0, 2))]
        for at in range(0, len(v), BLOCK_ROWS):
            block = _block(v.iloc[at:at + BLOCK_ROWS], label.iloc[at:at + BLOCK_ROWS], graph)
            if model.method == "spreading":
                parts.append(_spread(*block[:2], sums, model.degree, model.alpha)[0])
            else:
                parts.append(_propagated(*block, sums[-1] if sums else None))
        f = np.concatenate(parts)
        whole = f.sum(1, keepdims=True)
        return pd.DataFrame(np.divide(f, whole, out=np.zeros_like(f), where=whole != 0), columns=["f0", "f1"])

    found = state(F.col("v").cast("array<double>"), F.col("label").cast("double"))
    return nodes.select("id", F.col("label").isNotNull().alias("known"), found.alias("f")).select(
        "id", "known", "f.f0", "f.f1")


def kernel_predict(v: Column, model: KernelModel) -> Column:
    """Probability of class 1 for rows the model has not seen; 0.5 where no label reaches."""
    graph, last = model.graph, model.last

    @F.pandas_udf("double")
    def positive(v: pd.Series) -> pd.Series:
        parts = [np.zeros(0)]
        for at in range(0, len(v), BLOCK_ROWS):
            share = np.maximum(graph.lift(_matrix(v.iloc[at:at + BLOCK_ROWS], graph.landmarks.shape[1])) @ last, 0.0)
            whole = share.sum(1)
            parts.append(np.divide(share[:, 1], whole, out=np.full(len(share), 0.5), where=whole > 0))
        return pd.Series(np.concatenate(parts))

    return positive(v.cast("array<double>"))


def kernel_learn(
    nodes: DataFrame, method: str, gamma: float, landmarks: int = LANDMARKS, alpha: float = 0.2,
    max_iter: int = 1000, tolerance: float | None = 1e-3,
) -> tuple[DataFrame, KernelModel]:
    """(distributions, model) of ``nodes`` (id, v, label) over the whole kernel."""
    points = cut_lineage(nodes.select("id", "v", "label"))
    model = learn_kernel(points, method, kernel_graph(points, gamma, landmarks), alpha, max_iter, tolerance)
    return kernel_distributions(points, model), model
