"""Nearest-neighbour and kernel graphs, and label propagation over them.

Neighbour search is exact. Rows are placed in cells around pivots; triangle
inequalities rule out cells that cannot hold a neighbour of a row. Cells that lie side by
side make up a block of bounded size, and a row travels once to each block that has a cell
left for it, so that what is shuffled follows the rows times the blocks and not times the
cells. Inside a block a few rows at a time meet the cells left for them as one matrix product,
and only the best k per row leave a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from halflight.operators.keys import join_null_safe
from halflight.operators.ordering import with_global_rank
from halflight.operators.sample import hash_key
from halflight.session import cut_lineage

#: Rows of a block at least and, for either side, numbers of a block at most. Between them a table is
#: cut into ``BLOCKS`` blocks, so that each row is sent a fixed number of times.
BLOCK_ROWS, BLOCK_NUMBERS, BLOCKS = 2048, 4_000_000, 10
#: Distances that a task holds at once.
PAIRS = 4_000_000
#: Columns of which the least stands for all when the reach of a row is told.
FOLD = 64


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gaps = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.maximum(gaps, 0.0)


def _reach(rough: np.ndarray, need: int) -> np.ndarray:
    """For every row a number that at least ``need`` of its values do not exceed, and few more."""
    folds = rough.shape[1] // FOLD
    if folds > need:
        # far apart columns share a fold, as neighbours stand side by side
        rough = rough[:, :folds * FOLD].reshape(len(rough), FOLD, folds).min(1)
    width = min(need, rough.shape[1])
    return np.partition(rough, width - 1, axis=1)[:, width - 1]


def _block_neighbours(qid, q, did, wide, k, skip_self, copies=1):
    """Best k of one block per query row, ordered by exact distance then id; ``wide`` has the vectors of
    ``did`` with the sum of their squares behind, and an id stands there ``copies`` times at most.

    The matrix product picks candidates with a margin for its rounding error; their
    distances are then computed directly, so equal vectors tie exactly.
    """
    d = wide[:, :-1]
    # a row's own square is the same for all its distances
    rough = np.hstack([-2.0 * q, np.ones((len(q), 1))]) @ wide.T
    edge = _reach(rough, k + copies if skip_self else k)
    size = (q * q).sum(1) + wide[:, -1].max()
    rows, cols = np.divmod(np.flatnonzero(rough <= (edge + 1e-9 * (size + 1.0))[:, None]), len(did))
    if skip_self:
        other = qid[rows] != did[cols]
        rows, cols = rows[other], cols[other]
    exact = np.empty(len(rows))
    for at in range(0, len(rows), 200_000):
        part = slice(at, at + 200_000)
        exact[part] = np.square(q[rows[part]] - d[cols[part]]).sum(1)
    order = np.lexsort((did[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    starts = np.searchsorted(rows, np.arange(len(qid)))
    place = np.arange(len(rows)) - starts[rows]
    keep = place < k
    return qid[rows[keep]], did[cols[keep]], np.sqrt(exact[keep])


def _match(q: pd.DataFrame, d: pd.DataFrame, k: int, skip_self: bool) -> pd.DataFrame:
    """Best k of a block per row of ``q``; ``near`` has a bit for each cell that is left for the row."""
    none = pd.DataFrame({"src": [], "dst": [], "dist": []})
    if len(q) == 0 or len(d) == 0:
        return none
    q, d = q.sort_values("home"), d.sort_values("cell")
    qid, qv, did, dv = q["id"].to_numpy(), _matrix(q["v"]), d["id"].to_numpy(), _matrix(d["v"])
    wide = np.hstack([dv, (dv * dv).sum(1)[:, None]])
    there = np.isfinite(wide[:, -1])
    did, wide, cell = did[there], wide[there], d["cell"].to_numpy()[there]
    if len(did) == 0:
        return none
    copies = int(np.unique(did, return_counts=True)[1].max())
    near = np.frombuffer(b"".join(q["near"]), np.uint8).reshape(len(q), -1)
    found = []
    step = max(16, PAIRS // len(did))
    for at in range(0, len(q), step):
        part = slice(at, at + step)  # rows side by side, whose cells are much the same
        left = np.unpackbits(np.bitwise_or.reduce(near[part], axis=0)).astype(bool)[cell]
        if not left.any():
            continue
        ids, vectors = (did, wide) if left.all() else (did[left], wide[left])
        found.append(_block_neighbours(qid[part], qv[part], ids, vectors, k, skip_self, copies))
    if not found:
        return none
    src, dst, dist = (np.concatenate(column) for column in zip(*found, strict=True))
    return pd.DataFrame({"src": src, "dst": dst, "dist": dist})


def knn_edges(
    data: DataFrame,
    row_id: str,
    vector: str,
    k: int = 7,
    queries: DataFrame | None = None,
    include_self: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """(src, dst, dist): the k nearest rows of ``data`` for every row, ties by lower id.

    Without ``queries`` the table is matched with itself. ``block_rows`` bounds either side of a block; by
    default there are ``BLOCKS`` of them, unless they get too small or too large. Ids are whole numbers, or of any other type
    that can be ordered: those are numbered in their order first and named again at the end.
    """
    itself = queries is None
    if not isinstance(data.schema[row_id].dataType, IntegralType):
        return _by_number(data, row_id, vector, k, queries, include_self, block_rows)
    points = data.select(F.col(row_id).cast("long").alias("id"),
                         F.col(vector).cast("array<double>").alias("v"))
    asked = points if itself else queries.select(
        F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    skip_self = itself and not include_self
    n = points.count()
    if n == 0:
        return data.sparkSession.createDataFrame([], "src long, dst long, dist double")
    n_pivots = math.ceil(math.sqrt(n))  # cells and rows of a cell grow alike; so many vectors reach the driver
    pivots = np.array(
        [r["v"] for r in points.orderBy(hash_key("id", 7), "id").limit(n_pivots).collect()],
        dtype=float,
    )

    placed = points.mapInPandas(_placer(pivots), "id long, v array<double>, cell int, r double")
    placed = cut_lineage(placed)
    nearest = W.partitionBy("cell").orderBy("r")
    radii = (
        placed.select("cell", "r")
        .withColumn("m", F.row_number().over(nearest))
        .filter(F.col("m") <= k + 1)
        .groupBy("cell").agg(F.sort_array(F.collect_list("r")).alias("radii"))
    )
    spans = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("rmin"), F.max("r").alias("rmax")
    )
    cells = {c["cell"]: c for c in spans.join(radii, "cell").collect()}  # one row per pivot
    if block_rows is None:
        most = max(BLOCK_ROWS, BLOCK_NUMBERS // max(1, pivots.shape[1]))
        block_rows = min(most, max(BLOCK_ROWS, math.ceil(n / BLOCKS)))
    first, cuts = _packed(pivots, {c: row["n"] for c, row in cells.items()}, block_rows)
    send = _sender(_router(pivots, cells, k + 1 if skip_self else k), first, cuts)
    wanted = asked.mapInPandas(send, "id long, v array<double>, home int, near binary, blocks array<int>")
    wanted = cut_lineage(wanted)
    loads = {
        r["block"]: r["n"]
        for r in wanted.select(F.explode("blocks").alias("block"))
        .groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    n_blocks = int((first + cuts).max())

    def literal(numbers):
        return F.split(F.lit(",".join(str(int(x)) for x in numbers)), ",").cast("array<int>")

    groups = literal(max(1, math.ceil(loads.get(b, 0) / block_rows)) for b in range(n_blocks))
    at = lambda numbers, place: F.element_at(numbers, F.col(place) + 1)

    # both sides are split, so a cell that holds most rows is many blocks
    left = (
        wanted.select("id", "v", "home", "near", F.explode("blocks").alias("block"))
        .withColumn("group", F.pmod(F.xxhash64("id"), at(groups, "block")).cast("int"))
    )
    cut = F.pmod(F.xxhash64("id", F.lit(1)), at(literal(cuts), "cell")).cast("int")
    right = placed.select("id", "v", "cell", (at(literal(first), "cell") + cut).alias("block")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), at(groups, "block") - 1)))
    partial = (
        left.groupBy("block", "group")
        .cogroup(right.groupBy("block", "group"))
        .applyInPandas(lambda q, d: _match(q, d, k, skip_self), "src long, dst long, dist double")
    )
    best = W.partitionBy("src").orderBy("dist", "dst")
    return partial.withColumn("_rn", F.row_number().over(best)).filter(
        F.col("_rn") <= k
    ).drop("_rn")


def _by_number(data, row_id, vector, k, queries, include_self, block_rows) -> DataFrame:
    """``knn_edges`` of rows whose ids are no whole numbers."""
    ids = data.select(row_id) if queries is None else data.select(row_id).unionByName(queries.select(row_id))
    numbers = cut_lineage(with_global_rank(ids.distinct(), [F.col(row_id)], "_n"))
    numbered = lambda df: None if df is None else join_null_safe(
        df.select(row_id, vector), numbers, [row_id]).select(F.col("_n").alias("id"), F.col(vector).alias("v"))
    edges = knn_edges(numbered(data), "id", "v", k, numbered(queries), include_self, block_rows)
    named = lambda end: numbers.select(F.col("_n").alias(f"_{end}"), F.col(row_id).alias(end))
    edges = edges.withColumnsRenamed({"src": "_src", "dst": "_dst"})
    return edges.join(named("src"), "_src").join(named("dst"), "_dst").select("src", "dst", "dist")


def _placer(pivots):
    def place(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            gaps = np.sqrt(_squared(_matrix(pdf["v"]), pivots))
            cell = gaps.argmin(1)
            yield pdf.assign(cell=cell.astype("int32"), r=gaps[np.arange(len(pdf)), cell])

    return place


def _packed(pivots, sizes, block_rows):
    """First block and number of blocks of every cell. Cells side by side share a block while they fit;
    a larger one has blocks of its own."""
    spread = pivots - pivots.mean(0)
    spread = np.where(np.isfinite(spread), spread, 0.0)
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if spread.size else np.zeros(len(pivots))
    first, cuts = np.zeros(len(pivots), int), np.ones(len(pivots), int)
    block, held = 0, 0
    for c in np.argsort(along, kind="stable"):
        n = sizes.get(c, 0)
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[c], cuts[c] = block, max(1, math.ceil(n / block_rows))
        held += n
        if cuts[c] > 1:
            block, held = block + cuts[c], 0
    return first, cuts


def _router(pivots, cells, need):
    """The nearest cell of each query row, and the cells that may hold one of its ``need`` nearest rows."""
    used = np.array(sorted(cells))
    rmin = np.array([cells[c]["rmin"] for c in used])
    rmax = np.array([cells[c]["rmax"] for c in used])
    offsets = np.concatenate([np.array(cells[c]["radii"]) for c in used])
    owner = np.concatenate([np.full(len(cells[c]["radii"]), i) for i, c in enumerate(used)])

    def route(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            homes, found = [], []
            for at in range(0, len(pdf), 512):
                gaps = np.sqrt(_squared(_matrix(pdf["v"].iloc[at:at + 512]), pivots[used]))
                homes += used[gaps.argmin(1)].tolist()
                if len(used) == 1:
                    found += [used.tolist()] * len(gaps)
                    continue
                reach = gaps[:, owner] + offsets[None, :]
                width = min(need, reach.shape[1])
                upper = np.partition(reach, width - 1, axis=1)[:, width - 1]
                if reach.shape[1] < need:
                    upper = np.full(len(upper), np.inf)
                lower = np.maximum(gaps - rmax[None, :], rmin[None, :] - gaps)
                slack = 1e-6 * (1.0 + gaps)
                found += [used[row].tolist() for row in lower - slack <= upper[:, None]]
            yield pdf.assign(home=np.array(homes, "int32"), cells=found)

    return route


def _sender(route, first, cuts):
    """Rows of a router with a bit for each cell, and the blocks of their cells."""
    held = np.zeros((len(first), int((first + cuts).max())), np.float32)
    for row, a, n in zip(held, first, cuts, strict=True):
        row[a:a + n] = 1

    def send(batches):
        for pdf in route(batches):
            every = np.zeros((len(pdf), len(held)), np.uint8)
            for row, cells in zip(every, pdf["cells"], strict=True):
                row[cells] = 1
            blocks = [np.flatnonzero(row) for row in every.astype(np.float32) @ held]
            bits = [row.tobytes() for row in np.packbits(every, axis=1)]
            yield pdf.drop(columns="cells").assign(near=bits, blocks=blocks)

    return send


def rbf_edges(
    data: DataFrame, row_id: str, vector: str, gamma: float, k: int = 7,
    include_self: bool = False, **kw,
) -> DataFrame:
    """Neighbour edges weighted by exp(−γ·d²)."""
    edges = knn_edges(data, row_id, vector, k, include_self=include_self, **kw)
    return edges.withColumn("w", F.exp(F.lit(-float(gamma)) * F.col("dist") * F.col("dist")))


# --- propagation ---------------------------------------------------------------------------


def _start(nodes: DataFrame) -> DataFrame:
    """One-hot distributions of labelled rows as first state and as target; (0, 0) for the rest."""
    y = F.col("label")
    one_hot = nodes.select(
        "id", y.isNotNull().alias("known"),
        F.when(y == 0, 1.0).otherwise(0.0).alias("y0"),
        F.when(y == 1, 1.0).otherwise(0.0).alias("y1"),
    )
    return one_hot.withColumns({"f0": F.col("y0"), "f1": F.col("y1")})


def _spread_once(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Σ over a row's edges of weight × the neighbour's distribution."""
    sent = edges.join(state.select(F.col("id").alias("dst"), "f0", "f1"), "dst")
    return sent.groupBy(F.col("src").alias("id")).agg(
        F.sum(F.col("w") * F.col("f0")).alias("s0"), F.sum(F.col("w") * F.col("f1")).alias("s1")
    )


def _iterate(
    start: DataFrame, edges: DataFrame, update, rounds: int, tolerance: float | None
) -> DataFrame:
    """Rounds until the distributions move by less than ``tolerance`` in all, ``rounds`` at most.

    A round is one table: the new state beside how far each row moved. The edges are written before.
    """
    state = cut_lineage(start)
    for _ in range(rounds):
        moved = state.join(_spread_once(edges, state), "id", "left")
        f0, f1 = update("s0", "y0"), update("s1", "y1")
        gap = F.abs(f0 - F.col("f0")) + F.abs(f1 - F.col("f1"))
        state = cut_lineage(moved.select(
            "id", "known", "y0", "y1", gap.alias("gap"), f0.alias("f0"), f1.alias("f1")))
        total = state.agg(F.sum("gap")).first()[0]
        if tolerance is not None and (total is None or total < tolerance):
            break
    return _normalised(state)


def label_propagation(
    nodes: DataFrame, edges: DataFrame, max_iter: int = 1000, tolerance: float | None = 1e-3
) -> DataFrame:
    """Hard-clamped propagation over (src, dst, w) edges.

    ``tolerance=None`` runs exactly ``max_iter`` rounds. Returns id, known, f0, f1 with rows
    summing to 1 where any label reached them.
    """
    total = F.col("s0") + F.col("s1")

    def update(s, y):
        share = F.coalesce(F.col(s) / F.when(total == 0, 1.0).otherwise(total), F.lit(0.0))
        return F.when(F.col("known"), F.col(y)).otherwise(share)

    return _iterate(_start(nodes), cut_lineage(edges.select("src", "dst", "w")), update, max_iter,
                    tolerance)


def spreading_weights(edges: DataFrame) -> DataFrame:
    """D^-1/2 W D^-1/2 without self loops; the degree is a row's incoming weight."""
    bare = edges.filter("src <> dst")
    degree = bare.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("deg"))
    out = degree.select(F.col("id").alias("src"), F.col("deg").alias("d_src"))
    into = degree.select(F.col("id").alias("dst"), F.col("deg").alias("d_dst"))
    safe = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0))
    return bare.join(out, "src", "left").join(into, "dst", "left").select(
        "src", "dst", (F.col("w") / F.sqrt(safe("d_src")) / F.sqrt(safe("d_dst"))).alias("w")
    )


def label_spreading(
    nodes: DataFrame, edges: DataFrame, alpha: float = 0.2, max_iter: int = 1000,
    tolerance: float | None = 1e-3,
) -> DataFrame:
    """F ← α·S·F + (1 − α)·Y over symmetric-normalised edges."""

    def update(s, y):
        return F.coalesce(F.col(s), F.lit(0.0)) * alpha + F.col(y) * (1.0 - alpha)

    return _iterate(_start(nodes), cut_lineage(spreading_weights(edges)), update, max_iter, tolerance)


def _normalised(state: DataFrame) -> DataFrame:
    total = F.col("f0") + F.col("f1")
    safe = F.when(total == 0, 1.0).otherwise(total)
    return state.select(
        "id", "known", (F.col("f0") / safe).alias("f0"), (F.col("f1") / safe).alias("f1")
    )


def inductive_graph_predict(
    test: DataFrame, graph: DataFrame, distributions: DataFrame, k: int = 7,
    gamma: float | None = None, **kw,
) -> DataFrame:
    """Probability of class 1 for unseen rows from their nearest graph rows.

    ``test`` and ``graph`` have id and v. A row that no label reaches gets 0.5.
    """
    edges = knn_edges(graph, "id", "v", k, queries=test, **kw)
    w = F.lit(1.0) if gamma is None else F.exp(F.lit(-gamma) * F.col("dist") * F.col("dist"))
    sums = _spread_once(edges.withColumn("w", w), distributions)
    total = F.col("s0") + F.col("s1")
    return test.select("id").join(sums, "id", "left").select(
        "id", F.coalesce(F.col("s1") / F.nullif(total, F.lit(0.0)), F.lit(0.5)).alias("p1")
    )


def knn_classify(
    test: DataFrame, train: DataFrame, row_id: str, vector: str, label: str, k: int = 5, **kw
) -> DataFrame:
    """Share of positive labels among the k nearest training rows."""
    edges = knn_edges(train, row_id, vector, k, queries=test, **kw)
    votes = edges.join(
        train.select(F.col(row_id).alias("dst"), F.col(label).alias("_y")), "dst"
    )
    return votes.groupBy("src").agg(F.avg(F.col("_y").cast("double")).alias("p1")).select(
        F.col("src").alias(row_id), "p1"
    )
