"""Forests whose trees are grown whole in tasks, one after the other, and never on the driver.

Values are cut into at most 32 bins a feature, as Spark's own forest does, and the labelled rows become
blocks of one byte a value. Every task gets the blocks and grows its share of the trees: bootstrap by
Poisson counts, a random subset of features a node, the cut with the best Gini gain. A fit is one pass for
the cuts and one for the trees, whatever their depth, where a forest grown level by level on the driver
takes a job for each; several forests over the same rows share both.

A task holds its blocks (a byte for each value) and some twenty bytes a row; histograms of ``NODES`` nodes at a
time. Trees of bounded size are collected and travel to the rows they score. Larger ones stay a table,
from which each task takes some trees over blocks of rows; only sums by row come together.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflight.functions.scoring import confidence, decide
from halflight.session import cut_lineage

BINS = 32
#: Steps between the quantiles that the cuts are chosen from.
GRID = 1024
#: Rows of a block, rows counted at a time, nodes whose histograms are held at a time, rows scored at a time.
BLOCK_ROWS, CHUNK_ROWS, NODES, SCORED_ROWS = 65_536, 131_072, 2048, 8192
#: Trees that grow level by level together, at most, and their rows.
TREES_TOGETHER, ROWS_TOGETHER = 5, 250_000
#: Trees up to so many bytes are collected; those of the rest stay a table.
SMALL_BYTES = 32_000_000
#: Trees up to this depth are that small whatever the rows.
SMALL_DEPTH = 12

TREE_SCHEMA = "forest int, tree int, feature binary, cut binary, below binary, p binary"


class Cuts(NamedTuple):
    """Per feature the value of a gap and the cuts between bins; rows by class of those they come from."""

    features: list[str]
    fills: list[float]
    cuts: list[np.ndarray]
    classes: dict[int, int]


class Plan(NamedTuple):
    """A forest to grow: columns by their place among the cut features, and its settings."""

    columns: list[int]
    trees: int
    max_depth: int
    min_leaf: int
    subset: int
    weights: np.ndarray
    seed: int


class Tree(NamedTuple):
    """Nodes by number, the root first: place of the feature, last bin that goes left, left child (a leaf
    has itself; the right child follows the left) and share of class 1."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    p: np.ndarray


# --- cuts and blocks -----------------------------------------------------------------------


def _chosen_cuts(grid: list[float] | None) -> np.ndarray:
    """Midpoints between the quantiles' values: all if few differ, else those nearest to even shares."""
    if not grid:
        return np.zeros(0)
    values, counts = np.unique(np.array(grid, dtype=float), return_counts=True)
    middles = values[:-1] / 2 + values[1:] / 2
    if len(middles) < BINS:
        return middles
    stride = len(grid) / BINS
    found, seen, goal = [], counts[0], stride
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - goal) < abs(seen - goal):
            found.append(middles[i - 1])
            goal += stride
    return np.array(found[:BINS - 1])


def fit_cuts(rows: DataFrame, features: list[str], target: str) -> Cuts:
    """Cuts of the finite values of ``rows``, from all of them, in one pass; a gap counts as the mean."""
    x = [F.col(c).cast("double") for c in features]
    finite = [F.when(F.abs(c) < F.lit(float("inf")), c) for c in x]
    # one literal: a column for each step would take longer than the pass
    marks = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")
    y = F.col(target).cast("int")
    aggs = [F.count(F.lit(1)).alias("n"), F.max(y).alias("top"), F.min(y).alias("least"), F.sum(y).alias("ones")]
    for i, c in enumerate(finite):
        aggs += [F.avg(c).alias(f"m{i}"), F.percentile_approx(c, marks, 10 * GRID).alias(f"q{i}")]
    kept = rows.filter(y.isNotNull())
    got = kept.agg(*aggs).first()
    if not got["n"]:
        raise ValueError("no rows to learn from")
    if got["least"] < 0:
        raise ValueError(f"{target} has classes below 0")
    if got["top"] <= 1:
        classes = {0: got["n"] - got["ones"], 1: got["ones"]}
    else:
        classes = {r["y"]: r["count"] for r in kept.groupBy(y.alias("y")).count().collect()}
    return Cuts(list(features), [got[f"m{i}"] or 0.0 for i in range(len(features))],
                [_chosen_cuts(got[f"q{i}"]) for i in range(len(features))],
                {int(c): int(n) for c, n in classes.items() if n})


def _binned(columns: list, cuts: Cuts) -> np.ndarray:
    """Features x rows, one byte each: how many cuts lie below the value."""
    out = np.zeros((len(cuts.cuts), len(columns[0])), np.uint8)
    for i, (values, fill, at) in enumerate(zip(columns, cuts.fills, cuts.cuts, strict=True)):
        x = np.asarray(values, dtype=float)
        out[i] = np.searchsorted(at, np.where(np.isfinite(x), x, fill), side="left")
    return out


def blocks(df: DataFrame, cuts: Cuts, keep: list[Column]) -> DataFrame:
    """``part, at, n, x, kept``: rows in blocks of bytes, and ``keep`` of each as Arrow bytes."""
    names = [f"_x{i}" for i in range(len(cuts.features))]
    rows = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cuts.features, names, strict=True)],
                     F.struct(*keep).alias("kept")).select(*names, "kept.*")

    def pack(batches):
        part, at, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block():
            whole = pa.Table.from_batches(held).combine_chunks()
            x = _binned([whole.column(i).to_numpy() for i in range(len(names))], cuts)
            kept = whole.select(range(len(names), whole.num_columns))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as stream:
                stream.write_table(kept)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([whole.num_rows], pa.int32()),
                 pa.array([x.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["part", "at", "n", "x", "kept"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield block()
                at, held, count = at + 1, [], 0
        if count:
            yield block()

    return rows.mapInArrow(pack, "part int, at int, n int, x binary, kept binary")


def _kept(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


# --- growing -------------------------------------------------------------------------------


class _Nodes:
    """Growing arrays of the nodes of some trees; the roots come first."""

    def __init__(self):
        self.n, size = 0, 256
        self.feature, self.cut, self.p = np.zeros(size, np.int16), np.full(size, 255, np.uint8), np.zeros(size)
        self.below, self.owner = np.arange(size, dtype=np.int32), np.zeros(size, np.int32)

    def add(self, shares: np.ndarray, owners: np.ndarray) -> int:
        """Leaves with these shares in these trees; the number of the first."""
        first, end = self.n, self.n + len(shares)
        while end > len(self.p):
            size = len(self.p)
            more = (np.zeros(size, np.int16), np.full(size, 255, np.uint8), np.zeros(size),
                    np.arange(size, 2 * size, dtype=np.int32), np.zeros(size, np.int32))
            self.feature, self.cut, self.p, self.below, self.owner = (
                np.concatenate(pair) for pair in zip((self.feature, self.cut, self.p, self.below, self.owner), more, strict=True))
        self.p[first:end], self.owner[first:end] = shares, owners
        self.n = end
        return first

    def trees(self, count: int) -> list[Tree]:
        """The nodes of each tree, numbered anew in the same order, so that siblings stay side by side."""
        order = np.argsort(self.owner[:self.n], kind="stable")
        ends = np.cumsum(np.bincount(self.owner[:self.n], minlength=count))
        number = np.empty(self.n, np.int32)
        number[order] = np.arange(self.n, dtype=np.int32)
        found = []
        for begin, end in zip([0, *ends[:-1]], ends, strict=True):
            mine = order[begin:end]
            found.append(Tree(self.feature[mine], self.cut[mine], number[self.below[mine]] - np.int32(begin), self.p[mine]))
        return found


def _share(counts: np.ndarray, weights: np.ndarray, fallback: float) -> np.ndarray:
    weighed = counts * weights
    whole = weighed.sum(1)
    return np.divide(weighed[:, 1], whole, out=np.full(len(counts), fallback), where=whole > 0)


def _best(hist: np.ndarray, counts: np.ndarray, plan: Plan):
    """(slot, bin, gain) of the best cut of each node, and the counts left of it; ``hist`` is
    slots x nodes x classes x bins, gain -inf where no cut leaves enough rows on both sides."""
    slots, nodes, classes, bins = hist.shape
    left = np.cumsum(hist, axis=3)[:, :, :, :-1]
    shape = (slots, nodes, bins - 1)
    n_left, w_left, s_left, w_right, s_right = (np.zeros(shape) for _ in range(5))
    for c in range(classes):
        here = left[:, :, c, :]
        there = counts[None, :, c, None] - here
        n_left += here
        here, there = here * plan.weights[c], there * plan.weights[c]
        w_left += here
        s_left += here * here
        w_right += there
        s_right += there * there
    n_right = counts.sum(1)[None, :, None] - n_left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = s_left / w_left + s_right / w_right
    score[(n_left < plan.min_leaf) | (n_right < plan.min_leaf)] = -np.inf
    flat = score.transpose(1, 0, 2).reshape(nodes, -1)
    at = flat.argmax(1)
    weighed = counts * plan.weights
    whole = weighed.sum(1)
    gain = flat[np.arange(nodes), at] - np.square(weighed).sum(1) / whole
    gain = np.where(gain > 1e-12 * whole, gain, -np.inf)
    slot, cut = at // (bins - 1), at % (bins - 1)
    return slot, cut, gain, left[slot, np.arange(nodes), :, cut]


def grow_trees(x: np.ndarray, y: np.ndarray, classes: int, plan: Plan, rng: np.random.Generator, trees: int) -> list[Tree]:
    """Trees over bootstraps of the rows, level by level together; ``x`` is features x rows of bins, ``y`` the classes."""
    n = x.shape[1]
    flat = x.ravel()
    times = np.minimum(rng.poisson(1.0, (trees, n)), 255).astype(np.uint8).ravel()
    taken = np.flatnonzero(times)
    rows, at, times = (taken % n).astype(np.int32), (taken // n).astype(np.int32), times[taken]
    nodes, cells = _Nodes(), classes * BINS
    counts = np.bincount(at.astype(np.intp) * classes + y[rows], times, minlength=trees * classes).reshape(trees, classes)
    fallback = float((y == 1).mean()) if n else 0.0
    nodes.add(_share(counts, plan.weights, fallback), np.arange(trees))
    growable = lambda c: (c.sum(1) >= max(2, 2 * plan.min_leaf)) & (c.max(1) < c.sum(1))
    columns = np.array(plan.columns, dtype=np.intp)
    roots = growable(counts)
    place = np.where(roots, np.cumsum(roots) - 1, -1).astype(np.int32)[at]
    stays = place >= 0
    waiting = [(rows[stays], place[stays], times[stays], np.flatnonzero(roots).astype(np.int32), counts[roots], 0)]
    while waiting:
        rows, at, times, ids, counts, depth = waiting.pop()
        size = len(ids)
        if not size:
            continue
        if plan.subset < len(columns):
            picked = columns[rng.random((size, len(columns))).argsort(1)[:, :plan.subset]]
        else:
            picked = np.broadcast_to(columns, (size, len(columns)))
        shift = np.ascontiguousarray((picked * n).T)
        hist = np.zeros((len(shift), size * cells))
        for start in range(0, len(rows), CHUNK_ROWS):
            some, of = rows[start:start + CHUNK_ROWS], at[start:start + CHUNK_ROWS]
            base = (of.astype(np.intp) * classes + y[some]) * BINS
            weight = times[start:start + CHUNK_ROWS].astype(float)
            for slot, start_of in enumerate(shift):
                key = flat.take(start_of.take(of) + some)
                hist[slot] += np.bincount(base + key, weight, minlength=size * cells)
        slot, cut, gain, left = _best(hist.reshape(len(shift), size, classes, BINS), counts, plan)
        del hist
        split = np.flatnonzero(gain > -np.inf)
        if not len(split):
            continue
        left, feature, cut = left[split], picked[split, slot[split]], cut[split]
        children = np.stack([left, counts[split] - left], axis=1).reshape(-1, classes)
        parents = ids[split]
        first = nodes.add(_share(children, plan.weights, fallback), np.repeat(nodes.owner[parents], 2))
        nodes.feature[parents], nodes.cut[parents] = feature, cut
        nodes.below[parents] = first + 2 * np.arange(len(split), dtype=np.int32)
        if depth + 1 >= plan.max_depth:
            continue
        going = growable(children)
        if not going.any():
            continue
        # where the rows of a child stand among those that are cut further
        place = np.where(going, np.cumsum(going) - 1, -1).astype(np.int32)
        child = np.full((size, 2), -1, np.int32)
        child[split] = place.reshape(-1, 2)
        starts, bar = np.zeros(size, np.intp), np.zeros(size, np.uint8)
        starts[split], bar[split] = feature * n, cut
        child = child.ravel()
        moved, stand, counted = [], [], []
        for start in range(0, len(rows), CHUNK_ROWS):
            some, of = rows[start:start + CHUNK_ROWS], at[start:start + CHUNK_ROWS]
            new = child.take(of.astype(np.intp) * 2 + (flat.take(starts.take(of) + some) > bar.take(of)))
            stays = new >= 0
            moved.append(some[stays])
            stand.append(new[stays])
            counted.append(times[start:start + CHUNK_ROWS][stays])
        rows, at, times = np.concatenate(moved), np.concatenate(stand), np.concatenate(counted)
        ids, counts = (first + np.flatnonzero(going)).astype(np.int32), children[going]
        if len(ids) <= NODES:
            waiting.append((rows, at, times, ids, counts, depth + 1))
            continue
        group = at // NODES
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=math.ceil(len(ids) / NODES)))
        for g, (begin, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            mine, some = slice(g * NODES, (g + 1) * NODES), order[begin:end]
            waiting.append((rows[some], at[some] - g * NODES, times[some], ids[mine], counts[mine], depth + 1))
    return nodes.trees(trees)


def grow_tree(x: np.ndarray, y: np.ndarray, classes: int, plan: Plan, rng: np.random.Generator) -> Tree:
    return grow_trees(x, y, classes, plan, rng, 1)[0]


def add_scores(x: np.ndarray, trees: list[Tree], out: np.ndarray) -> None:
    """Adds the share of class 1 in each row's leaf of each tree to ``out``; ``x`` is features x rows."""
    for start in range(0, x.shape[1], SCORED_ROWS):
        some = np.ascontiguousarray(x[:, start:start + SCORED_ROWS])
        n = some.shape[1]
        flat, row = some.ravel(), np.arange(n)
        for feature, cut, below, p in trees:
            shift, below = feature.astype(np.intp) * n, below.astype(np.intp)
            node = np.zeros(n, np.intp)
            while True:
                after = below.take(node) + (flat.take(shift.take(node) + row) > cut.take(node))
                if np.array_equal(after, node):
                    break
                node = after
            out[start:start + n] += p.take(node)


def _tree_row(forest: int, number: int, tree: Tree) -> tuple:
    return (forest, number, tree.feature.tobytes(), tree.cut.tobytes(), tree.below.tobytes(), tree.p.tobytes())


def _tree(row) -> Tree:
    return Tree(np.frombuffer(row["feature"], np.int16), np.frombuffer(row["cut"], np.uint8),
                np.frombuffer(row["below"], np.int32), np.frombuffer(row["p"], np.float64))


def _subset(rule: str, features: int) -> int:
    found = {"sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))),
             "all": features, "onethird": math.ceil(features / 3)}
    if rule not in found:
        raise ValueError(f"unknown subset of features: {rule}")
    return min(features, found[rule])


def _class_weights(classes: dict[int, int], balanced: bool) -> np.ndarray:
    """n / (k · n_c) of each class, or 1."""
    total, weights = sum(classes.values()), np.ones(max(2, max(classes) + 1))
    if balanced:
        for c, n in classes.items():
            weights[c] = total / (len(classes) * n)
    return weights


def _plan(cuts: Cuts, view: list[str], trees: int, max_depth: int, min_leaf: int, subset: str,
          balanced: bool, seed: int) -> Plan:
    return Plan([cuts.features.index(c) for c in view], trees, max_depth, min_leaf, _subset(subset, len(view)),
                _class_weights(cuts.classes, balanced), seed)


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    """Every block in every one of so many partitions."""
    told = df.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return told.repartitionById(tasks, "task")


def _grower(plans: list[Plan], tasks: int):
    """``(task, x, y) -> (forest, number, tree), ...``: the trees of one task. Trees of few rows grow some at a
    time, as many whatever the tasks, so that the draws do not depend on the cores."""

    def grown(task: int, x: np.ndarray, y: np.ndarray):
        together = max(1, min(TREES_TOGETHER, ROWS_TOGETHER // max(1, len(y))))
        wanted = [(f, t) for f, plan in enumerate(plans) for t in range(0, plan.trees, together)]
        for f, t in wanted[task::tasks]:
            plan = plans[f]
            count = min(together, plan.trees - t)
            rng = np.random.default_rng([plan.seed, f, t])
            for i, tree in enumerate(grow_trees(x, y, len(plan.weights), plan, rng, count)):
                yield f, t + i, tree

    return grown


def _tasks(df: DataFrame, plans: list[Plan]) -> int:
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, sum(p.trees for p in plans)))


def _joined(found: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(features x rows, classes) of blocks given as (part, at, n, x, kept), in the order of their values: the
    draws do not depend on how the rows were dealt out."""
    x = np.concatenate([np.frombuffer(b[3], np.uint8).reshape(width, b[2]) for b in found], axis=1)
    y = np.concatenate([_kept(b[4]).column("y").to_numpy().astype(np.intp) for b in found])
    keys = [y]
    for at in range(0, width, 12):  # five bits a bin
        key = np.zeros(len(y), np.uint64)
        for row in x[at:at + 12]:
            key = key << np.uint64(5) | row
        keys.append(key)
    order = np.lexsort(keys)
    return x[:, order], y[order]


def _block_tuples(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[batch.column(c).to_pylist() for c in ("part", "at", "n", "x", "kept")], strict=True))


def grown_trees(rows: DataFrame, cuts: Cuts, target: str, plans: list[Plan]) -> DataFrame:
    """One row for each tree of all plans."""
    tasks, width = _tasks(rows, plans), len(cuts.features)
    grown = _grower(plans, tasks)
    y = F.col(target).cast("int").alias("y")

    def run(batches):
        found, task = [], None
        for batch in batches:
            if batch.num_rows:
                task = batch.column("task")[0].as_py()
                found += _block_tuples(batch)
        if found:
            x, y = _joined(found, width)
            found.clear()
            for f, t, tree in grown(task, x, y):
                yield pa.RecordBatch.from_pylist([dict(zip(_TREE_ARROW.names, _tree_row(f, t, tree), strict=True))], _TREE_ARROW)

    # a block's rows fill a task; few rows in many partitions would be as many tasks
    known = rows.filter(F.col(target).isNotNull()).coalesce(math.ceil(sum(cuts.classes.values()) / BLOCK_ROWS))
    return _dealt(blocks(known, cuts, [y]), tasks).mapInArrow(run, TREE_SCHEMA)


_TREE_ARROW = pa.schema([("forest", pa.int32()), ("tree", pa.int32()), ("feature", pa.binary()),
                         ("cut", pa.binary()), ("below", pa.binary()), ("p", pa.binary())])


# --- models --------------------------------------------------------------------------------


class GrownForest:
    """A fitted forest: cuts, settings, and its trees, collected if they are small, else as a table."""

    def __init__(self, cuts: Cuts, trees: list[Tree] | DataFrame, settings: dict, inputs: SQLTransformer | None = None):
        self.cuts, self.trees, self.settings, self.inputs = cuts, trees, settings, inputs
        self._sent = None

    @property
    def stages(self) -> list:
        return [*([self.inputs] if self.inputs else []), self]

    @property
    def getNumTrees(self) -> int:
        return self.settings["numTrees"]

    def getOrDefault(self, name: str):
        return self.settings[name]

    def prepared(self, df: DataFrame) -> DataFrame:
        return self.inputs.transform(df) if self.inputs else df

    def sent(self, spark: SparkSession):
        if self._sent is None:
            # plain arrays: workers need not know this package
            self._sent = spark.sparkContext.broadcast((tuple(self.cuts), [tuple(t) for t in self.trees]))
        return self._sent

    def save(self, spark: SparkSession, path: str) -> None:
        """The trees as a table, and what else there is as one row of JSON."""
        table = self.trees if isinstance(self.trees, DataFrame) else spark.createDataFrame(
            [_tree_row(0, t, tree) for t, tree in enumerate(self.trees)], TREE_SCHEMA)
        table.write.mode("overwrite").parquet(f"{path}/trees")
        cuts = self.cuts._asdict() | {"cuts": [c.tolist() for c in self.cuts.cuts], "classes": list(self.cuts.classes.items())}
        told = {"cuts": cuts, "settings": self.settings, "inputs": self.inputs.getStatement() if self.inputs else None}
        spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_forest(spark: SparkSession, path: str) -> GrownForest:
    told = json.loads(spark.read.schema("told string").parquet(f"{path}/settings").first()["told"])
    c = told["cuts"]
    cuts = Cuts(c["features"], c["fills"], [np.array(x, dtype=float) for x in c["cuts"]], dict(c["classes"]))
    inputs = SQLTransformer(statement=told["inputs"]) if told["inputs"] else None
    return GrownForest(cuts, _small(spark.read.schema(TREE_SCHEMA).parquet(f"{path}/trees")), told["settings"], inputs)


def _small(table: DataFrame) -> list[Tree] | DataFrame:
    """The trees of one forest in order if they are small, else the table; give it a written one."""
    size = table.agg(F.sum(sum(F.octet_length(c) for c in ("feature", "cut", "below", "p")))).first()[0] or 0
    if size > SMALL_BYTES:
        return table
    return [_tree(r) for r in table.orderBy("tree").collect()]


def grow_forests(
    train: DataFrame, views: list[list[str]], target: str, trees: int = 100, max_depth: int = 10,
    min_leaf: int = 1, subset: str = "sqrt", balanced: bool = True, seed: int = 42,
) -> list[GrownForest]:
    """A forest for each view, a list of columns, over the same rows; settings as ``random_forest`` has them."""
    features = list(dict.fromkeys(c for view in views for c in view))
    cuts = fit_cuts(train, features, target)
    plans = [_plan(cuts, view, trees, max_depth, min_leaf, subset, balanced, seed) for view in views]
    table = grown_trees(train, cuts, target, plans)
    settings = {"numTrees": trees, "maxDepth": max_depth, "minInstancesPerNode": min_leaf,
                "featureSubsetStrategy": subset, "seed": seed}
    if max_depth <= SMALL_DEPTH:
        found = {(r["forest"], r["tree"]): _tree(r) for r in table.collect()}
        return [GrownForest(cuts, [found[f, t] for t in range(trees)], settings) for f in range(len(views))]
    table = cut_lineage(table)
    return [GrownForest(cuts, _small(table.filter(F.col("forest") == f)), settings) for f in range(len(views))]


def forest_scores(df: DataFrame, models: dict[str, GrownForest]) -> DataFrame:
    """``df`` with a probability of class 1 for each named model of collected trees, in one pass."""
    sent = [m.sent(df.sparkSession) for m in models.values()]
    features = list(dict.fromkeys(c for m in models.values() for c in m.cuts.features))
    places = [[features.index(c) for c in m.cuts.features] for m in models.values()]
    schema = ", ".join(f"p{i} double" for i in range(len(sent)))

    @F.pandas_udf(schema)
    def score(*columns: pd.Series) -> pd.DataFrame:
        values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        out = {}
        for i, (b, at) in enumerate(zip(sent, places, strict=True)):
            cuts, trees = b.value
            total = np.zeros(len(values[0]))
            add_scores(_binned([values[k] for k in at], Cuts(*cuts)), trees, total)
            out[f"p{i}"] = total / len(trees)
        return pd.DataFrame(out)

    # one column, so that the function runs once whatever is taken from it
    made = df.withColumn("_p", score(*[F.col(c).cast("double") for c in features]))
    return made.select(*df.columns, *[F.col(f"_p.p{i}").alias(name) for i, name in enumerate(models)])


def forest_predict(model: GrownForest, df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns plus p1, prediction and confidence."""
    made = model.prepared(df)
    if isinstance(model.trees, DataFrame):
        scored = _scored_by_table(model, made, keep)
    else:
        scored = forest_scores(made, {"_p1": model}).select(*keep, F.col("_p1").alias("p1"))
    p = F.col("p1")
    return scored.select(*keep, "p1", decide(p).alias("prediction"), confidence(p).alias("confidence"))


def _decoded(summed: DataFrame, schema) -> DataFrame:
    """Rows of ``kept`` with the mean ``p1`` of the block's sums."""

    def rows(batches):
        for batch in batches:
            for kept, total, trees in zip(*[batch.column(c).to_pylist() for c in ("kept", "total", "trees")], strict=True):
                table = _kept(kept)
                p1 = np.frombuffer(total) / trees
                yield from table.append_column("p1", pa.array(p1)).to_batches()

    return summed.select("kept", "total", "trees").mapInArrow(rows, schema)


def _summed(parts: DataFrame) -> DataFrame:
    """``part, at, total``: sums of the blocks over the tasks, in the order of the tasks."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        total = sum(np.frombuffer(t) for t in pdf["total"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "at": [pdf["at"].iloc[0]], "total": [total.tobytes()]})

    return parts.groupBy("part", "at").applyInPandas(added, "part int, at int, total binary")


_SUM_SCHEMA = "part int, at int, task int, total binary"
_SUM_ARROW = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("task", pa.int32()), ("total", pa.binary())])


def _scored_by_table(model: GrownForest, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and p1: tasks take some trees each over all blocks, sums by row come together."""
    spark = df.sparkSession
    packed = cut_lineage(blocks(df, model.cuts, [F.col(c) for c in keep]))
    tasks = max(1, min(model.getNumTrees, 2 * spark.sparkContext.defaultParallelism))
    empty = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    none = lambda *names: [F.lit(None).cast("int").alias(c) for c in names]
    told = model.trees.select((F.col("tree") % tasks).alias("task"), *none("part", "at", "n"), *empty("x"),
                              "tree", "feature", "cut", "below", "p")
    asked = packed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).select(
        "task", "part", "at", "n", "x", *none("tree"), *empty("feature", "cut", "below", "p"))
    width = len(model.cuts.features)

    def run(batches):
        trees, found = [], []
        for batch in batches:
            for r in batch.to_pylist():
                (found if r["tree"] is None else trees).append(r)
        trees = [_tree(r) for r in sorted(trees, key=lambda r: r["tree"])]
        for r in found:
            total = np.zeros(r["n"])
            add_scores(np.frombuffer(r["x"], np.uint8).reshape(width, r["n"]), trees, total)
            yield pa.RecordBatch.from_pylist(
                [{"part": r["part"], "at": r["at"], "task": r["task"], "total": total.tobytes()}], _SUM_ARROW)

    parts = told.unionByName(asked).repartitionById(tasks, "task").mapInArrow(run, _SUM_SCHEMA)
    summed = packed.join(_summed(parts), ["part", "at"]).withColumn("trees", F.lit(model.getNumTrees))
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return _decoded(summed, f"{fields}, p1 double")


class ForestTrials:
    """Forests of many settings over the same rows, judged on the same rows: both are cut and packed once, trees
    are grown and asked in tasks and not kept."""

    def __init__(self, train: DataFrame, judged: DataFrame, features: list[str], target: str):
        self.cuts, self.features = fit_cuts(train, features, target), features
        y = F.col(target).cast("int").alias("y")
        self.train = cut_lineage(blocks(train.filter(y.isNotNull()), self.cuts, [y]))
        self.judged = cut_lineage(blocks(judged, self.cuts, [F.col(target)]))
        self.schema = f"`{target}` {dict(judged.dtypes)[target]}, p1 double"

    def scores(self, trees: int = 100, max_depth: int = 10, min_leaf: int = 1, subset: str = "sqrt",
               balanced: bool = True, seed: int = 42) -> DataFrame:
        """The target and p1 of each judged row by a forest of these settings."""
        plan = _plan(self.cuts, self.features, trees, max_depth, min_leaf, subset, balanced, seed)
        tasks, width = _tasks(self.train, [plan]), len(self.cuts.features)
        grown = _grower([plan], tasks)

        def run(batches):
            found, asked, task = [], [], None
            for batch in batches:
                if batch.num_rows:
                    task = batch.column("task")[0].as_py()
                    for teaches, block in zip(batch.column("teaches").to_pylist(), _block_tuples(batch), strict=True):
                        (found if teaches else asked).append(block)
            if not asked:
                return
            asked = [(part, at, np.frombuffer(x, np.uint8).reshape(width, n), np.zeros(n)) for part, at, n, x, _ in asked]
            x, y = _joined(found, width)
            found.clear()
            for _, _, tree in grown(task, x, y):
                for _, _, rows, total in asked:
                    add_scores(rows, [tree], total)
            for part, at, _, total in asked:
                yield pa.RecordBatch.from_pylist([{"part": part, "at": at, "task": task, "total": total.tobytes()}], _SUM_ARROW)

        both = self.train.withColumn("teaches", F.lit(True)).unionByName(
            self.judged.withColumns({"teaches": F.lit(False), "kept": F.lit(None).cast("binary")}))
        parts = _dealt(both, tasks).mapInArrow(run, _SUM_SCHEMA)
        return _decoded(self.judged.join(_summed(parts), ["part", "at"]).withColumn("trees", F.lit(trees)), self.schema)
