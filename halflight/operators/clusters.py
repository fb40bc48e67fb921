"""K-means of every number of clusters and every seeding in one pass over the rows per round."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflight.session import cut_lineage

# Seedings of a clustering, and rounds of each at most.
SEEDINGS, ROUNDS = 10, 300
#: A run ends when no centre moves farther than this.
TOLERANCE = 1e-4
#: Distances that a task holds at once, few enough to stay near the processor, and rows written as one.
BLOCK, PACKED = 250_000, 2048


class Run(NamedTuple):
    k: int
    seeding: int
    inertia: float
    rounds: int
    centres: list[list[float]]


def cluster_runs(train: DataFrame, features: str = "features", ks: range = range(2, 11),
                 seedings: int = SEEDINGS, seed: int = 42, rounds: int = ROUNDS) -> list[Run]:
    """One run for each k and seeding, by k and seeding; ``features`` is a vector column.

    Centres are seeded by the squares of the distances to those before, one pass for each centre of
    the largest k: a row draws a waiting time at a rate of its square, and the shortest wins, so that
    the parts of a table need no common total. A round of all runs that still move is one pass too.
    What reaches the driver are sums by centre, whose number does not depend on the rows.

    Rows without features are left out, equal rows count each. With fewer distinct rows than k a run
    has a centre for each; without rows it has none and its inertia is 0.
    """
    rows = train.filter(F.col(features).isNotNull()).select(
        vector_to_array(features).alias("x"), F.monotonically_increasing_id().alias("row"))
    # rows keep their numbers and are dealt evenly: a file of one row group would be one task in every pass
    rows = cut_lineage(rows.repartition(train.sparkSession.sparkContext.defaultParallelism, "row"))
    mean = rows.groupBy(F.lit("all")).agg(Summarizer.mean(array_to_vector("x"))).first()  # none without rows
    plan = [(k, s) for k in ks for s in range(seedings)]
    if mean is None:
        return [Run(k, s, 0.0, 0, []) for k, s in plan]
    rows = cut_lineage(rows.mapInPandas(_packed, "x binary, row binary"))
    shift = mean[1].toArray()  # distances are taken near the origin, where they lose no digits
    places = _seeded(rows, shift, plan, seed)
    made = [0] * len(plan)
    moving = list(range(len(plan)))
    for _ in range(rounds):
        if not moving:
            break
        still = []
        sums = _assigned(rows, shift, {r: places[r] for r in moving})
        for r in moving:
            new = places[r].copy()
            for centre, (n, _, total) in sums.get(r, {}).items():
                new[centre] = total / n
            made[r] += 1
            if np.square(new - places[r]).sum(1).max() > TOLERANCE ** 2:
                still.append(r)
            places[r] = new
        moving = still
    costs = _assigned(rows, shift, dict(enumerate(places)))
    return [Run(k, s, float(sum(cost for _, cost, _ in costs.get(r, {}).values())), made[r],
                (places[r] + shift).tolist()) for r, (k, s) in enumerate(plan)]


def best_run(runs: list[Run], k: int) -> Run:
    """The run of least inertia among those of one k, the first seeding on a tie."""
    return min((r for r in runs if r.k == k), key=lambda r: (r.inertia, r.seeding))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Many rows as one, so that a pass reads matrices instead of making them again."""
    for batch in batches:
        for at in range(0, len(batch), PACKED):
            part = batch.iloc[at:at + PACKED]
            yield pd.DataFrame({"x": [np.stack(part["x"].to_numpy()).astype(float).tobytes()],
                                "row": [part["row"].to_numpy().astype(np.uint64).tobytes()]})


def _batches(batches: Iterator[pd.DataFrame], shift: np.ndarray, centres: int):
    """Packed rows as matrices around ``shift``, so many that a matrix of distances fits."""
    step = max(1, BLOCK // max(centres, 1))
    for batch in batches:
        for x, row in zip(batch["x"], batch["row"], strict=True):
            numbers = np.frombuffer(row, np.uint64)
            places = np.frombuffer(x).reshape(len(numbers), -1) - shift
            for at in range(0, len(numbers), step):
                yield places[at:at + step], numbers[at:at + step]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = np.square(x).sum(1)[:, None] - 2 * x @ centres.T + np.square(centres).sum(1)
    return np.maximum(gaps, 0.0)


def _uniform(row: np.ndarray, salt: int) -> np.ndarray:
    """Numbers over 0 and up to 1, the same for a row and a salt in every attempt of a task."""
    with np.errstate(over="ignore"):
        z = row + np.uint64(salt * 0x9E3779B97F4A7C15 % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53


def _seeded(rows: DataFrame, shift: np.ndarray, plan: list[tuple[int, int]], seed: int) -> list[np.ndarray]:
    chosen: list[list] = [[] for _ in plan]
    for step in range(max(k for k, _ in plan)):
        wanted = {r: np.array(chosen[r]) for r, (k, _) in enumerate(plan)
                  if step < k and len(chosen[r]) == step}

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[float, list]] = {}
            for x, row in _batches(batches, shift, max(step, 1)):
                for r, centres in wanted.items():
                    rate = _squares(x, centres).min(1) if step else np.ones(len(x))
                    # what is left of a row's distance to itself is rounding
                    rate[rate <= 1e-12 * np.square(x).sum(1)] = 0
                    with np.errstate(divide="ignore"):
                        wait = -np.log(_uniform(row, ((seed * 1000 + r) * 1000 + step) * 2 + 1)) / rate
                    at = int(np.nanargmin(np.where(rate > 0, wait, np.inf)))
                    if rate[at] > 0 and (r not in best or wait[at] < best[r][0]):
                        best[r] = (float(wait[at]), x[at].tolist())
            if best:
                yield pd.DataFrame([(r, w, c) for r, (w, c) in best.items()], columns=["run", "wait", "x"])

        if not wanted:
            break
        drawn = rows.mapInPandas(draw, "run int, wait double, x array<double>").groupBy("run").agg(
            F.min_by("x", F.struct("wait", "x")).alias("x"))
        for run, x in drawn.collect():  # a row for each run
            chosen[run].append(x)
    return [np.array(c) for c in chosen]


def _assigned(rows: DataFrame, shift: np.ndarray, places: dict[int, np.ndarray]):
    """``{run: {centre: (rows, sum of squares, sum of vectors)}}`` of one pass, rows at the nearest centre."""
    order = list(places)
    bounds = np.cumsum([0] + [len(places[r]) for r in order])
    every = np.concatenate([places[r] for r in order])
    # runs of as many centres are told together
    alike: dict[int, list[int]] = {}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        alike.setdefault(int(b - a), []).append(int(a))
    alike.pop(0, None)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost = np.zeros(len(every), np.int64), np.zeros(len(every))
        sums = np.zeros(every.shape)
        for x, _ in _batches(batches, shift, len(every)):
            gaps = _squares(x, every)
            mine = np.zeros(gaps.shape)
            for k, starts in alike.items():
                columns = np.add.outer(starts, np.arange(k))
                nearest = gaps[:, columns].argmin(2) + np.array(starts)
                np.put_along_axis(mine, nearest, 1.0, axis=1)
                n += np.bincount(nearest.ravel(), minlength=len(every))
                cost += np.bincount(nearest.ravel(), np.take_along_axis(gaps, nearest, axis=1).ravel(), len(every))
            sums += mine.T @ x
        held = np.flatnonzero(n)
        if len(held):
            yield pd.DataFrame({"place": held, "n": n[held], "cost": cost[held], "sums": list(sums[held])})

    totals = rows.mapInPandas(gather, "place int, n long, cost double, sums array<double>").groupBy(
        "place").agg(F.sum("n"), F.sum("cost"), Summarizer.sum(array_to_vector("sums")))
    out: dict[int, dict[int, tuple]] = {}
    for place, n, cost, total in totals.collect():  # a row for each centre of each run
        at = int(np.searchsorted(bounds, place, side="right")) - 1
        out.setdefault(order[at], {})[place - int(bounds[at])] = (n, cost, total.toArray())
    return out
