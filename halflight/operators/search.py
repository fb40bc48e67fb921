"""Search over settings, guided by the trials so far.

A space names each setting: a list is a choice, ``(lo, hi)`` a uniform range and ``(lo, hi, 'log')`` a
log-uniform one. After a few random trials the finished ones are split into the best and the rest. For
each setting two densities are made, one of the best and one of the rest, and of some draws from the
first that one is proposed which it favours most against the second.

Trials run on rungs of growing effort; after each rung only the best share of them goes on. Every trial
is a Spark job; trials of one round run side by side. The table of trials is small and on the driver.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the finished trials that count as the best, and draws per proposal.
BEST_SHARE, DRAWS = 0.25, 24
#: Random trials before the first that is guided.
STARTUP = 6


class Trial(NamedTuple):
    """One trial: its settings, the share of the full effort it got, its score there, what else is known,
    and whether a rung stopped it."""

    number: int
    settings: dict
    effort: float
    score: float
    facts: dict
    stopped: bool


def draw(space: dict, rng: random.Random) -> dict:
    """Settings drawn evenly from the space."""
    return {name: _place(spec, rng.random()) if isinstance(spec, tuple) else rng.choice(spec)
            for name, spec in space.items()}


def _place(spec: tuple, share: float) -> float:
    """The value of a range that stands at ``share`` of it."""
    if len(spec) == 3:
        return math.exp(math.log(spec[0]) + share * (math.log(spec[1]) - math.log(spec[0])))
    return spec[0] + share * (spec[1] - spec[0])


def _share(spec: tuple, value: float) -> float:
    if len(spec) == 3:
        return (math.log(value) - math.log(spec[0])) / (math.log(spec[1]) - math.log(spec[0]))
    return (value - spec[0]) / (spec[1] - spec[0])


class _Choices:
    """How often each choice was taken, and once more than that."""

    def __init__(self, spec: list, seen: list):
        self.spec = spec
        self.weights = [1.0 + sum(v == c for v in seen) for c in spec]

    def draw(self, rng: random.Random):
        return rng.choices(self.spec, self.weights)[0]

    def density(self, value) -> float:
        return self.weights[self.spec.index(value)] / sum(self.weights)


class _Range:
    """A bell around every value seen, as wide as the way to its neighbours, and an even share."""

    def __init__(self, spec: tuple, seen: list[float]):
        self.spec, self.at = spec, sorted(_share(spec, v) for v in seen)
        marks = [0.0, *self.at, 1.0]
        least = 1.0 / (1.0 + len(self.at))
        self.wide = [min(1.0, max(least / 2, marks[i + 1] - marks[i], marks[i + 2] - marks[i + 1]))
                     for i in range(len(self.at))]

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.at) + 1)
        if i == len(self.at):
            return _place(self.spec, rng.random())
        while True:
            share = rng.gauss(self.at[i], self.wide[i])
            if 0.0 <= share <= 1.0:
                return _place(self.spec, share)

    def density(self, value: float) -> float:
        x, total = _share(self.spec, value), 1.0
        for at, wide in zip(self.at, self.wide, strict=True):
            edge = lambda e, at=at, wide=wide: math.erf((e - at) / (wide * math.sqrt(2.0)))
            inside = (edge(1.0) - edge(0.0)) / 2
            total += math.exp(-((x - at) / wide) ** 2 / 2) / (wide * math.sqrt(2 * math.pi)) / inside
        return total / (len(self.at) + 1)


def propose(space: dict, finished: list[tuple[dict, float]], rng: random.Random, startup: int = STARTUP) -> dict:
    """Settings to try next after (settings, score) of the finished trials; higher scores are better."""
    if len(finished) < startup:
        return draw(space, rng)
    ranked = sorted(finished, key=lambda t: -t[1])
    n_best = max(2, math.ceil(BEST_SHARE * len(ranked)))
    found = {}
    for name, spec in space.items():
        kind = _Range if isinstance(spec, tuple) else _Choices
        best = kind(spec, [s[name] for s, _ in ranked[:n_best]])
        rest = kind(spec, [s[name] for s, _ in ranked[n_best:]])
        found[name] = max((best.draw(rng) for _ in range(DRAWS)),
                          key=lambda v: math.log(best.density(v)) - math.log(rest.density(v)))
    return found


def search(
    space: dict, evaluate: Callable[[dict, float], tuple[float, dict]], n_trials: int, parallel: int = 4,
    rungs: tuple[float, ...] = (1.0,), keep: float = 0.5, seed: int = 42, guided: bool = True,
) -> list[Trial]:
    """``n_trials`` trials in rounds of ``parallel``; ``evaluate(settings, effort)`` gives (score, facts).

    ``rungs`` are growing shares of the full effort, the last of them 1. At each but the last, a trial
    goes on if its score is among the best ``keep`` of all scores on that rung so far. Without ``guided``
    all trials are random draws. The same seed and scores give the same trials.
    """
    if not rungs or rungs[-1] != 1.0 or list(rungs) != sorted(rungs):
        raise ValueError("rungs must grow to 1")
    rng, done = random.Random(seed), []
    on_rung: list[list[float]] = [[] for _ in rungs]
    with ThreadPoolExecutor(parallel) as threads:
        while len(done) < n_trials:
            # a stopped trial tells of its settings too: its place is below all that went further
            known = _by_effort(done) if guided else []
            started = [(len(done) + i, propose(space, known, rng, STARTUP if guided else n_trials + 1))
                       for i in range(min(parallel, n_trials - len(done)))]
            running = started
            for rung, effort in enumerate(rungs):
                got = list(threads.map(lambda t, effort=effort: evaluate(t[1], effort), running))
                on_rung[rung] += [score for score, _ in got]
                last = rung == len(rungs) - 1
                ranked = sorted(on_rung[rung], reverse=True)
                bar = ranked[max(0, math.ceil(keep * len(ranked)) - 1)]
                going = []
                for (number, settings), (score, facts) in zip(running, got, strict=True):
                    if last or score < bar:
                        done.append(Trial(number, settings, effort, score, facts, not last))
                    else:
                        going.append((number, settings))
                running = going
    return sorted(done)


def _by_effort(done: list[Trial]) -> list[tuple[dict, float]]:
    """(settings, place): trials of more effort stand above those of less, then by score."""
    ranked = sorted(done, key=lambda t: (t.effort, t.score))
    return [(t.settings, float(i)) for i, t in enumerate(ranked)]


def trials_table(spark: SparkSession, trials: list[Trial], facts: str) -> DataFrame:
    """``trial, settings`` (JSON)``, effort, score, stopped``, the ``facts`` ("name type, ...") and
    ``is_best``: the best score of a trial with full effort, the earliest of equal ones."""
    names = [f.strip().split(" ")[0] for f in facts.split(",")]
    rows = [(t.number, json.dumps(t.settings, sort_keys=True), t.effort, t.score, t.stopped,
             *[t.facts.get(n) for n in names]) for t in trials]
    table = spark.createDataFrame(
        rows, f"trial int, settings string, effort double, score double, stopped boolean, {facts}")
    return table.withColumn("is_best", F.col("trial") == best_trial(trials).number)


def best_trial(trials: list[Trial]) -> Trial:
    return max((t for t in trials if not t.stopped), key=lambda t: (t.score, -t.number))
