"""Exact interpolated quantiles of whole columns.

``percentile`` keeps a value histogram of the whole column in one task. Above a size
limit the ranks wanted are first bracketed by the mergeable sketch, the rows under
each bracket are counted, and the exact aggregate only sees rows inside the bracket.
Everything runs as a few map-side aggregates: no shuffle of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflight.functions.scoring import nan_to_null

DIRECT_ROWS = 1_000_000
SKETCH_ACCURACY = 20_000


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], direct_rows: int = DIRECT_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; NULL and NaN are left out."""
    base = df.select([nan_to_null(F.col(c).cast("double")).alias(f"q{i}") for i, c in enumerate(cols)])
    names = [f"q{i}" for i in range(len(cols))]
    counts = base.agg(*[F.count(n).alias(n) for n in names]).first()
    small = [n for n in names if 0 < counts[n] <= direct_rows]
    found: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    if small:
        row = base.agg(
            *[F.percentile(n, F.array(*[F.lit(p) for p in probs])).alias(n) for n in small]
        ).first()
        found.update({n: list(row[n]) for n in small})
    wanted = {}
    for n in names:
        if counts[n] > direct_rows:
            for j, p in enumerate(probs):
                at = (counts[n] - 1) * p
                wanted[(n, j)] = (math.floor(at), math.ceil(at), at - math.floor(at))
    if wanted:
        ranks = {(n, r) for (n, _), (lo, hi, _) in wanted.items() for r in (lo, hi)}
        values = _select_ranks(base, sorted(ranks), dict(counts.asDict()), direct_rows)
        for (n, j), (lo, hi, part) in wanted.items():
            low, high = values[(n, lo)], values[(n, hi)]
            found[n][j] = low + (high - low) * part
    return {c: found[n] for c, n in zip(cols, names)}


def _select_ranks(base, ranks, sizes, direct_rows):
    """Value at each 0-based rank, by narrowing brackets until the rows inside are few."""
    brackets = {key: (float("-inf"), float("inf"), 0, sizes[key[0]]) for key in ranks}
    values: dict = {}
    while True:
        open_keys = [k for k in ranks if k not in values]
        if not open_keys:
            return values
        few = [k for k in open_keys if brackets[k][3] <= direct_rows]
        if few:
            row = base.agg(
                *[
                    F.sort_array(F.collect_list(_inside(k[0], brackets[k]))).alias(f"v{i}")
                    if brackets[k][3] <= 1000
                    else F.percentile(
                        _inside(k[0], brackets[k]), _share(k[1], brackets[k])
                    ).alias(f"v{i}")
                    for i, k in enumerate(few)
                ]
            ).first()
            for i, k in enumerate(few):
                got = row[f"v{i}"]
                values[k] = got[k[1] - brackets[k][2]] if isinstance(got, list) else got
            continue
        eps = 3.0 / SKETCH_ACCURACY
        guess = base.agg(
            *[
                F.percentile_approx(
                    _inside(k[0], brackets[k]),
                    [
                        max(0.0, _share(k[1], brackets[k]) - eps),
                        min(1.0, _share(k[1], brackets[k]) + eps),
                    ],
                    SKETCH_ACCURACY,
                ).alias(f"g{i}")
                for i, k in enumerate(open_keys)
            ]
        ).first()
        aggs = []
        for i, k in enumerate(open_keys):
            lo, hi = guess[f"g{i}"]
            c = F.col(k[0])
            aggs += [
                F.count(F.when(c < lo, 1)).alias(f"b{i}"),
                F.count(F.when((c >= lo) & (c <= hi), 1)).alias(f"n{i}"),
                F.count(F.when(c == lo, 1)).alias(f"l{i}"),
                F.count(F.when(c == hi, 1)).alias(f"h{i}"),
            ]
        seen = base.agg(*aggs).first()
        for i, k in enumerate(open_keys):
            lo, hi = guess[f"g{i}"]
            below, inside = seen[f"b{i}"], seen[f"n{i}"]
            at_lo, at_hi = seen[f"l{i}"], seen[f"h{i}"]
            r = k[1]
            if below <= r < below + at_lo:
                values[k] = lo
            elif below + inside - at_hi <= r < below + inside:
                values[k] = hi
            elif below + at_lo <= r < below + inside - at_hi:
                # strictly between the two guesses: hot end values drop out of the bracket
                lo_open, hi_open = math.nextafter(lo, math.inf), math.nextafter(hi, -math.inf)
                brackets[k] = (lo_open, hi_open, below + at_lo, inside - at_lo - at_hi)
            else:
                old_lo, old_hi, old_below, old_n = brackets[k]
                if r < below:
                    brackets[k] = (old_lo, math.nextafter(lo, -math.inf), old_below, below - old_below)
                else:
                    rest = old_below + old_n - below - inside
                    brackets[k] = (math.nextafter(hi, math.inf), old_hi, below + inside, rest)


def _inside(name, bracket):
    c = F.col(name)
    return F.when((c >= F.lit(bracket[0])) & (c <= F.lit(bracket[1])), c)


def _share(rank, bracket):
    return (rank - bracket[2]) / max(1, bracket[3] - 1)
