"""Temperature mixing of sources.

Shares of tokens are raised to an exponent and normalised. The exponent is bisected until the mix
meets a target entropy or a limit on repetition. The weights become quotas, and the quotas become
documents: each source is dealt out in seeded permutations, one per epoch, and the stream is cut into
blocks in which every source has its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halflight.llm.common import null_safe_key
from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

#: No source is dealt out more often than this, while the largest is dealt out once.
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
SEED = 17
#: Hex digits that cut a source's permutation into even parts for the running sums.
PART_DIGITS = 3
#: Exponents tried at once when the entropy decides.
SECTIONS = 16


def token_count(text_col: str = "text"):
    """Words as told by white space: separators and one, at least one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + F.lit(1)


def source_sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, tokens, docs``: one row per source; null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(token_count(text_col)).cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("docs"))


def _bisect(meets, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """Smallest exponent that meets a condition which large exponents meet."""
    if meets(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    return high


def exponent_for_repeats(sizes: DataFrame, max_repeats: float = MAX_REPEATS) -> float:
    """Flattest mix in which no source is repeated over ``max_repeats`` times as often as another."""
    if max_repeats < 1:
        raise ValueError("max_repeats must be at least 1")
    small, large = sizes.agg(F.min("tokens"), F.max("tokens")).first()
    if not small:
        return 1.0
    ratio = math.log(large / small)
    return _bisect(lambda a: (1 - a) * ratio <= math.log(max_repeats))


def exponent_for_entropy(sizes: DataFrame, target: float) -> float:
    """Exponent at which the mix has ``target`` nats; 0 or 1 where the target is out of reach.

    Each round tries ``SECTIONS`` exponents in one aggregation over the sources, so that the number
    of sources is not bounded by the driver.
    """
    total = sizes.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total)))

    def entropies(points: list[float]) -> list[float]:
        aggs = []
        for a in points:
            aggs += [F.sum(F.exp(share * a)), F.sum(F.exp(share * a) * share * a)]
        got = sizes.agg(*aggs).first()
        return [math.log(got[2 * i]) - got[2 * i + 1] / got[2 * i] for i in range(len(points))]

    low, high = 0.0, 1.0
    while high - low > 1e-9:
        points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        found = entropies(points)
        if found[0] <= target:
            return points[0]
        if found[-1] >= target:
            return points[-1]
        i = next(i for i, h in enumerate(found) if h <= target)
        low, high = points[i - 1], points[i]
    return high


def quotas(sizes: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """``source, tokens, weight, quota, budget``: tokens that each source gives to the mix.

    Without a budget it is the least one from which no document is left out: the source with the
    fewest repeats is dealt out once.
    """
    powered = sizes.withColumn("powered", F.pow(F.col("tokens").cast("double"), F.lit(exponent)))
    total = powered.agg(F.sum("powered"), F.max(F.col("tokens") / F.col("powered"))).first()
    whole = total[0] or 1.0
    budget = budget if budget is not None else round(whole * (total[1] or 0.0))
    weight = F.col("powered") / F.lit(whole)
    quota = F.round(weight * F.lit(float(budget))).cast("long")
    return powered.select("source", "tokens", weight.alias("weight"), quota.alias("quota"),
                          F.lit(budget).cast("long").alias("budget"))


def _dealt(docs: DataFrame, plan: DataFrame, id_col: str, text_col: str, source_col: str,
           seed: int) -> DataFrame:
    """Each row once per epoch that its source's quota reaches, with its place in the permutation."""
    epochs = plan.filter("quota > 0").select(
        null_safe_key("source").alias("_m_key"), F.col("tokens").alias("_m_total"),
        F.col("quota").alias("_m_quota"), F.col("budget").alias("_m_budget"))
    rows = docs.withColumn("_m_source", null_safe_key(source_col)).join(
        broadcast_if_small(epochs), F.col("_m_source") == F.col("_m_key")).drop("_m_key")
    rows = rows.withColumn("_m_epoch", F.explode(F.expr(
        "sequence(0, cast(ceil(_m_quota / _m_total) as int) - 1)")))
    place = F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col("_m_epoch").cast("string"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return rows.withColumn("_m_place", place)


def mixture_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", max_repeats: float | None = MAX_REPEATS,
                 target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Quotas of the sources. One row per source; written once."""
    sizes = cut_lineage(source_sizes(docs, text_col, source_col))
    exponent = (exponent_for_entropy(sizes, target_entropy) if target_entropy is not None
                else exponent_for_repeats(sizes, max_repeats or 1.0))
    return cut_lineage(quotas(sizes, exponent, budget))


def block_permutations(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", source_col: str = "source",
                       block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
                       drop_key: bool = True) -> DataFrame:
    """The mix as ``id, source, tokens, epoch, block, place``, one row per use of a document.

    A use belongs to the mix if the tokens before it in its source's permutations are under the
    source's quota, so that a source passes its quota by less than one document. The use at the share
    x of its source's quota goes to the block at the share x of all blocks; ``place`` orders a block.
    Null text counts as empty, a null source is a source, rows with equal id and text share a place.
    Running sums never meet in one task: sums per part of the permutation come first.
    """
    rows = _dealt(docs, plan, id_col, text_col, source_col, seed).select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), "_m_source",
        token_count(text_col).cast("long").alias("tokens"), F.col("_m_epoch").alias("epoch"),
        F.col("_m_place").alias("place"), "_m_total", "_m_quota", "_m_budget",
        F.substring("_m_place", 1, PART_DIGITS).alias("_m_part"))
    part = ["_m_source", "epoch", "_m_part"]
    sums = cut_lineage(rows.groupBy(*part).agg(F.sum("tokens").alias("_m_sum")))
    before = sums.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(
        Window.partitionBy("_m_source", "epoch").orderBy("_m_part")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m_sum")
    inside = Window.partitionBy(*part).orderBy("place", "id", "tokens")
    rows = rows.withColumn("_m_inside", F.coalesce(F.sum("tokens").over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before, part)
    start = F.col("epoch") * F.col("_m_total") + F.col("_m_before") + F.col("_m_inside")
    blocks = F.ceil(F.col("_m_budget") / F.lit(float(block_tokens)))
    return rows.withColumn("_m_start", start).filter("_m_start < _m_quota").select(
        "id", "source", "_m_source", "tokens", "epoch",
        F.floor(F.col("_m_start") / F.col("_m_quota") * blocks).cast("long").alias("block"),
        "place").drop("_m_source" if drop_key else "_")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", max_repeats: float | None = MAX_REPEATS,
                  target_entropy: float | None = None, budget: int | None = None,
                  seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix uses it; the same columns.

    Texts are not shuffled: the permutations are settled on narrow rows, and what returns is one last
    place per source and epoch.
    """
    plan = mixture_plan(docs, id_col, text_col, source_col, max_repeats, target_entropy, budget)
    used = block_permutations(docs, plan, id_col, text_col, source_col, seed=seed, drop_key=False)
    last = cut_lineage(used.groupBy("_m_source", "epoch").agg(F.max("place").alias("_m_last")))
    last = last.toDF("_l_source", "_l_epoch", "_m_last")
    rows = _dealt(docs, plan, id_col, text_col, source_col, seed)
    rows = rows.join(broadcast_if_small(last), (F.col("_m_source") == F.col("_l_source"))
                     & (F.col("_m_epoch") == F.col("_l_epoch")))
    return rows.filter("_m_place <= _m_last").select(*docs.columns)


def oracle(max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS,
           seed: int = SEED) -> str:
    return f"""
WITH t AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), ' ' || chr(10) || chr(9)
      || chr(13), '')) + 1 AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS total FROM t GROUP BY source),
a AS (SELECT CASE WHEN max(total) = min(total) THEN 0.0
        ELSE greatest(0.0, 1 - ln({max_repeats}) / ln(max(total) / min(total))) END AS e FROM s),
p AS (SELECT source, total, pow(total::DOUBLE, e) AS powered FROM s, a),
b AS (SELECT sum(powered) AS whole, round(sum(powered) * max(total / powered)) AS budget FROM p),
q AS (SELECT source, total, budget, round(powered / whole * budget)::BIGINT AS quota FROM p, b),
u AS (SELECT t.doc_id, t.source, t.tokens, total, quota, budget,
        unnest(range(0, ceil(quota / total)::BIGINT)) AS epoch, digest
      FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
v AS (SELECT *, md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest)
        AS place FROM u),
w AS (SELECT *, epoch * total + coalesce(sum(tokens) OVER (PARTITION BY source, epoch
        ORDER BY place, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS start FROM v)
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch::INT AS epoch,
  floor(start / quota * ceil(budget / {block_tokens}.0))::BIGINT AS block, place
FROM w WHERE start < quota"""
