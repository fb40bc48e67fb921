"""Benchmark decontamination by spaced seeds.

A seed is the hash of six tokens at the selected positions of a mask; the tokens between them may
differ. An item that is shorter than a mask has one seed, all its tokens. Seeds of the benchmark and
of the documents are joined, the hits are reduced to one for each document, item and diagonal, and
every diagonal is verified: the item's tokens against the document's tokens beside them.

Before the join, two bit maps of fixed size, of the benchmark's tokens and of its seeds, thin out the
documents' positions inside each row. They let no hit go; what they pass in vain, the join drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.llm.common import computed_once, free_name, hand_over, null_safe_key, text_of
from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

#: Selected token positions. Spans are 8 and 9 tokens, weights 6.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 4, 7, 8), (0, 2, 3, 5, 6, 8))
#: Matching tokens in a run that count as an overlap; a mismatch costs as much as two matches.
MIN_TOKENS = 10
#: Or this share of the whole item, with substitutions anywhere.
MIN_SHARE = 0.7
#: Tokens of all items that may be sent to every executor: 8 MB.
BROADCAST_TOKENS = 1_000_000
#: Bits of each map, whatever the size of the benchmark.
MAP_BITS = 1 << 18


def tokens(text_col: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text_of(text_col)), r"[^\p{L}\p{N}]+"), "")


def _mask(mask_no: int) -> tuple[int, ...]:
    """A spaced mask, or beyond their number one of consecutive tokens."""
    return MASKS[mask_no] if mask_no < len(MASKS) else tuple(range(mask_no - len(MASKS) + 1))


def _seeds(hashes: Column, mask_no: int, keep=None) -> Column:
    """``array<struct<pos, seed>>`` of one mask, without positions of which a token is null."""
    mask = _mask(mask_no)
    starts = F.when(F.size(hashes) > mask[-1],
                    F.sequence(F.lit(0), F.size(hashes) - 1 - mask[-1])).otherwise(
        F.array().cast("array<int>"))
    known = F.filter(starts, lambda i: _all([F.get(hashes, i + o).isNotNull() for o in mask]))
    seeds = F.transform(known, lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.lit(mask_no), *[F.get(hashes, i + o) for o in mask]).alias("seed")))
    return F.filter(seeds, lambda s: keep(s["seed"])) if keep else seeds


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _slots(hashed: Column) -> list[Column]:
    return [hashed.bitwiseAND(F.lit(MAP_BITS - 1)),
            F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(MAP_BITS - 1).cast("long"))]


def _bit_map(values: DataFrame, col: str) -> Column:
    """Two bits per value in an array of MAP_BITS / 64 numbers, as a literal."""
    slot = values.select(F.explode(F.array(*_slots(F.col(col)))).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"),
                        F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    numbers = [0] * (MAP_BITS // 64)
    for row in words.collect():  # at most MAP_BITS / 64 rows
        numbers[row.word] = row.bits
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _is_in(bit_map: Column):
    def test(hashed: Column) -> Column:
        return _all([F.getbit(F.get(bit_map, F.shiftright(slot, 6).cast("int")),
                              slot.bitwiseAND(F.lit(63)).cast("int")) == 1 for slot in _slots(hashed)])
    return test


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  min_tokens: int = MIN_TOKENS, min_share: float = MIN_SHARE) -> DataFrame:
    """``id, item_id, matched, item_tokens, run, first_token``: a row per overlap.

    The best alignment of each (document id, item): ``matched`` tokens are equal along the whole item,
    ``run`` is the number of equal tokens in the best run, ``first_token`` the position in the
    document's tokens where the item begins, which is negative if its head is missing. An overlap
    has ``run >= min_tokens`` or ``matched >= min_share`` of the item. Items shorter than a mask's span
    are found where all their tokens stand in a row, whatever their number. Rows of equal id are reported
    together, null ids as null. Null and empty texts have no tokens; such items are in no document. Equal
    items are reported each.

    Of the documents, only rows with a position that passes both bit maps are written, as hashes. A hit
    carries numbers only; the tokens of an item and of a document are joined to a diagonal once.
    Seeds are broadcast up to a number of rows, items up to a number of tokens; the joins shuffle beyond.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(item_text_col).alias("t"))
    items = hand_over(items.filter(F.size("t") > 0).select(
        F.monotonically_increasing_id().alias("item_no"), "item_id",
        F.transform("t", lambda w: F.xxhash64(w)).alias("item")), "benchmark-items")
    size, span = F.size("item"), MASKS[0][-1] + 1
    all_tokens = items.agg(F.sum(size)).first()[0] or 0
    short = [r[0] for r in items.filter(size < span).select(size).distinct().collect()]  # below a span
    whole = [len(MASKS) + n - 1 for n in sorted(short)]  # a mask for each length
    own = [F.when(size >= span, _seeds(F.col("item"), n)) for n in range(len(MASKS))]
    own += [F.when(size == len(_mask(n)), _seeds(F.col("item"), n)) for n in whole]
    none = F.expr("cast(array() as array<struct<pos: int, seed: bigint>>)")
    seeds = items.select("item_no", size.alias("item_tokens"), F.explode(F.concat(
        *[F.coalesce(seed, none) for seed in own])).alias("s"))
    seeds = cut_lineage(seeds.select("item_no", "item_tokens", F.col("s.pos").alias("item_pos"),
                                     F.col("s.seed").alias("seed")))
    known_token = _is_in(_bit_map(items.select(F.explode("item").alias("token")), "token"))
    known_seed = _is_in(_bit_map(seeds, "seed"))

    hashed = F.transform(F.transform(tokens(text_col), lambda w: F.xxhash64(w)),
                         lambda h: F.when(known_token(h), h))
    rows = docs.select(F.col(id_col).alias("id"), hashed.alias("tokens"))
    found = F.concat(*[_seeds(F.col("tokens"), n, known_seed) for n in [*range(len(MASKS)), *whole]])
    rows = rows.select("id", "tokens", computed_once(found).alias("hits")).filter(F.size("hits") > 0)
    rows = hand_over(rows.select(F.monotonically_increasing_id().alias("row"), "id", "tokens", "hits"),
                     "decontamination-hits")

    hits = rows.select("row", F.explode("hits").alias("hit")).select(
        "row", F.col("hit.pos").alias("pos"), F.col("hit.seed").alias("seed"))
    diagonal = F.col("pos") - F.col("item_pos")
    # of a short item the first place is the best
    pairs = hits.join(broadcast_if_small(seeds), "seed").groupBy(
        "row", "item_no", F.when(F.col("item_tokens") >= span, diagonal).alias("long")).agg(
        F.min(diagonal).alias("first_token"), F.first("item_tokens").alias("item_tokens"))
    begin = F.greatest(F.col("first_token"), F.lit(0))
    pairs = pairs.join(rows.select("row", "id", "tokens"), "row").select(
        "id", "item_no", "first_token", begin.alias("begin"), F.slice(
            "tokens", begin + 1, F.greatest(F.col("first_token") + F.col("item_tokens") - begin, F.lit(0))
        ).alias("beside"))
    told = items.select("item_no", "item_id", "item")
    pairs = pairs.join(F.broadcast(told) if all_tokens <= BROADCAST_TOKENS else told, "item_no")
    same = F.transform("item", lambda token, n: F.coalesce(F.when(
        F.col("first_token") - F.col("begin") + n >= 0,
        F.get("beside", F.col("first_token") - F.col("begin") + n) == token), F.lit(False)))
    pairs = pairs.select("id", "item_id", "first_token", F.size("item").alias("item_tokens"),
                         computed_once(same).alias("same"))
    # best run: equal tokens gain 1, others cost 2, and a run ends where it is worth nothing
    best = F.aggregate(
        "same", F.expr("named_struct('worth', 0, 'equal', 0, 'run', 0, 'top', 0)"),
        lambda a, x: F.when(x, F.struct(
            (a["worth"] + 1).alias("worth"), (a["equal"] + 1).alias("equal"),
            F.when(a["worth"] + 1 > a["top"], a["equal"] + 1).otherwise(a["run"]).alias("run"),
            F.greatest(a["top"], a["worth"] + 1).alias("top"))).when(
            a["worth"] > 2, F.struct((a["worth"] - 2).alias("worth"), a["equal"].alias("equal"),
                                     a["run"].alias("run"), a["top"].alias("top"))).otherwise(
            F.struct(F.lit(0).alias("worth"), F.lit(0).alias("equal"), a["run"].alias("run"),
                     a["top"].alias("top"))))["run"]
    scored = pairs.select(
        "id", "item_id", "first_token", "item_tokens", best.alias("run"),
        F.size(F.filter("same", lambda x: x)).alias("matched"))
    overlap = (F.col("run") >= min_tokens) | (F.col("matched") >= F.col("item_tokens") * min_share)
    return scored.filter(overlap).groupBy("id", "item_id").agg(F.max(F.struct(
        "matched", "run", (-F.col("first_token")).alias("late"), "item_tokens")).alias("b")).select(
            "id", "item_id", F.col("b.matched").alias("matched"),
            F.col("b.item_tokens").alias("item_tokens"), F.col("b.run").alias("run"),
            (-F.col("b.late")).alias("first_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without an overlap with ``benchmark``; same columns. Rows are told apart by id
    and text, so that a clean row stays where its id has another text that leaks."""
    name = free_name(docs, "key")
    rows = docs.withColumn(name, F.concat(F.md5(text_of(text_col)), null_safe_key(id_col)))
    found = find_overlaps(rows, benchmark, name, text_col, item_col, item_text_col)
    leaks = cut_lineage(found.select(F.col("id").alias(name)).distinct())
    return rows.join(broadcast_if_small(leaks), name, "left_anti").select(*docs.columns)
