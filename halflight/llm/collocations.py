"""Phrases whose words stand together more often than their parts would by chance.

Phrases are counted level by level, by their number of words. Each shard of documents sorts its
phrases and builds weighted acyclic automata from them, in blocks. Blocks are cut at the bounds of
prefix ranges, and the automata of a range are united and their weights summed, range by range. A part
of a frequent phrase is frequent, so a level counts only phrases whose two parts with one word less may
be frequent; a bit map of fixed size says so, which may err by counting too much, never too little.

At the end the frequent phrases of all levels are united in the same way, and the parts of every
phrase are looked up by composing the automaton of the parts asked for with that of the counts.

A null text is read as an empty one, a null language as ``und``. Repeated rows count again.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halflight.llm.common import hand_over, text_of
from halflight.llm.transducer import Transducer, compose, pack, pack_rows
from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

MIN_COUNT, MAX_WORDS = 100, 5
#: Words of one shard, phrases of one block, and phrases of all shards that one range holds on average.
SHARD_WORDS, BLOCK, RANGE_PHRASES = 4_000_000, 8192, 1_000_000
#: Bounds are kept by every task.
MAX_RANGES = 1 << 16
#: Bits of a map, whatever the input.
MAP_BITS = 1 << 24
#: Bytes of text that are split into words together.
CHUNK_BYTES = 1 << 20
UNKNOWN_LANGUAGE = "und"

BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes.maketrans(_UPPER + BREAKS, _UPPER.lower() + b"." * len(BREAKS))
_BLOCK_SCHEMA = "lang string, phrases long, occurrences long, first string, last string, blob binary"
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Vocabulary(dict):
    """word -> number in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def split_words(raw: bytes) -> list[bytes]:
    """Words of a lower-cased text, with ``.`` between pieces."""
    return raw.translate(_FOLD).replace(b".", b" . ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 13)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def phrase_hash(lang: str, words: list[bytes]) -> int:
    h = _seed(lang)
    for w in words:
        h = (h ^ _word_hash(w)) * _MIX & _MASK
        h ^= h >> 31
    return h


def _bits(h):
    """Two places in a map; for numbers and for arrays of them."""
    return h & (MAP_BITS - 1), h >> 32 & (MAP_BITS - 1)


def _hashes(lang: str, columns: list[np.ndarray], word_hashes: np.ndarray) -> np.ndarray:
    """``phrase_hash`` of many phrases, given as one array of word numbers for each position."""
    h = np.full(len(columns[0]), _seed(lang), np.uint64)
    for c in columns:
        h = (h ^ word_hashes[c]) * np.uint64(_MIX)
        h ^= h >> np.uint64(31)
    return h


def _in_map(bit_map: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for bits in (h & np.uint64(MAP_BITS - 1), h >> np.uint64(32) & np.uint64(MAP_BITS - 1)):
        found &= (bit_map[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _unique_rows(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows in ascending order without repeats, how often each was there or the sum of its counts)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    # two numbers below 2^31 fit one key
    keys = [rows[:, i] << 32 | rows[:, i + 1] if i + 1 < rows.shape[1] else rows[:, i]
            for i in range(0, rows.shape[1], 2)]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(starts, len(rows)))
    else:
        sums = np.add.reduceat(counts[order], starts)
    return rows[order[starts]], sums


class Shard:
    """Words of a bounded number of texts, and the blocks of their sorted phrases.

    ``orders`` are the lengths that are counted, in words; ``maps`` are the bit maps of frequent words
    and of frequent phrases of one word less than the least of the lengths, None where nothing is known.
    """

    def __init__(self, orders: tuple[int, ...], maps: tuple[np.ndarray | None, np.ndarray | None]):
        self.orders, (self.word_map, self.phrase_map) = orders, maps
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, _Vocabulary] = {}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[str]) -> None:
        found = split_words("\n".join([*texts, ""]).encode())
        if lang not in self.words:
            self.words[lang], self.parts[lang] = _Vocabulary({b".": 0}), []
        number = self.words[lang].__getitem__
        self.parts[lang].append(np.fromiter(map(number, found), np.int32, len(found)))
        self.size += len(found)

    def blocks(self):
        """Rows of ``_BLOCK_SCHEMA``; forgets the texts."""
        for lang, parts in self.parts.items():
            names = list(self.words[lang])
            hashes, kept = None, np.arange(1, len(names))
            if self.word_map is not None:  # rare words end a piece, as no frequent phrase holds them
                hashes = np.array([_word_hash(w) for w in names], np.uint64)
                kept = kept[_in_map(self.word_map, _hashes(lang, [kept], hashes))]
            sorted_ids = sorted(kept.tolist(), key=names.__getitem__)
            rank = np.full(len(names), -1, np.int64)
            rank[sorted_ids] = np.arange(len(sorted_ids))
            seen = rank[np.concatenate(parts)]
            words = [names[i] for i in sorted_ids]
            fits = self._frequent_within(lang, seen, None if hashes is None else hashes[sorted_ids])
            for order in self.orders:
                yield from _block_rows(lang, words, *_unique_rows(self._phrases(seen, order, fits)))
        self.clear()

    def _frequent_within(self, lang: str, seen: np.ndarray, hashes) -> np.ndarray | None:
        """For each place whether the phrase of one word less that begins there may be frequent."""
        if self.phrase_map is None:
            return None
        size = self.orders[0] - 1
        at = _places(seen, size)
        found = np.zeros(len(seen), bool)
        found[at[_in_map(self.phrase_map, _hashes(lang, [seen[at + i] for i in range(size)], hashes))]] = True
        return found

    def _phrases(self, seen: np.ndarray, order: int, fits: np.ndarray | None) -> np.ndarray:
        """Word numbers of all places of a phrase, one row each; without those that cannot be frequent."""
        at = _places(seen, order)
        for shift in range(order - self.orders[0] + 2) if fits is not None else ():
            at = at[fits[at + shift]]
        return np.column_stack([seen[at + i] for i in range(order)])


def _places(seen: np.ndarray, order: int) -> np.ndarray:
    """Where ``order`` words stand together."""
    n = max(0, len(seen) - order + 1)
    return np.flatnonzero(np.logical_and.reduce([seen[i:i + n] >= 0 for i in range(order)]))


def _block_rows(lang: str, words: list[bytes], rows: np.ndarray, counts: np.ndarray):
    join = lambda row: b" ".join([words[i] for i in row.tolist()]).decode()
    for at in range(0, len(rows), BLOCK):
        part, times = rows[at:at + BLOCK], counts[at:at + BLOCK]
        yield lang, len(part), int(times.sum()), join(part[0]), join(part[-1]), pack_rows(part, times, words)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["lang", "phrases", "occurrences", "first", "last", "blob"])


def count_shards(docs: DataFrame, orders: tuple[int, ...], word_map: bytes | None = None,
                 phrase_map: bytes | None = None) -> DataFrame:
    """Blocks of the phrases of ``orders`` words of every shard of (lang, text)."""

    def shards(batches):
        shard = Shard(orders, tuple(
            None if m is None else np.frombuffer(m, np.uint8) for m in (word_map, phrase_map)))
        for pdf in batches:
            for lang, texts in pdf.groupby("lang", sort=False)["text"]:
                chunk, size = [], 0
                for text in texts:
                    chunk.append(text)
                    size += len(text)
                    if size >= CHUNK_BYTES:
                        shard.add(lang, chunk)
                        chunk, size = [], 0
                        if shard.size >= SHARD_WORDS:
                            yield from map(_frame, _groups(shard.blocks()))
                shard.add(lang, chunk)
        yield from map(_frame, _groups(shard.blocks()))

    return docs.mapInPandas(shards, _BLOCK_SCHEMA)


def _groups(rows, size: int = 64):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def range_bounds(blocks: DataFrame, ranges: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """First (language, phrase) of every range but the lowest; ranges hold about as many blocks each."""
    heads = blocks.select("lang", "first").repartitionByRange(ranges, "lang", "first")
    least = heads.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("lang", "first")).alias("b"))
    return sorted({_place(r["b"]["lang"], r["b"]["first"]) for r in least.collect()})[1:]


def _place(lang: str, phrase: str) -> tuple[str, tuple[bytes, ...]]:
    return lang, tuple(phrase.encode().split(b" "))


def cut_blocks(blocks: DataFrame, bounds: list) -> DataFrame:
    """``range, lang, blob``: blocks, cut where a bound lies inside."""

    def cut(batches):
        for pdf in batches:
            out = []
            for lang, first, last, blob in zip(pdf["lang"], pdf["first"], pdf["last"], pdf["blob"], strict=True):
                low = bisect.bisect_right(bounds, _place(lang, first))
                high = bisect.bisect_right(bounds, _place(lang, last))
                if low == high:
                    out.append((low, lang, blob))
                    continue
                out += [(low + n, lang, part) for n, part in _cut(Transducer(blob), lang, bounds[low:high])]
            yield pd.DataFrame(out, columns=["range", "lang", "blob"])

    return blocks.select("lang", "first", "last", "blob").mapInPandas(
        cut, "range int, lang string, blob binary")


def _cut(t: Transducer, lang: str, bounds: list):
    """(how many bounds lie before it, part) of the parts of an automaton between the bounds."""
    tables = list(t.expand())
    if len(tables) == 1:  # phrases of one length come sorted
        rows, counts = tables[0]
        place = lambda i: (lang, tuple(t.words[x] for x in rows[i].tolist()))
        packed = lambda at, to: pack_rows(rows[at:to], counts[at:to], t.words)
    else:
        _, rows = _listed(t)
        place = lambda i: (lang, tuple(t.words[x] for x in rows[i][0]))
        packed = lambda at, to: pack(rows[at:to], t.words)
    ends = [bisect.bisect_left(range(len(rows)), b, key=place) for b in bounds] + [len(rows)]
    for n, (at, to) in enumerate(zip([0, *ends], ends, strict=False)):
        if to > at:
            yield n, packed(at, to)


def _listed(t: Transducer) -> tuple[list[bytes], list[tuple[tuple, int]]]:
    """(words, sorted phrases with their counts); the words of an automaton are in order."""
    found = [(tuple(p), n) for rows, counts in t.expand()
             for p, n in zip(rows.tolist(), counts.tolist(), strict=True)]
    return t.words, sorted(found)


class Union:
    """Phrases of many automata with their weights summed."""

    def __init__(self):
        self.words = _Vocabulary()
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting = 0

    def add(self, blob: bytes) -> None:
        t = Transducer(blob)
        number = np.array([self.words[w] for w in t.words], np.int64)
        for rows, counts in t.expand():
            self.tables.setdefault(rows.shape[1], []).append((number[rows], counts))
            self.waiting += len(rows)
        if self.waiting > 4 * RANGE_PHRASES:
            self.sum_up()

    def sum_up(self) -> None:
        for order, parts in self.tables.items():
            rows, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.tables[order] = [_unique_rows(rows, counts)]
        self.waiting = 0

    def phrases(self, least: int) -> tuple[list[bytes], list[tuple[tuple, int]]]:
        """(sorted words, sorted phrases of at least that count)."""
        self.sum_up()
        kept = [(rows[counts >= least], counts[counts >= least])
                for parts in self.tables.values() for rows, counts in parts]
        used = sorted({i for rows, _ in kept for i in np.unique(rows).tolist()}, key=list(self.words).__getitem__)
        names = list(self.words)
        rank = np.zeros(len(names), np.int64)
        rank[used] = np.arange(len(used))
        found = [(tuple(p), n) for rows, counts in kept
                 for p, n in zip(rank[rows].tolist(), counts.tolist(), strict=True)]
        return [names[i] for i in used], sorted(found)


def unite(blocks: DataFrame, least: int = 1) -> tuple[DataFrame, list]:
    """(``range`` and ``_BLOCK_SCHEMA``: one automaton for each language of a prefix range, of phrases
    counted ``least`` times; the bounds). A task takes its ranges one after the other."""
    total = blocks.agg(F.sum("phrases")).first()[0] or 0
    ranges = min(MAX_RANGES, 1 + total // RANGE_PHRASES)
    bounds = range_bounds(blocks, ranges) if ranges > 1 else []

    def finished(at, unions):
        for lang, union in unions.items():
            words, phrases = union.phrases(least)
            if phrases:
                join = lambda p, words=words: b" ".join([words[i] for i in p]).decode()
                yield (at, lang, len(phrases), sum(n for _, n in phrases), join(phrases[0][0]),
                       join(phrases[-1][0]), pack(phrases, words))

    def united(batches):
        at, unions = None, {}
        for pdf in batches:
            out = []
            for range_, lang, blob in zip(pdf["range"], pdf["lang"], pdf["blob"], strict=True):
                if range_ != at:
                    out += finished(at, unions)
                    at, unions = range_, {}
                unions.setdefault(lang, Union()).add(blob)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(finished(at, unions)), columns=names)

    schema = f"range int, {_BLOCK_SCHEMA}"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    rows = cut_blocks(blocks, bounds).repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    return rows.mapInPandas(united, schema), bounds


def phrase_rows(automata: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, count``: every phrase of the automata."""

    def rows(batches):
        for pdf in batches:
            for lang, blob in zip(pdf["lang"], pdf["blob"], strict=True):
                words, phrases = _listed(Transducer(blob))
                yield pd.DataFrame({
                    "lang": [lang] * len(phrases),
                    "phrase": [b" ".join([words[i] for i in p]).decode() for p, _ in phrases],
                    "n_words": [len(p) for p, _ in phrases], "count": [n for _, n in phrases]})

    return automata.select("lang", "blob").mapInPandas(
        rows, "lang string, phrase string, n_words int, count long")


def phrase_map(automata: DataFrame) -> bytes:
    """Bit map of the phrases; its parts reach the driver, ``MAP_BITS`` bits at most."""

    def bits(batches):
        for pdf in batches:
            for lang, blob in zip(pdf["lang"], pdf["blob"], strict=True):
                words, phrases = _listed(Transducer(blob))
                found = [b for p, _ in phrases for b in _bits(phrase_hash(lang, [words[i] for i in p]))]
                yield pd.DataFrame({"bit": found}, dtype="int64")

    # places of the bit map functions begin at 1
    place = F.col("bit") + 1
    parts = automata.select("lang", "blob").mapInPandas(bits, "bit long").groupBy(
        F.bitmap_bucket_number(place).alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    whole = bytearray(MAP_BITS // 8)
    for p in parts:
        start = (p["at"] - 1) * len(p["bits"])
        whole[start:start + len(p["bits"])] = p["bits"]
    return bytes(whole)


def count_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(automata of all phrases of 1 to ``max_words`` words counted ``least`` times, in blocks;
    ``lang, n``: all words of each language)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
                        text_of(text_col).alias("text"))
    steps = [(1,), *((n,) for n in range(2, min(max_words, 3) + 1))]
    if max_words > 3:  # so few are left that the longer ones are counted together
        steps.append(tuple(range(4, max_words + 1)))
    levels, totals, word_map, last_map = None, None, None, None
    for orders in steps:
        name = "-".join(map(str, orders))
        blocks = hand_over(count_shards(texts, orders, word_map, last_map), f"shards-{name}")
        if word_map is None:
            totals = cut_lineage(blocks.groupBy("lang").agg(F.sum("occurrences").alias("n")))
        found = hand_over(unite(blocks, least)[0], f"phrases-{name}").drop("range")
        levels = found if levels is None else levels.unionByName(found)
        if orders == steps[-1] or found.isEmpty():
            break
        last_map = phrase_map(found)
        if word_map is None:  # a phrase of two words needs no more than frequent words
            word_map, last_map = last_map, None
    return levels, totals


def look_up(asked: DataFrame, automata: DataFrame) -> DataFrame:
    """``lang, phrase, count`` of every (lang, phrase) of ``asked``, rows without repeats, that the
    automata hold. Each prefix range composes the automaton of what is asked with that of its counts."""
    united, bounds = unite(automata)

    def routed(batches):
        for pdf in batches:
            at = [bisect.bisect_right(bounds, _place(a, b)) for a, b in zip(pdf["lang"], pdf["phrase"], strict=True)]
            yield pdf.assign(range=at).astype({"range": "int32"})

    def answered(wanted: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        blobs = dict(zip(counts["lang"], counts["blob"], strict=True))
        for lang, phrases in wanted.groupby("lang")["phrase"]:
            if lang not in blobs:
                continue
            paths = sorted(_place(lang, p)[1] for p in phrases)
            words = sorted({w for p in paths for w in p})
            number = {w: i for i, w in enumerate(words)}
            request = pack(((tuple(number[w] for w in p), 0) for p in paths), words)
            out += [(lang, b" ".join(p).decode(), n)
                    for p, n in compose(Transducer(request), Transducer(blobs[lang]))]
        return pd.DataFrame(out, columns=["lang", "phrase", "count"])

    placed = asked.select("lang", "phrase").mapInPandas(routed, "lang string, phrase string, range int")
    return placed.groupBy("range").cogroup(united.select("range", "lang", "blob").groupBy("range")).applyInPandas(
        answered, "lang string, phrase string, count long")


def score_phrases(phrases: DataFrame, totals: DataFrame, automata: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, a, l, r, n, score`` of phrases of two words and more.

    Cut after its first k words a phrase has l and r, the counts of the two parts, and the score
    floor(1000 a n / (l r)), in whole numbers of 38 digits; the cut of the least score counts, the
    shortest first part among equal ones.
    """
    words = F.split("phrase", " ", -1)
    cuts = phrases.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("count").alias("a"), F.explode(
        F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), words.alias("w")).select(
        "lang", "phrase", "n_words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("tail"))
    cuts = hand_over(cuts, "cuts")
    asked = cuts.select("lang", F.col("head").alias("phrase")).unionByName(
        cuts.select("lang", F.col("tail").alias("phrase"))).distinct()
    counts = hand_over(look_up(asked, automata), "parts")
    part = lambda name, count: broadcast_if_small(counts).select(
        "lang", F.col("phrase").alias(name), F.col("count").alias(count))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(
        broadcast_if_small(totals), "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    wide = scored.withColumn("top", exact("a") * exact("n") * 1000).withColumn("below", exact("l") * exact("r"))
    best = wide.withColumn("score", F.expr("top div below")).groupBy("lang", "phrase", "n_words", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "n_words", "a", "b.l", "b.r", "n", "b.score")


def drop_covered(scored: DataFrame, phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Without phrases that stand inside a longer one counted at least ``percent`` of 100 times as often."""
    w, n = F.col("w"), F.col("n_words")
    inner = phrases.filter("n_words > 2").select("lang", "n_words", "count", F.split("phrase", " ", -1).alias("w"))
    inner = inner.select("lang", "count", "w", "n_words", F.explode(F.sequence(F.lit(2), n - 1)).alias("size"))
    inner = inner.select("lang", "count", "w", "size", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)).alias("at"))
    longer = inner.select("lang", F.array_join(F.slice(w, F.col("at"), F.col("size")), " ").alias("phrase"),
                          "count").groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    joined = scored.join(longer, ["lang", "phrase"], "left")
    return joined.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def mine_collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT,
    max_words: int = MAX_WORDS, percent: int = 100, top: int = 2000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score, then count,
    then the phrase itself in byte order. Ranks are found in parts of a language first."""
    automata, totals = count_phrases(docs, lang_col, text_col, least, max_words)
    phrases = hand_over(phrase_rows(automata), "phrases")
    left = drop_covered(score_phrases(phrases, totals, automata), phrases, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    for key, name in ((["lang", part], "_part"), (["lang"], "rank")):
        left = left.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(
            F.col(name) <= top)
    return left.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = 2000) -> str:
    """The same over ``documents`` in SQL: all phrases written out and counted."""
    upper = _UPPER.decode()
    return rf"""
WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN_LANGUAGE}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2),
    lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
  FROM split, (SELECT unnest(range(1, {max_words + 1})) AS m) WHERE len(w) >= m),
counted AS (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= {least}),
cand AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1),
cuts AS (SELECT *, array_to_string(list_slice(w, 1, k), ' ') AS head,
    array_to_string(list_slice(w, k + 1, m), ' ') AS tail
  FROM cand, (SELECT unnest(range(1, {max_words})) AS k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.c AS l, y.c AS r, n,
    CAST((1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c) AS BIGINT) AS score
  FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = head
  JOIN counted y ON y.lang = cuts.lang AND y.phrase = tail JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS longer
  FROM cand, (SELECT unnest(range(2, {max_words})) AS s), (SELECT unnest(range(1, {max_words})) AS i)
  WHERE s < m AND i + s - 1 <= m GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
