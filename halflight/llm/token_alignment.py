"""Alignment of two tokenizers over the same text.

Both tokenizers encode a document as a whole. Places where a token of both ends and the next token of
both begins with a space are anchors, verified by their byte offsets; they cut the document into
windows, pairs of token-id runs. What is linked inside a window depends on its ids alone, so it is
worked out once and looked up by the ids of both, packed into bytes, afterwards. So is what it
spells: only whole windows are compared with the text.

Tokens whose bytes end together are linked. Byte offsets where tokens of both end cut a document into
groups. A document whose tokens do not spell its text, byte for byte, has no tokens, like an empty or
null one.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halflight.llm.common import hand_over, text_of
from halflight.session import cut_lineage

#: Bytes of text that are tokenised and handed on together.
CHUNK_BYTES = 1 << 19
#: Window alignments kept in a process.
MEMO = 300_000
NONE = np.zeros(0, np.int64)
#: Groups written out (None: the two spell differently), linked pairs and text of a window.
Window = tuple[str | None, bytes, bytes]
#: What ``align`` gives for a text without tokens.
NO_TOKENS = 0, 0, 0, "", NONE, NONE
#: Id pairs whose counts are sent to every executor; 24 bytes each.
HOT_PAIRS = 400_000
# Fixed value: where the byte-level vocabulary may not merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
           ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
_SCHEMA = "n_a long, n_b long, n_groups long, groups string, a array<int>, b array<int>, times array<int>"


class ByteTokens:
    """A byte-level vocabulary; a space stands before the text.

    Its merges come in the order of their ids, which is checked, so that ids are ranks to merge by.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = byte_letters()
        ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(ids[a + b] != len(byte_of) + i for i, (a, b) in enumerate(merges)):
            raise ValueError("merges are not in the order of their ids")
        ranks = {bytes(byte_of[c] for c in name): i for name, i in ids.items()}
        self.model = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """A vocabulary of sentence pieces, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
            else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves,
    the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Two tokenizers and the window alignments worked out so far."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.size_arrays = [np.array([len(x) for x in t.bytes]) for t in (a, b)]
        # an id as it is written: inside a run, and last of A and of B in a group
        self.written = [f"{i}{end}" for i in range(max(map(len, self.size_arrays))) for end in ",|;"]
        self.written_sizes = np.array(list(map(len, self.written)))
        self.spaced = [np.array([x.startswith(b" ") for x in t.bytes]) for t in (a, b)]
        self.memo: dict[bytes, Window] = {}  # by the ids of A, then those of B turned negative by ~

    def _windows(self, keys: list[bytes]) -> list[Window]:
        """Windows, given by their packed ids, worked out together."""
        ids = np.frombuffer(b"".join(keys), np.int32)
        of_b = ids < 0
        ids_a, ids_b = ids[~of_b], ~ids[of_b]
        spelt, other = (b"".join(map(t.bytes.__getitem__, ids.tolist()))
                        for t, ids in ((self.a, ids_a), (self.b, ids_b)))
        # tokens up to the end of each window, and where every token ends
        upto = np.cumsum(list(map(len, keys))) // 4
        upto_b = np.cumsum(of_b)[upto - 1]
        upto_a = upto - upto_b
        ends_a, ends_b = (np.cumsum(sizes[ids]) for sizes, ids in zip(self.size_arrays, (ids_a, ids_b), strict=True))
        bounds, bounds_b = (np.append(0, ends)[upto] for ends, upto in ((ends_a, upto_a), (ends_b, upto_b)))
        if spelt != other or (bounds != bounds_b).any():  # some are spelt in two ways
            if len(keys) == 1:
                return [(None, b"", b"")]
            return [self._windows([key])[0] for key in keys]
        there = np.zeros((2, len(spelt) + 1), bool)
        there[0, ends_a], there[1, ends_b] = True, True
        last_a, last_b = there[1, ends_a], there[0, ends_b]
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        # tokens in the order they are written in: those of A of a group, then those of B
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[np.arange(len(ids_a)) + np.append(0, at_b + 1)[np.cumsum(last_a) - last_a]] = 3 * ids_a + last_a
        codes[np.arange(len(ids_b)) + at_a[np.cumsum(last_b) - last_b] + 1] = 3 * ids_b + 2 * last_b
        groups = "".join(map(self.written.__getitem__, codes.tolist()))
        pairs = (ids_a[at_a].astype("<i8") << 32 | ids_b[at_b]).tobytes()
        to_group = np.cumsum(self.written_sizes[codes])[upto - 1].tolist()
        to_pair = (8 * np.cumsum(last_a)[upto_a - 1]).tolist()
        found, from_group, from_pair, start = [], 0, 0, 0
        for group, pair, end in zip(to_group, to_pair, bounds.tolist(), strict=True):
            found.append((groups[from_group:group - 1], pairs[from_pair:pair], spelt[start:end]))
            from_group, from_pair, start = group, pair, end
        return found

    def anchors(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each stand before every anchor, the document's end included."""
        cuts = []
        for ids, sizes, spaced in zip((ids_a, ids_b), self.size_arrays, self.spaced, strict=True):
            before = np.flatnonzero(spaced[ids[1:]]) + 1
            cuts.append((before, np.cumsum(sizes[ids])[before - 1]))
        (before_a, places_a), (before_b, places_b) = cuts
        there = np.zeros((2, 1 + max(places_a[-1:].tolist() + places_b[-1:].tolist(), default=0)), bool)
        there[0, places_a], there[1, places_b] = True, True
        return (np.append(before_a[there[1, places_a]], len(ids_a)),
                np.append(before_b[there[0, places_b]], len(ids_b)))

    def align(self, text: str, ids_a: list[int], ids_b: list[int]):
        """(tokens of A, of B, groups, groups written out, linked pairs, how often each) of a document;
        a pair is one number, the id of A above that of B."""
        if not text:
            return NO_TOKENS
        array_a, array_b = np.array(ids_a, np.int32), np.array(ids_b, np.int32)
        ends_a, ends_b = self.anchors(array_a, array_b)
        in_a, in_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        packed = np.empty(len(ids_a) + len(ids_b), np.int32)
        packed[np.arange(len(ids_a)) + np.repeat(ends_b - in_b, in_a)] = array_a
        packed[np.arange(len(ids_b)) + np.repeat(ends_a, in_b)] = ~array_b
        packed, ends = packed.tobytes(), ((ends_a + ends_b) * 4).tolist()
        keys = [packed[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        memo = self.memo
        found = list(map(memo.get, keys))
        if None in found:
            if len(memo) >= MEMO:
                memo.clear()
                found = [None] * len(keys)
            places = [i for i, window in enumerate(found) if window is None]
            new = list({keys[i] for i in places})
            memo.update(zip(new, self._windows(new), strict=True))
            for i in places:
                found[i] = memo[keys[i]]
        # both vocabularies spell the same in every window, and all windows together the text
        groups = [w[0] for w in found]
        if None in groups or b"".join([w[2] for w in found]) != b" " + text.encode():
            return NO_TOKENS
        links = b"".join([w[1] for w in found])
        links = np.frombuffer(links, "<i8")
        pairs, times = np.unique(links, return_counts=True)
        return len(ids_a), len(ids_b), len(links), ";".join(groups), pairs, times


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The two tokenizers of the files, read once in each process; every executor must have them."""
    return Aligner(ByteTokens(byte_path), PieceTokens(piece_path))


def align_tokens(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, n_a, n_b, n_groups, groups, a, b, times``, one row per row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of both vocabularies in order. ``a[i]`` and ``b[i]`` are
    linked ``times[i]`` times in the document. The id may be of any type, null or repeated; other
    columns of ``docs`` are left out. Texts pass in chunks of bounded size.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(_SCHEMA).fields])
    return rows.mapInArrow(lambda batches: _aligned(batches, byte_path, piece_path), schema)


def _aligned(batches, byte_path: str, piece_path: str):
    work = aligner(byte_path, piece_path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_BYTES):
                size += len(texts[to])
                to += 1
            part = texts[at:to]
            rows = [work.align(*row) for row in zip(
                part, work.a.encode(part), work.b.encode(part), strict=True)]
            found = [list(c) for c in zip(*[r[:4] for r in rows], strict=True)]
            arrays = [pa.array(x, kind) for x, (_, kind) in zip(found, _FIELDS, strict=False)]
            ends = np.cumsum([0, *[len(r[4]) for r in rows]]).astype(np.int32)
            pairs = np.concatenate([r[4] for r in rows])
            for values in (pairs >> 32, pairs & 0xFFFFFFFF, np.concatenate([r[5] for r in rows])):
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), *arrays], ["id", *[n for n, _ in _FIELDS]])
            at = to


def pair_counts(links: DataFrame) -> DataFrame:
    """``a, b, count, best``: how often each pair is linked in all documents, and whether no other pair
    of its ``b`` is linked more often. Counts are summed before rows move."""
    counts = cut_lineage(links.groupBy("a", "b").agg(F.sum("times").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return cut_lineage(counts.join(most, "b").select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def link_statistics(aligned: DataFrame, row: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``row, n_links, n_best, count_sum`` of every row of ``aligned`` that has links.

    The most frequent pairs, ``hot_pairs`` at most, are sent to every executor and answer nearly all
    links where they are; only links of the rarer pairs are shuffled to their counts.
    """
    links = aligned.select(row, F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select(
        row, "l.a", "l.b", F.col("l.times").cast("long").alias("times"))
    counts = pair_counts(links)

    def summed(counted: DataFrame) -> DataFrame:
        return counted.groupBy(row).agg(
            F.sum("times").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"))

    if counts.limit(hot_pairs + 1).count() <= hot_pairs:
        return summed(links.join(F.broadcast(counts), ["a", "b"]))
    hot = cut_lineage(counts.orderBy(F.desc("count"), "a", "b").limit(hot_pairs))
    rare = links.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
    parts = summed(links.join(F.broadcast(hot), ["a", "b"])).unionByName(summed(rare.join(
        counts.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti"), ["a", "b"])))
    return parts.groupBy(row).agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def alignment_report(
    docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``n_best`` counts the links whose pair is linked as often as any pair of its B id, ``count_sum``
    adds up how often the pair of each link is linked in all documents. Rows without tokens have zeros
    and an empty digest. Links are written once as a table and read twice.
    """
    found = align_tokens(docs, byte_path, piece_path, id_col, text_col)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    kept = hand_over(found.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups",
        digest.alias("groups_sha256"), "a", "b", "times"), "alignment")
    stats = link_statistics(kept, "row", hot_pairs)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return kept.drop("a", "b", "times").join(stats, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"),
        zero("count_sum"), "groups_sha256")
