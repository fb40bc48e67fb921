"""SimHash near-duplicates over an inverted index of byte positions.

A fingerprint of 64 bits is eight positional bytes. Fingerprints that differ in at most d bits share
at least 8 - d of them. The index is keyed by sets of positions with their bytes, chosen so that any
8 - d positions contain one of the sets; within a list the shared positional bytes of each pair are
tallied, pairs below the guaranteed minimum go, and the rest is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflight.llm.common import free_name, text_of
from halflight.llm.components import connected_components
from halflight.session import cut_lineage

SHINGLE, MAX_BITS, HASH_SEED = 3, 3, 42
#: Fingerprints of one list that meet in one task; longer lists meet block by block.
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit number, 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in zip(
        starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``id, fingerprint``, one row per row of ``docs``; null text is the empty text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "fingerprint": [
                fingerprint(t, shingle) for t in batch["text"]]})

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInPandas(
        run, f"id {kind}, fingerprint long")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any 8 - max_bits positions contain at least one.

    The eight positions are dealt into groups; by the pigeonhole principle one group holds at least
    ``need`` of the kept positions, so all sets of ``need`` positions inside the groups will do.
    """
    if not 0 <= max_bits <= 6:
        raise ValueError("max_bits must be 0 to 6")
    kept = 8 - max_bits
    groups = [range(8)] if kept == 8 else [range(4), range(4, 8)] if kept >= 3 else [range(8)]
    need = -(-kept // len(groups))
    return [s for g in groups for s in combinations(g, min(need, len(g)))]


def _posting_keys(max_bits: int):
    """One number per set of positions: the set's own number above its bytes."""
    byte = {p: F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)}
    keys = []
    for n, positions in enumerate(position_sets(max_bits)):
        parts = [F.shiftleft(byte[p], 8 * i) for i, p in enumerate(positions)]
        key = parts[0]
        for part in parts[1:]:
            key = key.bitwiseOR(part)
        keys.append(F.xxhash64(F.lit(n), key) if len(positions) > 6 else key.bitwiseOR(
            F.lit(n << 48 if len(positions) > 4 else n << 40).cast("long")))
    return F.array(*keys)


def _linked(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Local root, as an index, of each value: components of links inside one list."""
    root = np.full(len(values), -1)
    for start in range(len(values)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            rest = np.flatnonzero(root < 0)
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                near |= _within(values[front[at:at + 256]], values[rest], max_bits).any(axis=0)
            front = rest[near]
            root[front] = start
    return root


def _within(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Tally of shared positional bytes, then the count filter, then the bits of what is left."""
    differ = a[:, None] ^ b[None, :]
    shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)
    found = shared >= 8 - max_bits
    found[found] = np.bitwise_count(differ[found]) <= max_bits
    return found


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that span the same components as all pairs within ``max_bits`` bits.

    ``prints`` has distinct values ``fingerprint``. A list longer than ``BLOCK`` is cut into blocks
    by hash, and each pair of blocks is a group of its own, so that no task holds more than two
    blocks. A group gives one row per linked fingerprint (it and its local root), never its pairs.
    """
    post = prints.select("fingerprint", F.explode(_posting_keys(max_bits)).alias("key"))
    sizes = post.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    post = post.join(sizes, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    post = post.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    post = post.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = post.groupBy("key", F.least("own", "other").alias("i"),
                          F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fingerprint").alias("values")).filter(F.size("values") > 1).select("values")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for values in batch["values"]:
                values = np.asarray(values, np.int64).view(np.uint64)
                root = _linked(values, max_bits)
                moved = np.flatnonzero(root != np.arange(len(values)))
                a.append(values[moved])
                b.append(values[root[moved]])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64),
                                    "b": np.concatenate(b).view(np.int64)})

    return groups.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``id, fingerprint, component``: one row per row of ``docs``.

    ``component`` is the smallest id that can be reached over links of at most ``max_bits`` differing
    bits, itself included. Equal fingerprints are one node, so copies cost one row however many they
    are. Null and empty texts have fingerprint 0 and link like any other. A null id has no rank: its
    component is the smallest id that is known, null if there is none. Equal ids are separate rows.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    prints = cut_lineage(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = connected_components(links(prints, max_bits), "a", "b")
    prints = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    prints = cut_lineage(prints.select("fingerprint", "least",
                                       F.coalesce("root", "fingerprint").alias("root")))
    named = prints.groupBy("root").agg(F.min("least").alias("component"))
    prints = prints.join(named, "root").select("fingerprint", "component")
    return rows.join(prints, "fingerprint").select("id", "fingerprint", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` of which one stays per group: that with the smallest id.

    Rows are told apart by id and text, so that an id with different texts is as many documents: of
    its rows in one group, that with the least md5 stays. A row without an id goes by its text. Of rows
    equal in id and text that stays whose other columns, written as JSON, sort first.
    """
    own = F.col(id_col)
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        # strings that sort as the numbers do
        own = F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-2 ** 63))), 16, "0")
    digest = F.md5(text_of(text_col))
    # the zero byte sorts an id before those that it begins
    key = F.when(own.isNull(), F.concat(F.lit("~"), digest)).otherwise(
        F.concat(F.lit("="), own.cast("string"), F.lit("\0"), digest))
    name = free_name(docs, "key")
    rows = docs.withColumn(name, key)
    found = near_duplicates(rows, name, text_col, shingle, max_bits)
    stay = found.select(F.col("component").alias(name)).distinct()
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("")
    one = rows.join(stay, name, "left_semi").groupBy(name).agg(
        F.min_by(F.struct(*docs.columns), order).alias("kept"))
    return one.select("kept.*")


def hex_digits(col: str = "fingerprint"):
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")
