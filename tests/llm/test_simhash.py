"""SimHash near-duplicates against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from halflight.llm import simhash
from halflight.llm.components import connected_components


def brute_print(text, k=3):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace(
            "\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, max_bits=3):
    """{id: print} to {id: smallest id it reaches}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def unsigned(x):
    return x & (1 << 64) - 1


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.select("doc_id", "text").collect()}
    want = brute_components(prints)
    from halflight.llm.queries import QUERIES

    got = QUERIES["op10_simhash"](spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("block", [4, 1024])
def test_planted_bits_link_through_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    values = {}
    for c in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            values[len(values)] = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
    values = {i: v for i, v in enumerate(sorted(set(values.values())))}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values.values()], "fingerprint long")
    pairs = connected_components(simhash.links(df), "a", "b").collect()
    by_value = {v: i for i, v in values.items()}
    root = {by_value[unsigned(r.node)]: r.root for r in pairs}
    want = brute_components(values)
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(i)
    got = {}
    for i in values:
        got.setdefault(root.get(i, ("alone", i)), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_all_position_sets_cover():
    from itertools import combinations

    for d in range(7):
        sets = simhash.position_sets(d)
        assert all(any(set(s) <= set(kept) for s in sets) for kept in combinations(range(8), 8 - d))


def test_nulls_empty_ties_and_clashing_names(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two three four", "d"),
            (4, "one two three four", "e"), (None, "one two three four", "f"), (None, None, "g"),
            (9, "x " * 30000 + "y", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string") \
        .withColumn("fingerprint", F.lit(1)).withColumn("id", F.lit(2))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.component for r in got if r.fingerprint == 0} == {1}
    assert {r.component for r in got if r.id == 4} == {4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_long_chain_is_one_component(spark):
    n = 40
    df = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(df, "a", "b")
    assert got.count() == n and got.select("root").distinct().count() == 1


def test_an_id_with_different_texts_is_different_documents(spark):
    a, b, c = (" ".join(f"{w}{n}" for n in range(60)) for w in "abc")
    for rows, want in (([(1, a), (1, c)], [(1, a), (1, c)]),
                       ([(0, b), (1, a), (1, b)], [(0, b), (1, a)]),
                       ([(1, a), (1, a), (2, c), (2, a)], [(1, a), (2, c)]),
                       ([("x", a), ("x", c), ("xy", c), (None, b)], [("x", a), ("x", c), (None, b)])):
        kind = "string" if rows[0][0] == "x" else "long"
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_of_equal_rows_the_first_by_its_other_columns_stays(spark):
    text = "one of two rows that are equal in id and text"
    rows = [(1, text, "b", "k"), (1, text, "a", "k"), (1, text, None, "k"), (2, "quite another text here", "c", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _s_key string")
    df = df.selectExpr("*", "'m' as key")
    for parts in (1, 5):
        kept = simhash.keep_one(df.repartition(parts, "source"))
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect())) == [(1, text, "a", "k", "m"),
                                                      (2, "quite another text here", "c", "l", "m")]
    only = df.select("text", "doc_id")
    assert simhash.keep_one(only).columns == ["text", "doc_id"] and simhash.keep_one(only).count() == 2
