"""SpotSigs against a word-by-word version."""

import hashlib
import re

from pyspark.sql import functions as F

from halflight.llm import spotsigs as s

SF = "/root/testdata/sf0.01"


def brute_chains(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    found = set()
    for i, w in enumerate(words):
        if w in s.ANCHORS:
            content, gap = [], 0
            for x in words[i + 1:]:
                if len(content) == s.CHAIN or gap > s.GAP:
                    break
                gap = gap + 1 if x in s.ANCHORS else 0
                content += [x] if x not in s.ANCHORS else []
            if len(content) == s.CHAIN:
                found.add((w, *content))
    return found or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_query_against_brute_force(spark):
    from halflight.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    got = QUERIES["op3_spotsigs"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by_text = {}
    for r in got:
        text, follow = texts[r.doc_id], texts[after[r.doc_id]]
        k = len(text) // 3
        edited = text[:len(text) - k] + follow[:k]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = brute_chains(text)
        assert r.n_signatures == len(own) == len(r.fingerprint) // 8
        assert abs(r.near_edited - jaccard(own, brute_chains(edited))) < 1e-9
        assert abs(r.near_next - jaccard(own, brute_chains(follow))) < 1e-9
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_nulls_ties_short_and_long(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "ab", 0), (4, "x😀é" * 3, 0), (4, "the big dog ran", 0),
            (None, "the last one here", 0), (9, "the red fox " * 20000, 0), (8, "the " * 30000 + "end of it all", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sigs int").withColumn("id", F.lit(1))
    got = {(r.id, r.text): r for r in s.compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    assert got[3, "ab"].edited == "ab"
    assert got[4, "x😀é" * 3].edited == "x😀é" * 2 + "ab"
    assert got[1, ""].next_sigs == got[None, "the last one here"].sigs
    assert got[None, "the last one here"].edited == "the last one here"[:12] + "the r"
    one = spark.createDataFrame([(5, "the red fox ran")], "doc_id long, text string")
    row = s.digest(s.compare_with_next(one)).first()
    assert row.near_next == 1.0
    assert s.compare_with_next(one.limit(0)).count() == 0


def test_lengths_prune(spark):
    df = spark.sql("select array(1L,2,3,4) a, array(1L,2,3,4,5) b, array(1L) c")
    row = df.select(s.likeness(F.col("a"), F.col("b"), 0.8).alias("x"), s.likeness(F.col("a"), F.col("c"), 0.8).alias("y"),
                    s.likeness(F.col("a"), F.col("c")).alias("z"), (s.length_partition(F.col("b"), 0.8)
                    - s.length_partition(F.col("a"), 0.8)).alias("d")).first()
    assert (row.x, row.y, row.z) == (0.8, 0.0, 0.25) and 0 <= row.d <= 1
