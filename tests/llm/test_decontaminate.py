"""Spaced seeds against an alignment of every document with every item."""

import random
import re
import time

from halflight.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """(doc, item) with 10 equal tokens in a run or 0.7 of the item on one diagonal."""
    found = {}
    for i, text in docs:
        w = words(text)
        for item, item_text in items:
            t = words(item_text)
            at = {}
            for n, x in enumerate(t):
                at.setdefault(x, []).append(n)
            diagonals = {p - n for p, x in enumerate(w) for n in at.get(x, ())}
            for g in diagonals:
                same = [0 <= g + n < len(w) and w[g + n] == x for n, x in enumerate(t)]
                if sum(same) < 7:
                    continue
                worth = equal = run = top = 0
                for x in same:
                    if x:
                        worth, equal = worth + 1, equal + 1
                        if worth > top:
                            top, run = worth, equal
                    elif worth > 2:
                        worth -= 2
                    else:
                        worth = equal = 0
                if run >= d.MIN_TOKENS or sum(same) >= 0.7 * len(t):
                    found[i, item] = max(found.get((i, item), (0, 0)), (sum(same), run))
    return found


def test_query_against_brute_force(spark):
    from halflight.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.matched, r.run) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert got == brute(docs, items) and got


def test_substitutions_pieces_and_clean_texts(spark):
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(3000)] + ["the", "of", "and"] * 200
    items = [(n, " ".join(rng.choices(vocabulary, k=40))) for n in range(20)]
    docs, leaked = [], set()
    for n in range(200):
        body = rng.choices(vocabulary, k=120)
        if n % 2:
            t = items[n % 20][1].split()
            for at in rng.sample(range(40), 4):
                t[at] = "changed"
            if n % 4 == 1:
                t = items[n % 20][1].split()[5:20]
            body[50:50] = t
            leaked.add((n, n % 20))
        docs.append((n, ", ".join(body).upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): (r.matched, r.run) for r in d.find_overlaps(df, bench).collect()}
    assert got == brute(docs, items)
    assert set(got) == leaked


def test_nulls_empty_long_ties_and_clashing_names(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "too short"), (None, item), (4, "")],
                                  "item_id long, text string")
    rows = [(1, None, 1), (2, "", 2), (3, item, 3), (3, item, 3), (None, item, 4),
            (5, "filler " * 40000 + item, 5), (None, "clean", 6), (7, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = d.find_overlaps(docs, bench).collect()
    assert sorted((r.id or 0, r.item_id or 0) for r in got) == [
        (0, 0), (0, 1), (3, 0), (3, 1), (5, 0), (5, 1)]
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.tokens for r in kept.collect()) == [1, 2, 6, 7]
    assert d.find_overlaps(docs.limit(0), bench).count() == 0
    assert d.find_overlaps(docs, bench.limit(0)).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_a_clean_row_beside_a_leaking_one_of_its_id_stays(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "clean"), (1, f"see {item}"), (2, item), (2, None), (None, item), (None, "clean")]
    kept = d.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "clean"), (2, None), (None, "clean")]


def test_short_items_are_found_whole_and_helper_names_may_clash(spark):
    items = [(1, "what is the capital of"), (2, "Paris?"), (3, "one two three four five six seven"),
             (4, "one two three four five six seven eight"), (5, "capital of")]
    docs = [(1, "So, what is the capital of France"), (2, "what is a capital of"), (3, "paris, Paris and paris"),
            (4, "one two three four five six"), (5, "zero one two three four five six seven eight"),
            (6, "capital"), (7, "of capital"), (None, "parisian")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "'x' as key", "'y' as _key", "'z' as _d_key", "0 as row", "0 as hits", "0 as item_no")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): (r.matched, r.item_tokens, r.first_token) for r in d.find_overlaps(df, bench).collect()}
    assert got == {(1, 1): (5, 5, 1), (1, 5): (2, 2, 4), (2, 5): (2, 2, 3), (3, 2): (1, 1, 0),
                   (5, 3): (7, 7, 1), (5, 4): (8, 8, 1)}
    kept = d.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {4, 6, 7, None}
    assert {(r.key, r._key, r._d_key) for r in kept.collect()} == {("x", "y", "z")}


def test_a_long_item_and_a_passage_that_many_items_hold(spark):
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(4000)]
    long_item = " ".join(rng.choices(vocabulary, k=10_000))
    passage = " ".join(rng.choices(vocabulary, k=30))
    items = [(0, long_item)] + [(n, f"{passage} own{n} words{n}") for n in range(1, 400)]
    words = long_item.split()
    words[100::50] = ["changed"] * len(words[100::50])
    docs = [(1, " ".join(words)), (2, f"see {passage} here"), (3, " ".join(rng.choices(vocabulary, k=5000)))]
    start = time.time()
    got = {(r.id, r.item_id): r.matched for r in d.find_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 0): 10_000 - len(words[100::50]), **{(2, n): 30 for n in range(1, 400)}}
    assert time.time() - start < 60
