"""Collocations and their automata against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from check_queries import compare, connect

from halflight.llm import collocations, queries
from halflight.llm.transducer import Transducer, compose, pack, pack_rows


def brute(rows, least=3, top=2000, max_words=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = tuple(re.findall(r"[^ \t]+", piece))
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang][words[i:i + m]] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if a >= cand[p[i:i + m]]:
                        covered.add(p[i:i + m])
        rows = []
        for p, a in cand.items():
            if p in covered:
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def drawn(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "Of", "new", "york", "san", "josé", "a\x01b", "日本", "x", "y"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "])
                           for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None]), text()) for _ in range(n)]
    return rows + [("en", "New York City Hall stands " * 40), ("en", None), (None, ""), ("und", "the the")] + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_counting(spark, monkeypatch, small):
    if small:  # many shards, blocks and ranges, and a map that lets nearly all pass
        monkeypatch.setattr(collocations, "SHARD_WORDS", 300)
        monkeypatch.setattr(collocations, "CHUNK_BYTES", 500)
        monkeypatch.setattr(collocations, "RANGE_PHRASES", 60)
    rows = drawn(120)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "lang string, text string, n long").repartition(3)
    got = collocations.mine_collocations(docs, least=3).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_ties_and_top(spark):
    rows = [("en", "b a. a b. c d")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.mine_collocations(docs, least=3, top=2).orderBy("rank").collect()
    assert [(r.rank, r.phrase) for r in got] == [(1, "c d"), (2, "a b")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine_collocations(docs).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_collocations(spark, sf)
    assert compare(got, connect(sf), queries.ORACLES["op13_collocations"]) is None


def test_automaton_gives_back_its_phrases():
    rng = random.Random(4)
    words = [b"a", b"b", b"c", b"d", b"e"]
    phrases = {tuple(rng.randrange(5) for _ in range(rng.randint(1, 4))): rng.randint(1, 10**12) for _ in range(300)}
    t = Transducer(pack(sorted(phrases.items()), words))
    found = {tuple(p): n for rows, counts in t.expand() for p, n in zip(rows.tolist(), counts.tolist())}
    assert found == phrases
    asked = sorted({p for p in phrases if rng.random() < 0.3} | {(4, 4, 4, 4), (0, 1, 0, 1)})
    request = Transducer(pack([(p, 0) for p in asked], words))
    got = {tuple(words.index(w) for w in p): n for p, n in compose(request, t)}
    assert got == {p: phrases[p] for p in asked if p in phrases}


@pytest.mark.parametrize("length", [1, 2, 4])
def test_phrases_of_one_length_at_once(length):
    rng = random.Random(5)
    words = [b"a", b"b", b"c", b"d", b"e"]
    phrases = sorted({tuple(rng.randrange(5) for _ in range(length)): rng.randint(1, 9) for _ in range(200)}.items())
    rows, counts = np.array([p for p, _ in phrases]), np.array([n for _, n in phrases])
    plain, quick = Transducer(pack(phrases, words)), Transducer(pack_rows(rows, counts, words))
    for a, b in zip(plain.expand(), quick.expand(), strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (a[1] == counts).all()
    assert len(plain.starts) == len(quick.starts) and len(plain.labels) == len(quick.labels)


def test_equal_endings_share_states():
    words = [b"%03d" % i for i in range(100)]
    t = Transducer(pack([((i, 50, 60), 1) for i in range(100)], words))
    assert len(t.starts) == 4 and len(t.labels) == 102


def test_map_and_hashes_agree():
    words = [b"one", b"two", "drei".encode()]
    hashes = np.array([collocations._word_hash(w) for w in words], np.uint64)
    many = collocations._hashes("en", [np.array([0, 1]), np.array([1, 2])], hashes)
    one = [collocations.phrase_hash("en", words[:2]), collocations.phrase_hash("en", words[1:])]
    assert many.tolist() == one
