"""Toxicity: folding, exceptions, learnt stems and held-out labels."""

import time

from pyspark.sql import functions as F

from halflight.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def weight(text, lexicon=None):
    return t.weigh(t.fold(text), (lexicon or t.Lexicon()).automaton())[0]


def test_folding_and_exceptions():
    assert weight("You idiot!") == t.FIXED_WEIGHT
    assert weight("1d10t, IDIOT, idіоt") == 3 * t.FIXED_WEIGHT
    assert weight("ｉｄｉｏｔ l0ser 1oser") == 3 * t.FIXED_WEIGHT
    assert weight("an idiotic trashcan scumbag") == 0
    assert weight("put it in the trash can, trash") == t.FIXED_WEIGHT
    assert weight("") == weight(None) == weight("...") == 0
    assert weight("lowendish lowend", t.Lexicon({}, {"iowe": 2.0, "iowen": 3.0})) == 6.0


def test_against_a_loop(spark):
    lexicon = t.Lexicon(stems={"tho": 1.5})
    machine = lexicon.automaton()
    words = {t.fold(w).strip() for w in lexicon.words}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect():
        folded = t.fold(r.text).split()
        want = sum(t.FIXED_WEIGHT if w in words else 1.5 if w.startswith("tho") else 0 for w in folded)
        got, n = t.weigh(t.fold(r.text), machine)
        assert n == len(folded) and abs(got - want) <= 1e-9


def test_held_out_labels(spark):
    from halflight.llm.queries import QUERIES

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op6_toxicity"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean) and sum(r.predicted for r in toxic) >= len(toxic) / 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())


def test_learnt_stems_and_odd_rows(spark):
    rows = [(n, f"plain words number {n} " * 5 + (f"grobax{n}y grobaxian" * (n % 4 == 0))) for n in range(200)]
    docs = spark.createDataFrame([*rows, (None, "grobax"), (900, None), (901, "")], "doc_id long, text string")
    docs = docs.withColumn("toxic", F.lit(7))
    labels = spark.createDataFrame([(n, int(n % 4 == 0), "x") for n in range(200)] + [(0, 0, "x"), (1, None, "x"),
                                   (None, 1, "x"), (7000, 1, "x")], "doc_id long, toxic int, text string")
    model = t.train(docs, labels)
    assert list(model.lexicon.stems) == ["grob"]
    kept = t.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {n for n in range(200) if n % 4} | {900, 901}
    assert t.drop_toxic(docs.limit(0), labels).count() == 0
    assert t.drop_toxic(docs, labels.limit(0)).count() == 203


def test_a_text_full_of_exceptions():
    machine, n = t.Lexicon().automaton(), 60_000
    start = time.process_time()
    assert t.weigh(t.fold("trash can " * n), machine) == (0.0, 2 * n)
    assert t.weigh(t.fold("trash can trash, " * n), machine)[0] == n * t.FIXED_WEIGHT
    assert time.process_time() - start < 6  # about 1 s
