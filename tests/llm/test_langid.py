"""Language identification: held-out accuracy, frequencies against a loop, odd texts."""

import numpy as np
from pyspark.sql import functions as F

from halflight.llm import langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    from halflight.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_frequencies_count_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    total, held = langid.document_frequencies(docs.repartition(5))
    want = np.zeros(langid.BUCKETS)
    n = 0
    for (text,) in docs.collect():
        at, _ = langid.ngrams(text)
        want[at] += 1
        n += len(at) > 0
    assert total == n and (held == want).all()


def test_ngrams_of_a_word():
    at, counts = langid.ngrams("Ab!ab")
    assert counts.sum() == 7 + 6 + 5  # " ab ab " without punctuation, lengths 1 to 3
    assert len(langid.ngrams("12 ?!")[0]) == 0 and len(langid.ngrams(None)[0]) == 0


def test_odd_rows(spark):
    rows = [("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"), (None, "en"), ("x", None),
            ("", "de"), ("123", "en")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs)
    texts = [(None,), ("",), ("4 5 6",), ("the dog",), ("die katze",), ("the cat and the dog " * 20000,), ("the dog",)]
    df = spark.createDataFrame(texts, "text string").withColumn("language", F.lit("no"))
    got = [r.p for r in df.select(langid.predict_language(F.col("text"), model).alias("p")).collect()]
    assert [p.language for p in got] == ["und", "und", "und", "en", "de", "en", "en"] and got[3] == got[6]
    empty = langid.train(docs.limit(0))
    assert empty.predict("the dog") == ("und", 0.0)


def test_temperature_flattens_wrong_certainty():
    logits = np.array([[9.0, 0.0], [9.0, 0.0], [0.0, 9.0], [0.0, 9.0]])
    assert langid.temperature(logits, np.array([0, 0, 1, 0])) > 2


def test_copies_do_not_thin_their_language(spark):
    def text(n, words):
        return " ".join(words[(n * 7 + i * (n % 5 + 1)) % len(words)] for i in range(12)) + f" {n}"

    german = "der hund und die katze schlafen nicht weil ich heute noch arbeiten muss".split()
    english = "the cat and dog are sleeping because they have been working all day".split()
    # the hot text is not German, so that only the other texts can teach the language
    rows = [("qq zz qq xx", "de")] * 20000 + [(text(n, german), "de") for n in range(100)]
    rows += [(text(n, english), "en") for n in range(100)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), rows_per_language=200)
    assert model.predict("die katze und der hund")[0] == "de" and model.predict("the cat and dog")[0] == "en"
    # the copies weigh as one text; document frequencies count all rows
    few = langid.train(spark.createDataFrame(rows[19999:], "text string, lang string"), rows_per_language=200)
    assert (np.sign(few.weights[0]) == np.sign(model.weights[0])).mean() > 0.9


def test_copies_stand_on_one_side():
    rows = [(None, None, n % 3, n * 2 ** 40 // 7) for n in range(300)] + [(None, None, 3, 5 << 30), (None, None, 0, 5 << 30)]
    kept, taught = langid._parted(rows)
    assert not {r[3] for r in kept} & {r[3] for r in taught}
    assert {r[2] for r in taught} == {0, 1, 2, 3} and 30 < len(kept) < 90 and len(kept) + len(taught) == 302


def test_only_drawn_vectors_reach_the_one_task(spark, monkeypatch):
    plans = []
    kind = type(spark.range(1))
    run = kind.mapInPandas

    def seen(df, f, schema, *more, **named):
        if f.__name__ == "learn":
            plans.append((df.columns, df.rdd.getNumPartitions(),
                          df._jdf.queryExecution().executedPlan().toString()))
        return run(df, f, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInPandas", seen)
    rows = [("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de")] * 50
    langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    (columns, parts, plan), = plans
    assert "text" not in columns and parts == 1
    assert "Coalesce 1" not in plan and plan.index("SinglePartition") < plan.index("MapInPandas")


def test_labels_without_letters(spark):
    docs = spark.createDataFrame([("123", "en"), ("?", "de")], "text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en"] and model.predict("the dog")[1] == 0.5
