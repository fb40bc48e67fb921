"""Secret scan: base spans against Python's regular expressions, models on held-out samples."""

import hashlib
import random
import re
import string
import time

from halflight.llm import secret_scan as s

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def written(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_against_brute_force(spark):
    from halflight.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_secret_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert set(written(want).split(",")) - {""} <= set(r.spans.split(","))
    assert sum(r.n_assign for r in got) and sum(r.n_hex for r in got)


def test_awkward_texts(spark):
    key = "aB3" * 8
    texts = [None, "", "é😀 token = 'abcdefghijkl'", "token=secret: abcdefghijklmnopq", f"API_KEY:{key} apikey={key}",
             "PASSWORD = short", "AKIA" + "Z9" * 7 + " AKIAAKIA1", "x" + "0123456789abcdef" * 3 + "G",
             "passwd=passwd=0123456789", "ſecret=abcdefghijklmnop", "token = " + "a" * 60000,
             ("secret: abcdefghijkl " * 400), "-" * 40, "token=\nabcdefghijklmn", "token = é"]
    rows = [(n, t, "x") for n, t in enumerate(texts)] + [(2, texts[2], "x"), (None, texts[4], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = s.scan_secrets(docs, ratios=[-1.0] * 4096).collect()
    by_text = sorted(((r.id is None, r.id or 0), [tuple(x) for x in r.spans]) for r in got)
    want = sorted(((i is None, i or 0), brute(t)) for i, t, _ in rows)
    assert by_text == want
    assert s.scan_secrets(docs.limit(0), ratios=[-1.0] * 4096).count() == 0


def test_models_tell_keys_from_names(spark):
    ratios = s.train(s.labelled_samples(spark))
    assert len(ratios) == 4096
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=32)) + "7Q" for _ in range(100)]
    names = ["_".join(rng.choices(["customer", "invoice", "total", "monthly", "report", "backup"], k=4))
             + str(rng.randint(0, 99)) for _ in range(100)]
    docs = spark.createDataFrame([(n, f"see {t}, please") for n, t in enumerate(keys + names)],
                                 "doc_id long, text string")
    hit = {r.id for r in s.scan_secrets(docs, ratios=ratios).collect() if r.spans}
    assert len([n for n in hit if n < 100]) >= 98
    assert len([n for n in hit if n >= 100]) <= 2


def test_training_ignores_nulls(spark):
    samples = spark.createDataFrame([(None, 1), ("ab", None), ("", 0)], "text string, secret int")
    assert set(s.train(samples)) == {0.0}


def test_recall_by_length_and_alphabet(spark):
    """The ratio alone decides: figures of the README."""
    rng, alphabets = random.Random(11), {
        "hex": "0123456789ABCDEF", "letters": string.ascii_letters, "upper and digits": string.ascii_uppercase
        + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    rows, classes = [], []
    for name, chars in alphabets.items():
        for length in (12, 16, 20, 32):
            for _ in range(100):
                rows.append((len(rows), f"use {''.join(rng.choices(chars, k=length))} here"))
                classes.append((name, length))
    names = ["".join(w.title() for w in rng.choices(s.PARTS, k=4)) for _ in range(400)]
    rows += [(len(classes) + n, f"call {name}") for n, name in enumerate(names)]
    found = {r.id for r in s.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.spans}
    for name in alphabets:
        for length in (16, 20, 32):
            ids = [n for n, c in enumerate(classes) if c == (name, length)]
            assert len(found.intersection(ids)) >= 90, (name, length)
    assert len([n for n in found if n >= len(classes)]) <= 4


def test_what_sticks_out_of_a_rule_and_texts_full_of_matches(spark):
    key = "Xq7ZvK2pLw9RtB4mYd"
    runs = "".join(f"{n:016x} " for n in range(60_000))
    texts = [f"{key}/{'0123456789abcdef' * 2}/{key}", f"token={key} AKIA{'Z9' * 9}", runs,
             "token=abcdefghijkl " * 20_000, f"{key} " * 600, "AKIA" + "0123456789" * 2 + "abcdef0123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    got = {r.id: [tuple(x) for x in r.spans] for r in s.scan_secrets(docs, ratios=[1.0] * 4096).collect()}
    assert time.time() - start < 60
    for n, text in enumerate(texts):
        assert [x for x in got[n] if x[1] < 3] == brute(text)
        for a, _, b in (x for x in got[n] if x[1] == 3):
            assert not any(a < e and c < b for c, _, e in brute(text)[:100])
    assert [x for x in got[0] if x[1] == 3] == [(0, 3, 19), (51, 3, 70)]
    assert len([x for x in got[4] if x[1] == 3]) == 600 and got[4][-1][2] == len(texts[4]) - 1
