"""Cross-tokenizer alignment against a plain loop over byte offsets."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers

from halflight.llm import queries, token_alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "Hello world, this is a test.", "Hello  world", "日本語 テキスト😀 é", "a▁b with a mark", "", None,
    "<|endoftext|> and </s> <unk>", "   lead", "tail   ", "x" * 700, "tabs\tand\r\nlines\n\n ",
    "Hello world, this is a test.", "\0 nul", "wort " * 3000,
]


@pytest.fixture(scope="module")
def brute():
    """Another library for A, plain offsets, no windows."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    a_of = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a_bytes = {i: raw for raw, i in ranks.items()}
    b_of = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        p = b_of.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        ids_a, ids_b = a_of.encode_ordinary(" " + (text or "")), b_of.encode(text or "")
        raw_a, raw_b = [a_bytes[i] for i in ids_a], [b_bytes(i) for i in ids_b]
        if not text or b"".join(raw_a) != b"".join(raw_b) or b"".join(raw_a) != (" " + text).encode():
            return 0, 0, [], []
        ends = [[sum(map(len, raw[:n + 1])) for n in range(len(raw))] for raw in (raw_a, raw_b)] if len(
            text) < 2000 else [list(running(raw)) for raw in (raw_a, raw_b)]
        where = [{e: n for n, e in enumerate(es)} for es in ends]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in shared:
            k, m = where[0][e] + 1, where[1][e] + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        return len(ids_a), len(ids_b), groups, [(ids_a[where[0][e]], ids_b[where[1][e]]) for e in shared]

    def running(raw):
        end = 0
        for r in raw:
            end += len(r)
            yield end

    def report(texts):
        found = [one(t) for t in texts]
        counts = Counter(p for f in found for p in f[3])
        most = Counter()
        for (a, b), n in counts.items():
            most[b] = max(most[b], n)
        return [(n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links),
                 sum(counts[p] for p in links),
                 hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                for n_a, n_b, groups, links in found]

    return report


def test_odd_texts(spark, brute):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = token_alignment.alignment_report(docs, A, B).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(TEXTS)


@pytest.mark.parametrize("hot_pairs", [token_alignment.HOT_PAIRS, 50])
def test_documents_and_rare_pairs(spark, brute, hot_pairs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    rows = token_alignment.alignment_report(docs, A, B, hot_pairs=hot_pairs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute([texts[i] for i in ids])


def test_query_has_its_columns(spark):
    got = queries.op11_token_alignment(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint",
        "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    rows = [(None, "one two", 1), (None, "one two", 1), (1 << 60, "one two", 2), ((1 << 60) + 1, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a long")
    got = token_alignment.alignment_report(docs, A, B).collect()
    assert Counter((r.doc_id, r.n_links, r.count_sum) for r in got) == Counter(
        {(None, 2, 6): 2, (1 << 60, 2, 6): 1, ((1 << 60) + 1, 0, 0): 1})
    assert token_alignment.alignment_report(docs.limit(0), A, B).count() == 0


def test_every_character_splits_as_in_the_vocabulary_file():
    model = tokenizers.Tokenizer.from_file(A)
    model.encode_special_tokens = True
    work = token_alignment.ByteTokens(A)
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 20_000):
        texts = [f"a{c}1{c} {c}.{c}{c} b{c}" for c in letters[at:at + 20_000]]
        want = model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        assert work.encode(texts) == [e.ids for e in want]


def test_windows_end_at_anchors():
    work = token_alignment.aligner(A, B)
    text = "Some ordinary words, and 12345 more of them."
    ids_a, ids_b = work.a.encode([text])[0], work.b.encode([text])[0]
    ends_a, ends_b = work.anchors(np.array(ids_a), np.array(ids_b))
    assert len(ends_a) == len(ends_b) == text.count(" ") + 1
    i = j = 0
    for k, m in zip(ends_a, ends_b, strict=True):
        same = [b"".join(t.bytes[x] for x in ids) for t, ids in ((work.a, ids_a[i:k]), (work.b, ids_b[j:m]))]
        assert same[0] == same[1] and same[0].startswith(b" ")
        i, j = k, m


def test_new_windows_of_a_document_are_worked_out_together(brute, monkeypatch):
    work = token_alignment.Aligner(*(getattr(token_alignment.aligner(A, B), t) for t in "ab"))
    asked, windows = [], work._windows
    monkeypatch.setattr(work, "_windows", lambda keys: asked.append(len(keys)) or windows(keys))
    monkeypatch.setattr(token_alignment, "MEMO", 40)
    texts = ["Words, words, and 12345 unforeseeable words.", "good words a▁b good words", "good words", "日本語 é😀 words",
             " ".join(f"w{i}" for i in range(50)), "Words, words, and one more."]
    for text, want in zip(texts, brute(texts), strict=True):
        n_a, n_b, n_groups, groups, pairs, times = work.align(text, work.a.encode([text])[0], work.b.encode([text])[0])
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (n_a, n_b, n_groups, int(times.sum()), digest) == (*want[:4], want[6])
    # one call a document, and one a window where some are spelt in two ways; "good words" is known by then
    assert asked[0] > 4 and max(asked) == 50 and len([n for n in asked if n > 1]) == 5
