"""Encoding with source spans and decoding, against the sentencepiece library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from halflight.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   a  b", "a", "▁x ▁", "日本語 テキスト😀 é", "x" * 500, " " * 37, "\0a\tb\r\n",
       "a" + " " * 9 + "b", "� ", "<s> </s> <unk> <0x41>", "zq" * 4000, "wort " * 5000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def drawn(letters, n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_ids_spans_and_text_equal_the_library(library):
    model = pieces.PieceModel(PATH)
    for text in ODD + drawn("ab ▁  é日😀\n\tthé", 500, 40):
        ids, starts, ends = model.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == library.encode(text)
        assert list(zip(starts, ends, strict=True)) == [(p.begin, p.end) for p in proto.pieces]
        assert model.decode([1, *ids.tolist(), 2]) == library.decode([1, *ids.tolist(), 2])


def test_any_ids_decode_as_in_the_library(library):
    model, rng = pieces.PieceModel(PATH), random.Random(2)
    draw = lambda: rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 259])
    for _ in range(1000):
        ids = [draw() for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("spaces", [{}, {"remove_extra_whitespaces": False}, {
    "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}])
def test_longest_prefixes_and_their_places_equal_the_library(rule, spaces):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, **spaces)
    proto = ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    mine = pieces.Normaliser(proto.normalizer_spec)
    raw_places = lambda text, at: len(text.encode()[:at].decode(errors="ignore"))
    for text in drawn("aAÀ ①Ａ̀̈  é\t\nﬁ㍿ 日ｶﾞ​　▁B", 300, 14):
        made, places = mine(text)
        want, offsets = theirs.normalize(text, with_offsets=True)
        assert made == want
        if not made:
            continue
        # the library counts characters: one offset for each character and one for the end
        at = [len(made[:i].encode()) for i in range(len(made) + 1)]
        assert [raw_places(text, places[i]) for i in at] == list(offsets)


def test_short_and_long_cuts_merge_alike():
    model = pieces.PieceModel(PATH)
    for text in drawn("abethin▁▁", 300, 60):
        assert model._merged_short(text) == model._merged_long(text)


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.n_source_bytes == len(docs[r.doc_id].encode())


def test_columns_keep_spans_and_nulls(spark):
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, None), (2, None), (3, "")], "doc_id long, text string")
    e = docs.withColumn("e", pieces.encode_pieces(F.col("text"), PATH)).withColumn(
        "back", pieces.decode_pieces(F.col("e.ids"), PATH)).orderBy("doc_id").collect()
    assert [len(r.e.ids) for r in e[1:]] == [2, 2, 2] and [r.back for r in e] == ["héllo wörld", "", "", ""]
    raw, spans = "héllo wörld".encode(), list(zip(e[0].e.starts, e[0].e.ends, strict=True))
    assert b"".join(raw[a:b] for a, b in spans) == raw
    assert docs.limit(0).select(pieces.encode_pieces(F.col("text"), PATH).alias("e")).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(
        pieces.decode_pieces(F.col("ids"), PATH).alias("t")).first().t is None
