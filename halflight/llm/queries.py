"""One query per operator of this folder, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflight.llm import (
    chat,
    collocations,
    decontaminate,
    langid,
    licenses,
    mixing,
    pieces,
    secret_scan,
    sharding,
    simhash,
    spotsigs,
    token_alignment,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).drop("text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(spotsigs.compare_with_next(_table(spark, sf_dir, "documents")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_chat(turns.unionByName(added)))


def _fold(parts: int):
    """The remainder that splits documents into those that teach and those that are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(_fold(3) != 1))
    found = docs.select("doc_id", (_fold(3) == 1).alias("held_out"),
                        langid.predict_language(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.language").alias("lang_pred"),
                        F.col("p.score").alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_fold(5) != 0)
    model = toxicity.train(docs, labels)
    found = docs.select("doc_id", (_fold(5) == 0).alias("held_out"),
                        toxicity.toxicity(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    used = mixing.block_permutations(docs, mixing.mixture_plan(docs))
    return used.withColumnRenamed("id", "doc_id").withColumn("epoch", F.col("epoch").cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"),
                        F.col("component").alias("component_id"))


#: Vocabulary files of public tokenizers, by their names in the installed package.
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(
        _table(spark, sf_dir, "documents"), _vocabulary(BYTES), _vocabulary(PIECES))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary(PIECES)
    encoded = pieces.encode_pieces(F.col("text"), path)
    found = _table(spark, sf_dir, "documents").select(
        "doc_id", pieces.piece_digest(encoded, path).alias("d"))
    return found.select("doc_id", "d.*")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_sharding, op2_secret_scan, op3_spotsigs, op4_chat_formatting,
        op5_language_id, op6_toxicity, op7_decontamination, op8_license_scan, op9_mixing, op10_simhash,
        op11_token_alignment, op12_sentencepiece, op13_collocations)}

ORACLES: dict[str, str] = {
    "op1_sharding": sharding.oracle(),
    "op4_chat_formatting": chat.oracle(),
    "op9_mixing": mixing.oracle(),
    "op13_collocations": collocations.oracle(),
}
