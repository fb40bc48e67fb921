"""Extendible hashing: shards against SQL at small limits, hot and repeated rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from halflight.llm import sharding

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("limit", [30_000, 400_000])
def test_splits_against_sql(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sharding.shard_documents(docs, limit_bytes=limit).drop("text")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(sharding.oracle(limit)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.select("shard").distinct().count() > 1


def test_several_rounds_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP_BITS", 3)
    rows = [(n, f"text {n} " * 5, "own") for n in range(300)]
    rows += [(7, "the same row " * 4, "own")] * 150 + [(8, f"same id {n}", "own") for n in range(100)]
    rows += [(None, None, "own"), (None, None, "own"), (11, "", "own"), (12, "x" * 5000, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").cache()
    got = sharding.shard_documents(docs, limit_bytes=700)
    assert got.columns == ["doc_id", "text", "shard", "shard_depth", "shard_bytes", "shard_rows"]
    assert got.count() == len(rows)
    shards = got.groupBy("shard").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows"),
        F.max("shard_bytes").alias("said"), F.max("shard_rows").alias("said_rows")).collect()
    assert all(r.n == r.said and r.rows == r.said_rows for r in shards)
    assert all(r.n <= 700 or r.rows == 1 for r in shards)
    names = sorted(r.shard for r in shards)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    sizes = {r.shard: r.n for r in shards}  # a bucket splits only if it is over the limit
    for name in names:
        parent = sum(n for s, n in sizes.items() if s.startswith(name[:-1]))
        assert name == "" or parent > 700
    assert sharding.shard_documents(docs.limit(0)).count() == 0
