"""The pipeline stage by stage, each against a brute-force version on its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written as the pipeline does."""
    import corpus_pipeline as p

    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        found[name] = (docs, out)
        docs = out
    return found


def ids(df):
    return [r[0] for r in df.select("doc_id").collect()]


def test_columns_and_order(stages):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == list(stages) and p.ORACLE_SQL is None
    for name in list(stages)[:-1]:
        assert stages[name][0].columns == stages[name][1].columns


def test_toxicity(spark, stages):
    docs, out = stages["toxicity"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(docs)) - set(ids(out))
    clean = [i for i in toxic if not toxic[i]]
    assert sum(i in gone for i in clean) <= 0.02 * len(clean)
    assert sum(i in gone for i in toxic if toxic[i]) >= 0.6 * sum(toxic.values())  # some labels are noise


def test_simhash(stages):
    from test_simhash import brute_components, brute_print

    docs, out = stages["simhash near-dedup"]
    prints = {r.doc_id: brute_print(r.text) for r in docs.select("doc_id", "text").collect()}
    assert sorted(ids(out)) == sorted(set(brute_components(prints).values()))


def test_decontamination(spark, stages):
    from test_decontaminate import brute

    docs, out = stages["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute([tuple(r) for r in docs.select("doc_id", "text").collect()], items)}
    assert leaks and sorted(ids(out)) == sorted(set(ids(docs)) - leaks)


def test_mixing(stages):
    from halflight.llm.mixing import token_count

    docs, out = stages["mixing"]
    use = Counter(ids(out))
    assert set(use) == set(ids(docs)) and max(use.values()) == 2
    tokens = {r.doc_id: (r.source, r.n) for r in docs.select("doc_id", "source", token_count().alias("n")).collect()}
    size, used = defaultdict(int), defaultdict(int)
    for i, (source, n) in tokens.items():
        size[source] += n
        used[source] += n * use[i]
    repeats = {s: used[s] / size[s] for s in size}
    slack = {s: max(n for i, (t, n) in tokens.items() if t == s) / size[s] for s in size}
    assert min(repeats.values()) >= 1 and all(repeats[s] <= 2 + slack[s] for s in size)


def test_sharding(stages):
    from halflight.llm.sharding import LIMIT_BYTES

    docs, out = stages["sharding"]
    assert sorted(ids(docs)) == sorted(ids(out))
    sizes = out.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.max("shard_bytes").alias("s")).collect()
    assert all(r.n == r.s and r.n <= LIMIT_BYTES for r in sizes)


def test_run_is_registered(spark, stages):
    import __spark_entry__ as entry

    got = entry.queries()["pipeline"](spark, SF)
    assert got.count() == stages["sharding"][1].count()
