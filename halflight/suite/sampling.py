"""Balancing, splits, folds, pool subsets and stacked tables."""

from pyspark.sql import functions as F

from halflight.operators import sample
from halflight.suite.base import query, table


def labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))


def hash_rank(source: str, key: str, seed: int = 42, by: str = "PARTITION BY label") -> str:
    return (f"SELECT *, row_number() OVER ({by} ORDER BY md5(concat({key}, '-{seed}')), {key})"
            f" AS rn FROM {source}")


L = "l AS (SELECT doc_id, toxic AS label FROM labels)"


@query("downsample_majority", f"""
WITH {L} SELECT doc_id, label FROM ({hash_rank("l", "doc_id")})
WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM l GROUP BY label))""")
def downsample_majority(spark, sf):
    return sample.downsample_majority(labels(spark, sf), "label", "doc_id")


@query("ratio_balance", f"""
WITH {L}, c AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM l),
quota AS (SELECT
  CASE WHEN n1 < n0 THEN n1 ELSE least(CAST(trunc(n0 * (0.6::DOUBLE / 0.4::DOUBLE)) AS BIGINT), n1) END AS q1,
  CASE WHEN n1 < n0 THEN least(CAST(trunc(n1 * (0.4::DOUBLE / 0.6::DOUBLE)) AS BIGINT), n0) ELSE n0 END AS q0
  FROM c)
SELECT doc_id, label FROM ({hash_rank("l", "doc_id")}), quota
WHERE rn <= CASE label WHEN 1 THEN q1 ELSE q0 END""")
def ratio_balance(spark, sf):
    return sample.ratio_balance(labels(spark, sf), "label", "doc_id")


@query("shuffle", f"""
SELECT doc_id, rn AS position FROM ({hash_rank("(SELECT doc_id FROM documents)", "doc_id", by="")})""")
def shuffle(spark, sf):
    return sample.shuffle_order(table(spark, sf, "documents").select("doc_id"), "doc_id")


SPLIT = f"""
ranked AS ({hash_rank("l", "doc_id")}),
split AS (SELECT doc_id, label, CASE WHEN rn <=
  floor(0.3 * (count(*) OVER (PARTITION BY label)) + 0.5) THEN 'test' ELSE 'train' END AS split
  FROM ranked)"""


@query("stratified_split", f"WITH {L}, {SPLIT} SELECT * FROM split")
def stratified_split(spark, sf):
    return sample.stratified_split(labels(spark, sf), "label", "doc_id", 0.3)


@query("train_val_test_split", f"""
WITH {L}, ranked AS ({hash_rank("l", "doc_id")}),
first AS (SELECT doc_id, label, rn <= floor(0.2 * (count(*) OVER (PARTITION BY label)) + 0.5)
  AS test FROM ranked),
rest AS ({hash_rank("(SELECT doc_id, label FROM first WHERE NOT test)", "doc_id", 43)})
SELECT doc_id, label, 'test' AS split FROM first WHERE test
UNION ALL SELECT doc_id, label, CASE WHEN rn <=
  floor(0.2 * (count(*) OVER (PARTITION BY label)) + 0.5) THEN 'val' ELSE 'train' END FROM rest""")
def train_val_test_split(spark, sf):
    return sample.train_val_test_split(labels(spark, sf), "label", "doc_id")


@query("random_subset", f"""
SELECT event_id, value FROM ({hash_rank("(SELECT event_id, value FROM events)", "event_id", by="")})
WHERE rn <= 2500""")
def random_subset(spark, sf):
    return sample.random_subset(
        table(spark, sf, "events").select("event_id", "value"), "event_id", 2500)


@query("stratified_folds", f"""
WITH {L}, ranked AS ({hash_rank("l", "doc_id")}),
folds AS (SELECT doc_id, label, CAST((rn - 1) % 5 AS INT) AS fold FROM ranked),
per AS (SELECT fold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM folds GROUP BY fold),
ok AS (SELECT fold, p > 0 AND n > 0 AND sum(p) OVER () > p AND sum(n) OVER () > n AS usable FROM per)
SELECT doc_id, label, fold, usable FROM folds JOIN ok USING (fold)""")
def stratified_folds(spark, sf):
    folds = sample.stratified_folds(labels(spark, sf), "label", "doc_id", 5)
    usable = sample.usable_folds(folds, "label").select("fold", "usable")
    return folds.join(usable, "fold").select("doc_id", "label", "fold", "usable")


@query("prefix_subset", f"""
SELECT doc_id, rn AS position FROM ({hash_rank(
    "(SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id))", "doc_id", by="")})
WHERE rn <= 500""")
def prefix_subset(spark, sf):
    pool = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels"), "doc_id", "left_anti")
    return sample.prefix_subset(sample.shuffle_order(pool, "doc_id"), "position", 500)


@query("stack_rows", """
SELECT doc_id, lang, toxic AS label FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, lang, NULL FROM documents ANTI JOIN labels USING (doc_id)""")
def stack_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sample.stack_rows(
        docs.join(labels(spark, sf), "doc_id"),
        sample.pool_minus_selected(docs, labels(spark, sf), "doc_id"))


@query("same_split_check", """
SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n_first,
  (SELECT count(*) FROM labels) AS n_second, 0 AS mismatches""")
def same_split_check(spark, sf):
    """The same split for two feature spaces: joined to documents, and on labels alone."""
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(
        labels(spark, sf), "doc_id")
    return sample.same_split_check(
        sample.stratified_split(joined, "label", "doc_id"),
        sample.stratified_split(labels(spark, sf), "label", "doc_id"), "doc_id")
