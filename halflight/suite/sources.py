"""Sources and sinks."""

from pyspark.sql import functions as F

from halflight.operators.models import logistic_regression, predict
from halflight.session import cut_lineage, scratch_path
from halflight.sources import models as bundles
from halflight.sources import tables as io
from halflight.suite.base import (
    DESC,
    FEATS,
    LABELLED,
    LINES,
    STRUCTURES,
    descriptors,
    labelled_docs,
    pool_docs,
    q6,
    query,
    r6,
    structures,
    table,
)
from halflight.suite.evaluation import METRICS, RUNS, runs


@query("read_table", "SELECT * FROM documents")
def read_table(spark, sf):
    """Texts with line breaks and quotes through a CSV file."""
    docs = table(spark, sf, "documents")
    path = scratch_path(spark, "documents") + ".csv"
    io.write_table(docs, path, "csv")
    return io.read_table(spark, path, docs.schema)


@query("read_optional", """
SELECT 'labelled' AS source, count(*) AS n, sum(toxic)::BIGINT AS positives FROM labels
UNION ALL SELECT 'absent', 0, NULL""")
def read_optional(spark, sf):
    there = io.read_optional(
        spark, f"{sf}/labels.parquet", table(spark, sf, "labels").schema, required=True)
    absent = io.read_optional(spark, f"{sf}/no_such_pool.parquet", there.schema)
    summary = lambda df, name: df.agg(
        F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"),
        F.sum("toxic").alias("positives"))
    return summary(there, "labelled").unionByName(summary(absent, "absent"))


@query("read_smi", f"""
WITH {STRUCTURES}
SELECT trim(smiles) AS smiles, concat('P-', row_id) AS cas, p_size % 2 AS activity
FROM structures WHERE trim(smiles) <> ''""")
def read_smi(spark, sf):
    lines = structures(spark, sf).filter(F.trim("smiles") != "").select(
        F.concat_ws("  \t", "smiles", F.concat(F.lit("P-"), "row_id"),
                    (F.col("p_size") % 2).cast("string")))
    path = scratch_path(spark, "smi")
    lines.write.text(path)
    return io.read_smi(spark, path)


@query("write_table", "SELECT * FROM orders")
def write_table(spark, sf):
    orders = table(spark, sf, "orders")
    path = scratch_path(spark, "orders")
    io.write_table(orders, path)
    return io.read_table(spark, path, orders.schema)


@query("feature_metadata", f"""
WITH {FEATS},
long AS (UNPIVOT (SELECT {", ".join(DESC)} FROM feats) ON {", ".join(DESC)}
         INTO NAME feature VALUE x),
cats AS (SELECT unnest({DESC}) AS feature,
  unnest(['size', 'size', 'style', 'style', 'style', 'style', 'size', 'size']) AS category)
SELECT 'documents' AS dataset, 'toxic' AS target_variable, 8 AS n_features, category, feature,
  {q6("avg(x)", "mean")}
FROM long JOIN cats USING (feature) GROUP BY category, feature""")
def feature_metadata(spark, sf):
    metadata = io.feature_metadata(
        spark, DESC, "toxic", "documents",
        {"size": ["t_chars", "t_words", "t_lines", "t_wordlen"],
         "style": ["t_distinct", "t_digit", "t_upper", "t_punct"]})
    path = scratch_path(spark, "metadata")
    io.write_metadata(metadata, path)
    known = io.category_table(io.read_metadata(spark, path))
    row = descriptors(spark, sf).agg(*[F.avg(c).alias(c) for c in DESC])
    means = row.select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in DESC]
    )).alias("_e")).select("_e.*")
    return known.join(means, "feature").withColumn("mean", r6("mean"))


@query("versioned_dataset", "SELECT doc_id, quality, toxic, 2 AS version FROM labels")
def versioned_dataset(spark, sf):
    labels = table(spark, sf, "labels")
    base = scratch_path(spark, "datasets")
    io.publish_dataset(labels.filter("toxic = 1"), base, "labels", "toxic rows only")
    io.publish_dataset(labels, base, "labels", "all rows")
    return io.use_dataset(spark, base, "labels:latest").withColumn(
        "version", F.lit(io.latest_version(spark, base, "labels")))


@query("save_model", f"""
WITH {LABELLED} SELECT doc_id, 'documents' AS dataset, 0.0 AS gap FROM pool""")
def save_model(spark, sf):
    """Scores of a saved and loaded model with its clipping and scaling, against those before."""
    train = cut_lineage(labelled_docs(spark, sf))
    model = logistic_regression(train, DESC, "label", clip=3.0, scale=True)
    path = scratch_path(spark, "model")
    bundles.save_model(model, path, "documents", "Logistic", "documents", "toxic", DESC,
                       {"rows": float(train.count())}, spark)
    loaded, info = bundles.load_model(spark, path)
    dataset = info.select("dataset").scalar()
    rows = cut_lineage(pool_docs(spark, sf))
    before = predict(model, rows, ["doc_id", *DESC]).withColumnRenamed("p1", "p_before")
    after = predict(loaded, before.drop("prediction", "confidence"), ["doc_id", "p_before"])
    return after.select("doc_id", dataset.alias("dataset"),
                        r6(F.abs(F.col("p1") - F.col("p_before")), "gap"))


@query("results_table", f"""
WITH {LINES}, {RUNS}
SELECT method, 'run' AS model, n_unlabeled, {METRICS}, CAST(NULL AS DOUBLE) AS training_time,
  CAST(NULL AS BIGINT) AS n_pseudo_labeled, n AS final_train_size
FROM runs""")
def results_table(spark, sf):
    path = scratch_path(spark, "results")
    done = runs(spark, sf).withColumn("model", F.lit("run")).withColumnRenamed(
        "n", "final_train_size")
    io.append_results(done.filter("method = 'A'"), path)
    io.append_results(done.filter("method <> 'A'"), path)
    back = io.read_results(spark, path)
    return back.withColumns(
        {c: F.round(c, 6) for c in ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]})


@query("model_catalog", f"""
WITH expected AS (SELECT DISTINCT p_type AS name, 'part' AS dataset, p_brand AS target FROM part),
infos AS (SELECT p_type AS name, count(*) AS n, {q6("avg(p_retailprice)", "price")}
          FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type)
SELECT name, dataset, target, CASE WHEN n IS NULL THEN 'Unknown' ELSE 'Forest' END AS type,
  CASE WHEN n IS NULL THEN 'Not Loaded' ELSE 'Loaded' END AS status, price
FROM expected LEFT JOIN infos USING (name)""")
def model_catalog(spark, sf):
    part = table(spark, sf, "part")
    expected = part.select(F.col("p_type").alias("name"), F.lit("part").alias("dataset"),
                           F.col("p_brand").alias("target")).distinct()
    infos = part.filter("p_type <> 'ECONOMY'").groupBy(F.col("p_type").alias("name")).agg(
        F.create_map(F.lit("price"), F.avg("p_retailprice")).alias("metrics")
    ).withColumn("type", F.lit("Forest"))
    return bundles.model_catalog(expected, infos).withColumn(
        "price", r6(F.col("metrics")["price"])).drop("metrics")


@query("request_batch", r"""
SELECT doc_id, CAST(i - 1 AS INT) AS "index", items[i] AS smiles
FROM (SELECT doc_id, items, unnest(range(1, len(items) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS items FROM documents)
      WHERE len(items) BETWEEN 1 AND 100)""")
def request_batch(spark, sf):
    requests = table(spark, sf, "documents").select(
        "doc_id", F.split("text", "\n").alias("molecules"))
    return io.request_batch(requests, "molecules")[0]


@query("request_errors", r"""
SELECT doc_id, len(items)::INT AS n_items, 'request has more than 100 items' AS error
FROM (SELECT doc_id, string_split(text, chr(10)) AS items FROM documents) WHERE len(items) > 100
UNION ALL SELECT conv_id, 0, 'request has no items' FROM conversations
GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0""")
def request_errors(spark, sf):
    """Rejected requests: the oversized documents, and conversations without a system turn."""
    requests = table(spark, sf, "documents").select(
        "doc_id", F.split("text", "\n").alias("molecules"))
    system = F.collect_list(F.when(F.col("role") == "system", F.col("text")))
    empty = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        system.alias("molecules"))
    return io.request_batch(requests.unionByName(empty), "molecules")[1]
