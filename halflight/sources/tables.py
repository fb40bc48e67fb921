"""Reading and writing tables, metadata, datasets with versions, and result logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halflight.session import claim, path_exists


#: Quoted fields may hold line breaks, and a quote is written twice. Blanks at the ends stay, and an
#: empty text is told from a missing one.
CSV_TEXT = {
    "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet, or a CSV file with a header when the path says so."""
    if ".csv" not in path.rsplit("/", 1)[-1]:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    # a field without quotes and characters is missing; the value named here stands in no text
    reader = spark.read.options(header=True, nanValue="NaN", nullValue="\0", **CSV_TEXT)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_optional(
    spark: SparkSession, path: str, schema: T.StructType | str, required: bool = False
) -> DataFrame:
    """The table, or an empty one of the same schema; a required table must exist."""
    if path_exists(spark, path):
        return read_table(spark, path, schema)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def read_smi(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Headerless lines of whitespace-separated fields: notation, registry number, activity."""
    names = names or ["smiles", "cas", "activity"]
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cols = [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)]
    cols[-1] = F.get(fields, F.lit(len(names) - 1)).try_cast("int").alias(names[-1])
    return lines.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, **CSV_TEXT).csv(path)
    else:
        writer.parquet(path)


# --- feature metadata ----------------------------------------------------------------------

# Field names of stored metadata.
METADATA_SCHEMA = (
    "feature_names array<string>, n_features int, target_variable string, dataset string, "
    "scaling_method string, outlier_handling string, feature_categories map<string,array<string>>"
)


def feature_metadata(
    spark: SparkSession, features: list[str], target: str, dataset: str,
    categories: dict[str, list[str]], scaling: str = "StandardScaler",
    outliers: str = "Clipped (3 std)",
) -> DataFrame:
    row = (features, len(features), target, dataset, scaling, outliers, categories)
    return spark.createDataFrame([row], METADATA_SCHEMA)


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path)


def category_table(metadata: DataFrame) -> DataFrame:
    return metadata.select(
        "dataset", "target_variable", "n_features",
        F.explode("feature_categories").alias("category", "names"),
    ).select("*", F.explode("names").alias("feature")).drop("names")


# --- datasets with versions ----------------------------------------------------------------


LOG_SCHEMA = "name string, version int, description string, folder string, created_at timestamp"


def publish_dataset(df: DataFrame, base: str, name: str, description: str = "") -> int:
    """Write the next version of a named dataset; returns its number.

    Data go to a folder of their own name first. Then a number is claimed, the next that nobody has, and
    the log row that names both commits the version. A run that dies before leaves a folder or a claim
    that no reader looks at and no later run trips over; of two at once each gets a number.
    """
    spark = df.sparkSession
    root, folder = f"{base}/{name}", uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{root}/data/{folder}")
    version = (latest_version(spark, base, name) or 0) + 1
    while not claim(spark, f"{root}/claims/{version}"):
        version += 1
    spark.createDataFrame(
        [(name, version, description, folder)], "name string, version int, description string, folder string"
    ).withColumn("created_at", F.current_timestamp()).coalesce(1).write.parquet(f"{root}/log/entry={version}")
    return version


def dataset_log(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One row for each committed version; a version is in the log or is not there."""
    return spark.read.schema(f"{LOG_SCHEMA}, entry int").parquet(f"{base}/{name}/log").drop("entry")


def latest_version(spark: SparkSession, base: str, name: str) -> int | None:
    if not path_exists(spark, f"{base}/{name}/log"):
        return None
    return dataset_log(spark, base, name).agg(F.max("version")).first()[0]


def use_dataset(spark: SparkSession, base: str, reference: str) -> DataFrame:
    """``name``, ``name:latest`` or ``name:N``; only that version's folder is listed."""
    name, _, tag = reference.partition(":")
    version = int(tag) if tag and tag != "latest" else latest_version(spark, base, name)
    found = None
    if version is not None and path_exists(spark, f"{base}/{name}/log"):
        found = dataset_log(spark, base, name).filter(F.col("version") == version).first()
    if found is None:
        raise FileNotFoundError(f"no dataset {reference} under {base}")
    return spark.read.parquet(f"{base}/{name}/data/{found['folder']}")


# --- result logs ---------------------------------------------------------------------------

# Field names of stored results.
RESULTS_SCHEMA = (
    "method string, model string, n_unlabeled long, accuracy double, precision double, "
    "recall double, f1 double, roc_auc double, pr_auc double, training_time double, "
    "n_pseudo_labeled long, final_train_size long"
)


def append_results(results: DataFrame, path: str) -> None:
    """Rows in the fixed schema; columns a run does not have are NULL."""
    empty = results.sparkSession.createDataFrame([], RESULTS_SCHEMA)
    names = empty.columns
    shaped = empty.unionByName(results, allowMissingColumns=True).select(names)
    shaped.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_optional(spark, path, RESULTS_SCHEMA)


# --- requests ------------------------------------------------------------------------------


def request_batch(
    requests: DataFrame, items: str, max_items: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Items of the requests that have 1 to ``max_items``, one row each with its index; and one row
    per rejected request with its number of items and an error. Every request is in one of the two."""
    others = [c for c in requests.columns if c != items]
    n = F.coalesce(F.size(items), F.lit(0))
    n = F.greatest(n, F.lit(0))
    accepted = requests.filter(n.between(1, max_items)).select(
        *others, F.posexplode(items).alias("index", "smiles"))
    rejected = requests.filter(~n.between(1, max_items)).select(
        *others, n.alias("n_items"), F.when(n == 0, "request has no items").otherwise(
            f"request has more than {max_items} items").alias("error"))
    return accepted, rejected
