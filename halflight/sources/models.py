"""Model bundles: a fitted pipeline beside a one-row metadata table, and their catalogue."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflight.operators.forest import GrownForest, load_forest
from halflight.session import path_exists

INFO_SCHEMA = (
    "name string, type string, dataset string, target string, features array<string>, "
    "metrics map<string,double>"
)


def save_model(
    model: PipelineModel | GrownForest, path: str, name: str, model_type: str, dataset: str, target: str,
    features: list[str], metrics: dict[str, float], spark: SparkSession,
) -> None:
    if isinstance(model, GrownForest):
        model.save(spark, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(
        [(name, model_type, dataset, target, features, metrics)], INFO_SCHEMA
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | GrownForest | None, DataFrame | None]:
    """(model, info); a missing bundle gives (None, None), a bare model has no info."""
    if path_exists(spark, f"{path}/model"):
        info = f"{path}/info"
        grown = path_exists(spark, f"{path}/model/trees")
        return (
            load_forest(spark, f"{path}/model") if grown else PipelineModel.load(f"{path}/model"),
            spark.read.schema(INFO_SCHEMA).parquet(info) if path_exists(spark, info) else None,
        )
    if path_exists(spark, f"{path}/stages"):
        return PipelineModel.load(path), None
    return None, None


def model_catalog(expected: DataFrame, infos: DataFrame) -> DataFrame:
    """Every expected model (name, dataset, target) with its status and metrics."""
    found = infos.select("name", "type", "metrics", F.lit(True).alias("_found"))
    return expected.join(found, "name", "left").select(
        *expected.columns,
        F.coalesce("type", F.lit("Unknown")).alias("type"),
        F.when(F.col("_found"), "Loaded").otherwise("Not Loaded").alias("status"),
        "metrics",
    )
