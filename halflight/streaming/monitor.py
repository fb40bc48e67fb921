"""Monitoring of prediction logs, as streams and as their batch twins."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflight.functions.scoring import confidence, decide, reason_list
from halflight.operators.models import positive_probability
from halflight.operators.keys import join_null_safe
from halflight.operators.ordering import with_running_sums
from halflight.operators.profile import kolmogorov_p
from halflight.session import is_file, scratch_path

# Alert and retraining limits.
LATENCY_LIMIT_MS = 40
CONFIDENCE_ALERT = 0.5
RETRAIN_CONFIDENCE = 0.70
RETRAIN_DRIFT = 0.25


def read_log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table as a stream: a folder of files, or one file, which Spark streams by name."""
    reader = spark.readStream.schema(schema)
    if not is_file(spark, path):
        return reader.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, return the table it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    writer = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
    )
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def latency_alerts(log: DataFrame, limit: float = LATENCY_LIMIT_MS) -> DataFrame:
    return log.filter(F.col("latency_ms") > limit)


def confidence_alerts(log: DataFrame, limit: float = CONFIDENCE_ALERT) -> DataFrame:
    return log.filter(F.col("confidence") < limit)


def monitor_window(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means and count per event-time window; works on streams and on tables."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        timed = timed.withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", width).alias("w"))
        .agg(
            F.avg("confidence").alias("mean_confidence"),
            F.avg("drift").alias("mean_drift"),
            F.avg("latency_ms").alias("mean_latency_ms"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            F.col("w.start").alias("window_start"), "mean_confidence", "mean_drift",
            "mean_latency_ms", "n",
        )
    )


def run_windows(
    stream: DataFrame, width: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Window aggregates of a stream, the open last windows included.

    Each micro-batch writes the windows it changed; the newest row of a window counts.
    Rewritten batches replace their own folder, so a retried batch adds nothing twice.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "windows")
    windows = monitor_window(stream, width, late)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    (
        windows.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    written = spark.read.parquet(f"{out}/data")
    values = [c for c in windows.columns if c != "window_start"]
    return (
        written.groupBy("window_start")
        .agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        .select("window_start", "_v.*")
    )


def health_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.avg("confidence").alias("avg_confidence"),
        F.avg("drift").alias("avg_drift"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count(F.lit(1)).alias("n"),
    )


def latest_run(log: DataFrame, run: str, ts: str) -> DataFrame:
    """The newest run by its last timestamp (ties to the larger run id)."""
    runs = log.groupBy(run).agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return runs.agg(
        F.max_by(F.struct(run, "last_seen", "n"), F.struct("last_seen", run)).alias("_r")
    ).select("_r.*")


def retrain_decision(
    log: DataFrame, run: str, ts: str, min_confidence: float = RETRAIN_CONFIDENCE,
    max_drift: float = RETRAIN_DRIFT,
) -> DataFrame:
    """Decision on the newest run: trigger with reasons, healthy, or none for an empty log."""
    newest = latest_run(log, run, ts).first()[run]
    health = health_summary(log.filter(F.col(run).eqNullSafe(F.lit(newest))))
    conf, drift = F.col("avg_confidence"), F.col("avg_drift")
    bad = (conf < min_confidence) | (drift > max_drift)
    return health.select(
        conf, drift, "n",
        F.when(F.col("n") == 0, "none").when(bad, "retrain").otherwise("healthy").alias(
            "decision"),
        F.when(F.coalesce(bad, F.lit(False)),
               reason_list(conf, drift, min_confidence, max_drift)).otherwise("").alias("reasons"),
    )


def drift_score(train: DataFrame, serving: DataFrame, value: str, window: str) -> DataFrame:
    """KS distance between the training values and each serving window's values.

    The gap of two step functions is largest at a serving value or just before one, so the
    training share is only needed there. Training values are ordered once for all windows.
    """
    v = F.col(value).cast("double").alias("value")
    # missing values have no place among the others
    train = train.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    serving = serving.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    known = train.groupBy(v).agg(F.count(F.lit(1)).alias("t"))
    asked = serving.groupBy(window, v).agg(F.count(F.lit(1)).alias("n"))
    places = (
        known.unionByName(asked.select("value", F.lit(0).cast("long").alias("t")))
        .groupBy("value").agg(F.sum("t").alias("t"))
    )
    train_upto = with_running_sums(places, [F.col("value")], {"ct": "t"})
    serve_upto = with_running_sums(asked, [F.col("value")], {"cs": "n"}, [window])
    n_train = F.lit(train.select(v).agg(F.count("value")).first()[0])
    sizes = asked.groupBy(window).agg(F.sum("n").alias("n_window"))
    at = F.col("cs") / F.col("n_window") - F.col("ct") / n_train
    before = (F.col("cs") - F.col("n")) / F.col("n_window") - (
        F.col("ct") - F.col("t")
    ) / n_train
    gaps = (
        join_null_safe(serve_upto.join(train_upto, "value"), sizes, [window])
        .groupBy(window)
        .agg(
            F.max(F.greatest(F.abs(at), F.abs(before))).alias("d"),
            F.max("n_window").alias("n_window"),
        )
    )
    p = kolmogorov_p(F.col("d"), F.col("n_window"), n_train)
    return gaps.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def run_drift(
    stream: DataFrame, train: DataFrame, value: str, width: str = "1 day"
) -> DataFrame:
    """Collect a stream's values into windows of any width, then score the drift of every window."""
    timed = stream.select(
        F.window(F.col("ts").cast("timestamp"), width)["start"].alias("window_start"),
        F.col(value),
    )
    return drift_score(train, run_to_table(timed, "drift"), value, "window_start")


def score_stream(
    stream: DataFrame, model: PipelineModel, keep: list[str]
) -> DataFrame:
    """Model scores on a stream of feature rows."""
    p = F.col("p1")
    return positive_probability(model.transform(stream)).select(
        *keep, "p1", decide(p).alias("prediction"), confidence(p).alias("confidence")
    )
