"""Streams over the prediction log, and the retraining decision."""

from pyspark.sql import functions as F

from halflight.operators.models import logistic_regression, predict
from halflight.session import cut_lineage, scratch_path
from halflight.streaming import monitor
from halflight.suite.base import (
    DESC,
    LABELLED,
    LOG,
    labelled_docs,
    monitoring_log,
    pool_docs,
    q6,
    query,
    r6,
    table,
)
from halflight.suite.cleaning import rounded


def log_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return monitoring_log(monitor.read_log_stream(spark, f"{sf}/events.parquet", schema))


def log_table(spark, sf):
    return monitoring_log(table(spark, sf, "events"))


@query("latency_alerts", f"""
WITH {LOG} SELECT event_id, run, {q6("latency_ms")} FROM log WHERE latency_ms > 40""")
def latency_alerts(spark, sf):
    alerts = monitor.latency_alerts(log_stream(spark, sf)).select("event_id", "run", "latency_ms")
    return rounded(monitor.run_to_table(alerts, "latency"), ["latency_ms"])


@query("confidence_alerts", f"""
WITH {LOG} SELECT event_id, run, {q6("confidence")} FROM log WHERE confidence < 0.5""")
def confidence_alerts(spark, sf):
    alerts = monitor.confidence_alerts(log_stream(spark, sf)).select(
        "event_id", "run", "confidence")
    return rounded(monitor.run_to_table(alerts, "confidence"), ["confidence"])


MEANS = ["mean_confidence", "mean_drift", "mean_latency_ms"]


@query("monitor_window", f"""
WITH {LOG} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start,
  round(avg(confidence), 12) AS mean_confidence, round(avg(drift), 12) AS mean_drift,
  round(avg(latency_ms), 12) AS mean_latency_ms, count(*) AS n FROM log GROUP BY 1""")
def monitor_window(spark, sf):
    out = monitor.run_windows(log_stream(spark, sf))
    # 12 digits: short decimals averaged over 2^k rows end in a 5 at the 7th digit
    return out.withColumns({c: F.round(c, 12) for c in MEANS}).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("health_summary", f"""
WITH {LOG} SELECT {q6("avg(confidence)", "avg_confidence")}, {q6("avg(drift)", "avg_drift")},
  {q6("avg(latency_ms)", "avg_latency_ms")}, count(*) AS n FROM log""")
def health_summary(spark, sf):
    return rounded(monitor.health_summary(log_table(spark, sf)),
                   ["avg_confidence", "avg_drift", "avg_latency_ms"])


@query("latest_run", f"""
WITH {LOG}, r AS (SELECT run, max(ts) AS last, count(*) AS n FROM log GROUP BY run)
SELECT run, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_seen, n FROM r
ORDER BY last DESC, run DESC LIMIT 1""")
def latest_run(spark, sf):
    return monitor.latest_run(log_table(spark, sf), "run", "ts").withColumn(
        "last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("retrain_decision", f"""
WITH {LOG}, h AS (SELECT avg(confidence) AS c, avg(drift) AS d, count(*) AS n FROM log
  WHERE run = (SELECT max(run) FROM log))
SELECT {q6("c", "avg_confidence")}, {q6("d", "avg_drift")}, n,
  CASE WHEN n = 0 THEN 'none' WHEN c < 0.7 OR d > 0.25 THEN 'retrain' ELSE 'healthy' END AS decision,
  concat_ws(', ', CASE WHEN c < 0.7 THEN printf('Low confidence: %.4f < 0.7', c) END,
    CASE WHEN d > 0.25 THEN printf('High drift: %.4f > 0.25', d) END) AS reasons FROM h""")
def retrain_decision(spark, sf):
    return rounded(monitor.retrain_decision(log_table(spark, sf), "run", "ts"),
                   ["avg_confidence", "avg_drift"])


@query("drift_score", f"""
WITH {LOG}, train AS (SELECT confidence AS x FROM log WHERE event_type <> 'error'),
serving AS (SELECT run, confidence AS x FROM log WHERE event_type = 'error'),
runs AS (SELECT DISTINCT run FROM serving),
tagged AS (SELECT run, x, 1 AS a FROM train, runs UNION ALL SELECT run, x, 0 FROM serving),
per AS (SELECT run, x, sum(a) AS n1, sum(1 - a) AS n0 FROM tagged GROUP BY run, x),
cum AS (SELECT run, sum(n1) OVER w / sum(n1) OVER (PARTITION BY run) AS f1,
  sum(n0) OVER w / sum(n0) OVER (PARTITION BY run) AS f0 FROM per
  WINDOW w AS (PARTITION BY run ORDER BY x))
SELECT run, {q6("max(abs(f1 - f0))", "d")} FROM cum GROUP BY run""")
def drift_score(spark, sf):
    """Error events of every day, arriving as a stream, against all other events."""
    serving = monitor.run_to_table(
        log_stream(spark, sf).filter("event_type = 'error'").select("run", "confidence"), "drift")
    train = log_table(spark, sf).filter("event_type <> 'error'")
    return rounded(monitor.drift_score(train, serving, "confidence", "run").select("run", "d"),
                   ["d"])


@query("run_drift", f"""
WITH {LOG}, train AS (SELECT confidence AS x FROM log WHERE event_type <> 'error'),
serving AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, confidence AS x
  FROM log WHERE event_type = 'error'),
windows AS (SELECT DISTINCT w FROM serving),
tagged AS (SELECT w, x, 1 AS a FROM train, windows UNION ALL SELECT w, x, 0 FROM serving),
per AS (SELECT w, x, sum(a) AS n1, sum(1 - a) AS n0 FROM tagged GROUP BY w, x),
cum AS (SELECT w, sum(n1) OVER s / sum(n1) OVER (PARTITION BY w) AS f1,
  sum(n0) OVER s / sum(n0) OVER (PARTITION BY w) AS f0, sum(n0) OVER (PARTITION BY w) AS n FROM per
  WINDOW s AS (PARTITION BY w ORDER BY x))
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, {q6("max(abs(f1 - f0))", "d")},
  max(n)::BIGINT AS n_window FROM cum GROUP BY w""")
def run_drift(spark, sf):
    """Error events in windows of six hours against all other events."""
    serving = log_stream(spark, sf).filter("event_type = 'error'")
    train = log_table(spark, sf).filter("event_type <> 'error'")
    out = monitor.run_drift(serving, train, "confidence", "6 hours")
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
                              "d", "n_window"), ["d"])


@query("score_stream", f"""
WITH {LABELLED} SELECT doc_id, 0.0 AS gap, true AS consistent FROM pool""")
def score_stream(spark, sf):
    """Scores of pool rows that arrive as a stream, against the same model's batch scores."""
    train = cut_lineage(labelled_docs(spark, sf))
    model = logistic_regression(train, DESC, "label", clip=3.0, scale=True)
    path = scratch_path(spark, "arrivals")
    pool_docs(spark, sf).write.parquet(path)
    arrivals = monitor.read_log_stream(spark, path, spark.read.parquet(path).schema)
    scored = monitor.run_to_table(monitor.score_stream(arrivals, model, ["doc_id"]), "scores")
    batch = predict(model, spark.read.parquet(path), ["doc_id"]).select(
        "doc_id", F.col("p1").alias("p_batch"))
    p = F.col("p1")
    same = (F.col("prediction") == (p >= 0.5).cast("int")) & (
        F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-12)
    return scored.join(batch, "doc_id").select(
        "doc_id", r6(F.abs(p - F.col("p_batch")), "gap"), same.alias("consistent"))
