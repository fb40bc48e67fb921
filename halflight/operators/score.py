"""Scoring whole tables: errors apart, votes, decision table and domain flags."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.functions.scoring import (
    APPROVAL_LABELS,
    confidence,
    confidence_band,
    decide,
    fill_constant,
    label_text,
    recommendation,
    risk_level,
    vote_struct,
    weighted_vote,
)
from halflight.operators.clean import split_valid_invalid
from halflight.operators.domain import nearest_centroid
from halflight.operators.models import predict


def two_model_join(
    requests: DataFrame, first: DataFrame, second: DataFrame, row_id: str
) -> tuple[DataFrame, DataFrame]:
    """(rows scored by both models, error rows for requests either model missed)."""
    both = first.select(row_id, F.col("p1").alias("p_first")).join(
        second.select(row_id, F.col("p1").alias("p_second")), row_id
    )
    failed = requests.join(both.select(row_id), row_id, "left_anti").withColumn(
        "error", F.lit("prediction failed")
    )
    return requests.join(both, row_id), failed


def with_vote(
    df: DataFrame, p_first: str = "p_first", p_second: str = "p_second", weight: float = 0.6
) -> DataFrame:
    vote = weighted_vote(F.col(p_first), F.col(p_second), weight)
    p = F.col("p_vote")
    return df.withColumn("p_vote", vote).withColumns(
        {
            "prediction": decide(p),
            "confidence": confidence(p),
            "probabilities": vote_struct(F.col(p_first), F.col(p_second), p),
        }
    )


def with_recommendation(
    df: DataFrame, approve: Column, toxic: Column, approve_conf: Column, toxic_conf: Column
) -> DataFrame:
    args = (approve, toxic, approve_conf, toxic_conf)
    return df.withColumns({"recommendation": recommendation(*args), "risk_level": risk_level(*args)})


def score_complete(
    df: DataFrame, p_approve: str, p_clinical: str, p_toxic: str, weight: float = 0.6
) -> DataFrame:
    """Vote on approval, decision on toxicity, recommendation and risk level."""
    voted = with_vote(df, p_approve, p_clinical, weight)
    t = F.col(p_toxic)
    full = voted.withColumns(
        {
            "prediction_label": label_text(F.col("prediction"), APPROVAL_LABELS),
            "toxic_prediction": decide(t),
            "toxic_confidence": confidence(t),
        }
    )
    return with_recommendation(
        full, F.col("prediction"), F.col("toxic_prediction"), F.col("confidence"),
        F.col("toxic_confidence"),
    )


def batch_summary(rows: DataFrame, error: str = "error") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def score_batch(
    rows: DataFrame, model: PipelineModel, features: list[str], row_id: str, text: str,
    valid: Column, message: str = "invalid input",
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, error rows). Missing feature values are read as 0; nothing is clipped."""
    good, bad = split_valid_invalid(rows, row_id, text, valid, message)
    filled = good.withColumns({c: fill_constant(F.col(c), 0.0) for c in features})
    return predict(model, filled, [row_id]), bad


def score_with_domain(
    rows: DataFrame, model: PipelineModel, features: list[str], row_id: str, text: str,
    valid: Column, centres: DataFrame, threshold: float,
) -> tuple[DataFrame, DataFrame]:
    """Scores with the distance to the nearest training centre and a HIGH / LOW band."""
    good, bad = split_valid_invalid(rows, row_id, text, valid, "invalid input")
    filled = good.withColumns({c: fill_constant(F.col(c), 0.0) for c in features})
    placed = nearest_centroid(
        filled.withColumn("_x", F.array(*[F.col(c) for c in features])), "_x", centres
    )
    scored = predict(model, placed, [row_id, "dist"])
    inside = F.col("dist") <= F.lit(threshold)
    return scored.withColumn("inside", inside).withColumn(
        "band", confidence_band(F.col("inside"))
    ), bad


def molecular_summary(df: DataFrame, names: dict[str, str], ints: set[str]) -> DataFrame:
    """Typed summary struct from descriptor columns (summary field -> column)."""
    return df.withColumn(
        "summary",
        F.struct(
            *[F.col(c).cast("int" if f in ints else "double").alias(f) for f, c in names.items()]
        ),
    )
