"""Column expressions for probabilities, decisions and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recommendation texts and risk levels of the decision table.
HIGHLY_RECOMMENDED = "✅ HIGHLY RECOMMENDED - High approval probability, low toxicity risk"
RECOMMENDED = "✅ RECOMMENDED - Likely approved with acceptable safety profile"
CAUTION = "⚠️ CAUTION - May be approved but has toxicity concerns"
PROCEED_WITH_CAUTION = "⚠️ PROCEED WITH CAUTION - Approval likely but safety unclear"
NOT_RECOMMENDED_LOW = "❌ NOT RECOMMENDED - Low approval probability despite low toxicity"
STRONGLY_NOT_RECOMMENDED = (
    "🛑 STRONGLY NOT RECOMMENDED - Low approval probability with toxicity risk"
)
NOT_RECOMMENDED = "❌ NOT RECOMMENDED - Unlikely to be approved"
APPROVAL_LABELS = {0: "❌ NOT APPROVED", 1: "✅ FDA APPROVED"}


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL (NaN sorts above infinity, so one test is enough)."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def is_finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def fill_constant(c: Column, value: float) -> Column:
    """NaN or NULL replaced by a constant; infinities stay."""
    return F.coalesce(nan_to_null(c), F.lit(float(value)))


def decide(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).when(p.isNotNull(), 0).cast("int")


def confidence(p: Column, threshold: float = 0.5) -> Column:
    """Probability of the class that ``decide`` picks."""
    return F.when(p >= threshold, p).otherwise(F.lit(1.0) - p)


def weighted_vote(
    p_first: Column, p_second: Column, weight: float = 0.6, invert_second: bool = True
) -> Column:
    second = F.lit(1.0) - p_second if invert_second else p_second
    return F.lit(weight) * p_first + F.lit(round(1.0 - weight, 12)) * second


def vote_struct(p_first: Column, p_second: Column, vote: Column) -> Column:
    """The vote with both inputs kept beside it."""

    def part(p: Column) -> Column:
        return F.struct(
            decide(p).alias("prediction"),
            confidence(p).alias("confidence"),
            (F.lit(1.0) - p).alias("p0"),
            p.alias("p1"),
        )

    return F.struct(
        (F.lit(1.0) - vote).alias("p0"),
        vote.alias("p1"),
        part(p_first).alias("first"),
        part(p_second).alias("second"),
    )


def _table(
    approve: Column, toxic: Column, approve_conf: Column, toxic_conf: Column, cells: dict
) -> Column:
    both_high = (approve_conf > 0.8) & (toxic_conf > 0.8)
    return (
        F.when((approve == 1) & (toxic == 0) & both_high, cells["safe_sure"])
        .when((approve == 1) & (toxic == 0), cells["safe"])
        .when((approve == 1) & (toxic == 1) & (toxic_conf > 0.7), cells["risky_sure"])
        .when((approve == 1) & (toxic == 1), cells["risky"])
        .when((approve == 0) & (toxic == 0), cells["unlikely"])
        .when((approve_conf > 0.7) & (toxic_conf > 0.7), cells["rejected_sure"])
        .otherwise(cells["rejected"])
    )


def recommendation(approve: Column, toxic: Column, approve_conf: Column, toxic_conf: Column):
    return _table(
        approve,
        toxic,
        approve_conf,
        toxic_conf,
        {
            "safe_sure": HIGHLY_RECOMMENDED,
            "safe": RECOMMENDED,
            "risky_sure": CAUTION,
            "risky": PROCEED_WITH_CAUTION,
            "unlikely": NOT_RECOMMENDED_LOW,
            "rejected_sure": STRONGLY_NOT_RECOMMENDED,
            "rejected": NOT_RECOMMENDED,
        },
    )


def risk_level(approve: Column, toxic: Column, approve_conf: Column, toxic_conf: Column):
    return _table(
        approve,
        toxic,
        approve_conf,
        toxic_conf,
        {
            "safe_sure": "LOW",
            "safe": "LOW-MODERATE",
            "risky_sure": "MODERATE-HIGH",
            "risky": "MODERATE",
            "unlikely": "MODERATE",
            "rejected_sure": "HIGH",
            "rejected": "MODERATE-HIGH",
        },
    )


def label_text(prediction: Column, texts: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, text in texts.items():
        out = F.when(prediction == value, text).otherwise(out)
    return out


def confidence_band(inside: Column) -> Column:
    return F.when(inside, "HIGH").otherwise("LOW")


def uncertainty(p: Column) -> Column:
    """Distance from the undecided point; small means uncertain."""
    return F.abs(p - F.lit(0.5))


def mean_of_scores(*scores: Column) -> Column:
    """Mean of the scores present in a row."""
    present = [F.when(s.isNotNull(), 1).otherwise(0) for s in scores]
    total, n = F.lit(0.0), F.lit(0)
    for s, flag in zip(scores, present):
        total, n = total + F.coalesce(s, F.lit(0.0)), n + flag
    return F.when(n > 0, total / n)


def rule_flag(limits: dict[str, float]) -> Column:
    """True when every named column is at most its limit (missing values fail)."""
    flag = F.lit(True)
    for name, limit in limits.items():
        flag = flag & (F.col(name) <= F.lit(limit))
    return F.coalesce(flag, F.lit(False))


# Rule-of-five limits.
LIPINSKI_LIMITS = {"MolWt": 500, "LogP": 5, "NumHDonors": 5, "NumHAcceptors": 10}


def any_positive(*flags: Column) -> Column:
    """Largest of the present flags; NULL when all are missing (NaN counts as missing)."""
    return F.greatest(*[nan_to_null(f.cast("double")) for f in flags]).cast("int")


def composite_score(f1: Column, auc: Column, missing_auc: Column) -> Column:
    return (f1 + F.coalesce(nan_to_null(auc), missing_auc)) / 2


def improvement_pct(value: Column, baseline: Column) -> Column:
    """Change against the baseline in percent; 0 when either side is missing."""
    return F.coalesce((value - baseline) / F.nullif(baseline, F.lit(0.0)) * 100, F.lit(0.0))


def reason_list(avg_confidence: Column, avg_drift: Column, min_conf: float, max_drift: float):
    reasons = F.array_compact(
        F.array(
            F.when(
                avg_confidence < min_conf,
                F.format_string(f"Low confidence: %.4f < {min_conf}", avg_confidence),
            ),
            F.when(
                avg_drift > max_drift,
                F.format_string(f"High drift: %.4f > {max_drift}", avg_drift),
            ),
        )
    )
    return F.array_join(reasons, ", ")


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)
