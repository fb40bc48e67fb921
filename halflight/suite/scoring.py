"""Decisions, votes, texts, line notations and batch scoring."""

from pyspark.sql import functions as F

from halflight.functions import scoring as fn
from halflight.functions import structure as st
from halflight.operators import featurize as feat
from halflight.operators import score
from halflight.operators.domain import class_centres, domain_threshold
from halflight.operators.domain import nearest_centroid as nearest
from halflight.operators.models import apply_inputs, fit_inputs, logistic_regression
from halflight.operators.selftrain import view_ensemble as ensemble
from halflight.session import cut_lineage
from halflight.suite.base import (
    CLEANED,
    DESC,
    FEATS,
    LINES,
    descriptors,
    labelled_docs,
    q6,
    query,
    r6,
    scored_lines,
    structures,
    table,
)
from halflight.suite.cleaning import R6_DESC, rounded

KEY = ["l_orderkey", "l_linenumber"]


def decision_sql(p: str, pred: str, conf: str) -> str:
    return (f"CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END AS {pred},"
            f" CASE WHEN {p} >= 0.5 THEN {p} ELSE 1 - {p} END AS {conf}")


@query("decide", f"""
WITH {LINES}, d AS (SELECT *, {decision_sql("p1", "prediction", "conf")} FROM scored)
SELECT l_orderkey, l_linenumber, prediction, {q6("conf", "confidence")} FROM d""")
def decide(spark, sf):
    p = F.col("p1")
    return scored_lines(spark, sf).select(
        *KEY, fn.decide(p).alias("prediction"), r6(fn.confidence(p), "confidence"))


VOTE = f"""{LINES}, voted AS (
  SELECT *, 0.6::DOUBLE * p1 + 0.4::DOUBLE * (1.0 - p2) AS p_vote FROM scored),
decided AS (SELECT *, {decision_sql("p_vote", "prediction", "confidence")},
  {decision_sql("p1", "pred_1", "conf_1")}, {decision_sql("p2", "pred_2", "conf_2")},
  {decision_sql("p3", "toxic", "toxic_conf")} FROM voted)"""


@query("weighted_vote", f"""
WITH {VOTE} SELECT l_orderkey, l_linenumber, prediction, {q6("confidence")}, {q6("1 - p_vote", "p0")},
  {q6("conf_1", "first_confidence")}, pred_2 AS second_prediction FROM decided""")
def weighted_vote(spark, sf):
    out = score.with_vote(scored_lines(spark, sf), "p1", "p2")
    parts = F.col("probabilities")
    return out.select(
        *KEY, "prediction", r6("confidence"), r6(parts["p0"], "p0"),
        r6(parts["first"]["confidence"], "first_confidence"),
        parts["second"]["prediction"].alias("second_prediction"))


def table_sql(high, some, caution, careful, unlikely, strong, other) -> str:
    return f"""CASE
  WHEN prediction = 1 AND toxic = 0 THEN
    CASE WHEN confidence > 0.8 AND toxic_conf > 0.8 THEN '{high}' ELSE '{some}' END
  WHEN prediction = 1 THEN CASE WHEN toxic_conf > 0.7 THEN '{caution}' ELSE '{careful}' END
  WHEN toxic = 0 THEN '{unlikely}'
  ELSE CASE WHEN confidence > 0.7 AND toxic_conf > 0.7 THEN '{strong}' ELSE '{other}' END END"""


TEXTS = table_sql(fn.HIGHLY_RECOMMENDED, fn.RECOMMENDED, fn.CAUTION, fn.PROCEED_WITH_CAUTION,
                  fn.NOT_RECOMMENDED_LOW, fn.STRONGLY_NOT_RECOMMENDED, fn.NOT_RECOMMENDED)
LEVELS = table_sql("LOW", "LOW-MODERATE", "MODERATE-HIGH", "MODERATE", "MODERATE", "HIGH",
                   "MODERATE-HIGH")


@query("decision_table", f"""
WITH {VOTE} SELECT l_orderkey, l_linenumber, {TEXTS} AS recommendation, {LEVELS} AS risk_level
FROM (SELECT l_orderkey, l_linenumber, pred_1 AS prediction, conf_1 AS confidence, toxic,
  toxic_conf FROM decided)""")
def decision_table(spark, sf):
    p, t = F.col("p1"), F.col("p3")
    return score.with_recommendation(
        scored_lines(spark, sf), fn.decide(p), fn.decide(t), fn.confidence(p), fn.confidence(t)
    ).select(*KEY, "recommendation", "risk_level")


@query("label_text", f"""
WITH {LINES} SELECT l_orderkey, l_linenumber,
  CASE label WHEN 1 THEN '{fn.APPROVAL_LABELS[1]}' ELSE '{fn.APPROVAL_LABELS[0]}' END AS text
FROM scored""")
def label_text(spark, sf):
    return scored_lines(spark, sf).select(
        *KEY, fn.label_text(F.col("label"), fn.APPROVAL_LABELS).alias("text"))


@query("confidence_band", f"""
WITH {LINES} SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <= 40000 THEN 'HIGH'
  ELSE 'LOW' END AS band FROM scored""")
def confidence_band(spark, sf):
    return scored_lines(spark, sf).select(
        *KEY, fn.confidence_band(F.col("l_extendedprice") <= 40000).alias("band"))


@query("uncertainty_score", f"""
WITH {LINES} SELECT l_orderkey, l_linenumber, {q6("abs(p1 - 0.5)", "uncertainty")} FROM scored""")
def uncertainty_score(spark, sf):
    return scored_lines(spark, sf).select(*KEY, r6(fn.uncertainty(F.col("p1")), "uncertainty"))


@query("mean_of_scores", f"""
WITH {LINES} SELECT l_orderkey, l_linenumber, {q6(
    "CASE WHEN label = 1 THEN (p1 + p2) / 2 ELSE (p1 + p2 + p3) / 3 END", "mean_score")}
FROM scored""")
def mean_of_scores(spark, sf):
    third = F.when(F.col("label") == 0, F.col("p3"))
    return scored_lines(spark, sf).select(
        *KEY, r6(fn.mean_of_scores(F.col("p1"), F.col("p2"), third), "mean_score"))


@query("score_complete", f"""
WITH {VOTE} SELECT l_orderkey, l_linenumber, prediction, {q6("confidence")}, toxic AS toxic_prediction,
  CASE prediction WHEN 1 THEN '{fn.APPROVAL_LABELS[1]}' ELSE '{fn.APPROVAL_LABELS[0]}' END
    AS prediction_label, {TEXTS} AS recommendation, {LEVELS} AS risk_level FROM decided""")
def score_complete(spark, sf):
    return score.score_complete(scored_lines(spark, sf), "p1", "p2", "p3").select(
        *KEY, "prediction", r6("confidence"), "toxic_prediction", "prediction_label",
        "recommendation", "risk_level")


# --- two models over orders ----------------------------------------------------------------

MODELS = """
first AS (SELECT o_orderkey, 1 / (1 + exp((250000 - o_totalprice) / 90000)) AS p1 FROM orders
  WHERE o_orderstatus <> 'P'),
second AS (SELECT o_orderkey, o_totalprice / 600000 AS p1 FROM orders
  WHERE o_orderpriority <> '5-LOW')"""


def two_models(spark, sf):
    orders, price = table(spark, sf, "orders"), F.col("o_totalprice")
    return (
        orders.filter("o_orderstatus <> 'P'").select(
            "o_orderkey", (1 / (1 + F.exp((F.lit(250000.0) - price) / 90000))).alias("p1")),
        orders.filter("o_orderpriority <> '5-LOW'").select(
            "o_orderkey", (price / 600000).alias("p1")))


@query("two_model_join", f"""
WITH {MODELS}, pair AS (SELECT o_orderkey, a.p1 AS p_first, b.p1 AS p_second FROM first a
  JOIN second b USING (o_orderkey))
SELECT o_orderkey, {q6("p_first")}, round(p_second, 12) AS p_second, NULL AS error FROM pair
UNION ALL SELECT o_orderkey, NULL, NULL, 'prediction failed' FROM orders
  ANTI JOIN pair USING (o_orderkey)""")
def two_model_join(spark, sf):
    requests = table(spark, sf, "orders").select("o_orderkey")
    done, failed = score.two_model_join(requests, *two_models(spark, sf), "o_orderkey")
    rows = rounded(done.unionByName(failed, allowMissingColumns=True), ["p_first"])
    # cents over 600000 often end in a 5 at the 7th digit, where engines round differently
    return rows.withColumn("p_second", F.round("p_second", 12))


@query("view_ensemble", f"""
WITH {MODELS}, pair AS (SELECT o_orderkey, (a.p1 + b.p1) / 2 AS p FROM first a
  JOIN second b USING (o_orderkey)), d AS (SELECT *, {decision_sql("p", "prediction", "conf")} FROM pair)
SELECT o_orderkey, {q6("p", "p1")}, prediction, {q6("conf", "confidence")} FROM d""")
def view_ensemble(spark, sf):
    return rounded(
        ensemble(*two_models(spark, sf), "o_orderkey").drop("p_first", "p_second"),
        ["p1", "confidence"])


@query("batch_summary", f"""
WITH {CLEANED} SELECT count(*) AS total, count(clean) AS successful,
  count(*) - count(clean) AS failed FROM cleaned""")
def batch_summary(spark, sf):
    ok = st.clean_structure(F.col("smiles")).isNotNull()
    return score.batch_summary(
        structures(spark, sf).withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), "bad")))


# --- line notations ------------------------------------------------------------------------

TOKENS = rf"""{CLEANED},
tok AS (SELECT row_id, clean, regexp_replace(clean, '\[[^\[\]]+\]', '', 'g') AS b,
  regexp_extract_all(clean, '{st.TOKEN}', 1) AS tokens FROM cleaned WHERE clean IS NOT NULL)"""


def tokens(spark, sf):
    return structures(spark, sf).select(
        "row_id", st.clean_structure(F.col("smiles")).alias("clean")
    ).filter("clean is not null").withColumn("tokens", st.atom_tokens(F.col("clean")))


@query("clean_structure", f"WITH {CLEANED} SELECT row_id, clean FROM cleaned")
def clean_structure(spark, sf):
    return structures(spark, sf).select(
        "row_id", st.clean_structure(F.col("smiles")).alias("clean"))


@query("atom_tokens", f"""
WITH {TOKENS} SELECT row_id, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n FROM tok""")
def atom_tokens(spark, sf):
    return tokens(spark, sf).select(
        "row_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


_ELEMENT = rf"regexp_extract(t, '{st.ELEMENT}', 1)"


@query("hetero_and_halogen_counts", f"""
WITH {TOKENS} SELECT row_id,
  len(list_filter(tokens, lambda t: lower({_ELEMENT}) NOT IN ('c', 'h'))) AS hetero,
  len(list_filter(tokens, lambda t: {_ELEMENT} IN ('F', 'Cl', 'Br', 'I'))) AS halogen FROM tok""")
def hetero_and_halogen_counts(spark, sf):
    t = F.col("tokens")
    return tokens(spark, sf).select(
        "row_id", st.hetero_count(t).alias("hetero"), st.halogen_count(t).alias("halogen"))


@query("ring_count", f"""
WITH {TOKENS} SELECT row_id,
  CAST(len(regexp_extract_all(b, '%[0-9][0-9]|[0-9]')) // 2 AS INT) AS rings FROM tok""")
def ring_count(spark, sf):
    return tokens(spark, sf).select("row_id", st.ring_count(F.col("clean")).alias("rings"))


@query("aromatic_and_branch_counts", rf"""
WITH {TOKENS} SELECT row_id,
  len(list_filter(tokens, lambda t: regexp_matches(t, '^(\[[0-9]*)?[bcnops]'))) AS aromatic,
  length(b) - length(replace(b, '(', '')) AS branches,
  len(string_split(clean, '.')) AS components,
  len(list_filter(tokens, lambda t: regexp_matches(t, '^\[.*[+-]'))) AS charged FROM tok""")
def aromatic_and_branch_counts(spark, sf):
    s, t = F.col("clean"), F.col("tokens")
    return tokens(spark, sf).select(
        "row_id", st.aromatic_count(t).alias("aromatic"), st.branch_count(s).alias("branches"),
        st.component_count(s).alias("components"), st.charged_count(t).alias("charged"))


_RUNS = " || ".join(
    f"list_transform(range(1, greatest(len(tokens) - {n} + 2, 1)), "
    f"lambda i: array_to_string(tokens[i:i + {n} - 1], ' '))" for n in (1, 2, 3))


@query("hashed_fingerprint", f"""
WITH {TOKENS}, runs AS (SELECT row_id, unnest({_RUNS}) AS run FROM tok),
hashed AS (SELECT DISTINCT row_id, ('0x' || substr(md5(run), 1, 8))::BIGINT % 2048 AS b FROM runs),
made AS (SELECT row_id, count(*)::INT AS bits, string_agg(b, ',' ORDER BY b) AS fingerprint
  FROM hashed GROUP BY row_id)
SELECT row_id, coalesce(bits, 0) AS bits, coalesce(fingerprint, '') AS fingerprint
FROM tok LEFT JOIN made USING (row_id)""")
def hashed_fingerprint(spark, sf):
    out = feat.hashed_fingerprint(tokens(spark, sf), "tokens")
    return out.select("row_id", feat.set_bits().alias("bits"),
                      F.array_join("fingerprint", ",").alias("fingerprint"))


@query("text_descriptors", f"WITH {FEATS} SELECT doc_id, {R6_DESC} FROM feats")
def text_descriptors(spark, sf):
    return rounded(descriptors(spark, sf), DESC)


@query("molecular_summary", f"""
WITH {FEATS} SELECT doc_id, {q6("t_chars", "molecular_weight")}, {q6("t_upper", "logp")},
  CAST(t_lines AS INT) AS h_donors FROM feats""")
def molecular_summary(spark, sf):
    out = score.molecular_summary(
        descriptors(spark, sf),
        {"molecular_weight": "t_chars", "logp": "t_upper", "h_donors": "t_lines"}, {"h_donors"})
    s = F.col("summary")
    return out.select("doc_id", r6(s["molecular_weight"], "molecular_weight"),
                      r6(s["logp"], "logp"), s["h_donors"].alias("h_donors"))


@query("json_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CAST(json_object('type', event_type, 'k', CAST(json_extract_string(props, '$.k') AS INT))
    AS VARCHAR) AS emitted FROM events""")
def json_props(spark, sf):
    parsed = F.from_json("props", "k int")
    return table(spark, sf, "events").select(
        "event_id", parsed["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("type"), parsed["k"].alias("k"))).alias(
            "emitted"))


@query("run_stamp", """
SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, epoch(ts) AS seconds FROM events""")
def run_stamp(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", fn.run_stamp(ts).alias("stamp"), fn.epoch_seconds(ts).alias("seconds"))


@query("reason_list", """
WITH u AS (SELECT user_id, avg(0.4::DOUBLE + CAST(json_extract_string(props, '$.k') AS INT) / 170.0) AS c,
  avg(value / 1000) * 2 AS d FROM events GROUP BY user_id)
SELECT user_id, concat_ws(', ',
  CASE WHEN c < 0.7 THEN printf('Low confidence: %.4f < 0.7', c) END,
  CASE WHEN d > 0.25 THEN printf('High drift: %.4f > 0.25', d) END) AS reasons FROM u""")
def reason_list(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    users = table(spark, sf, "events").groupBy("user_id").agg(
        F.avg(F.lit(0.4) + k / F.lit(170.0)).alias("c"),
        (F.avg(F.col("value") / 1000) * 2).alias("d"))
    return users.select(
        "user_id", fn.reason_list(F.col("c"), F.col("d"), 0.7, 0.25).alias("reasons"))


@query("featurize", """
SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE CAST(length(text) AS DOUBLE) END AS chars,
  CASE WHEN lang = 'de' THEN NULL
    ELSE CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) END AS letter_e
FROM documents""")
def featurize(spark, sf):
    """A user function that fails on some rows; those come back as NULL."""

    def measure(text):
        if text.startswith("de|"):
            raise ValueError("not supported")
        return [len(text) - 3, text.count("e") - text[:3].count("e")]

    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("lang"), F.lit("|"), F.col("text")).alias("text"))
    return feat.featurize(docs, "doc_id", "text", measure, ["chars", "letter_e"])


# --- batch scoring -------------------------------------------------------------------------


@query("score_batch", """
SELECT doc_id, CASE WHEN length(trim(text)) > 20 THEN NULL ELSE 'invalid input' END AS error,
  CASE WHEN length(trim(text)) > 20 THEN true END AS consistent FROM documents""")
def score_batch(spark, sf):
    """Every document once: scored, with a decision and a confidence that follow from the score, or
    rejected with an error."""
    train = cut_lineage(labelled_docs(spark, sf))
    model = logistic_regression(train, DESC, "label", clip=3.0, scale=True)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = descriptors(spark, sf).join(docs, "doc_id")
    done, bad = score.score_batch(rows, model, DESC, "doc_id", "text",
                                  F.length(F.trim("text")) > 20)
    p = F.col("p1")
    same = p.between(0, 1) & (F.col("prediction") == (p >= 0.5).cast("int")) & (
        F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-12)
    return done.select("doc_id", F.lit(None).cast("string").alias("error"), same.alias("consistent")).unionByName(
        bad.select("doc_id", "error", F.lit(None).cast("boolean").alias("consistent")))


@query("score_with_domain")
def score_with_domain(spark, sf):
    raw = cut_lineage(labelled_docs(spark, sf))
    inputs, _ = fit_inputs(raw, DESC, "label", clip=3.0, scale=True)
    train = cut_lineage(apply_inputs(raw, inputs, DESC))
    model = logistic_regression(train, DESC, "label")
    placed = train.withColumn("x", F.array(*[F.col(c) for c in DESC]))
    centres = class_centres(placed, "x", "label")
    threshold = domain_threshold(nearest(placed, "x", centres))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = apply_inputs(descriptors(spark, sf), inputs, DESC).join(docs, "doc_id")
    done, bad = score.score_with_domain(
        rows, model, DESC, "doc_id", "text", F.length(F.trim("text")) > 20, centres, threshold)
    return done.unionByName(bad.drop("input"), allowMissingColumns=True)
