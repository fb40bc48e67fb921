"""Projection, row cleaning, key joins and feature preparation."""

from pyspark.sql import functions as F

from halflight.functions.scoring import LIPINSKI_LIMITS, rule_flag
from halflight.functions.structure import clean_structure
from halflight.functions.text import VIEW_SIZE, VIEW_STYLE, text_descriptors
from halflight.operators import clean, sample
from halflight.operators.domain import class_centres
from halflight.operators.domain import nearest_centroid as nearest
from halflight.plans import training
from halflight.suite.base import (
    CLEANED,
    DESC,
    FEATS,
    LABELLED,
    NUM,
    descriptors,
    graph_nodes,
    labelled_docs,
    NODES,
    pool_docs,
    q6,
    query,
    r6,
    structures,
    table,
)

R6_NUM = ", ".join(q6(c) for c in NUM)


def rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- columns -------------------------------------------------------------------------------


@query("select_features", "SELECT p_brand, p_type, p_size, p_retailprice FROM part")
def select_features(spark, sf):
    return clean.select_features(table(spark, sf, "part"), ["p_partkey", "p_name"])


@query("feature_intersection", """
SELECT l_tax, l_quantity, l_discount, 'l_weight' AS missing FROM lineitem""")
def feature_intersection(spark, sf):
    out, missing = clean.feature_intersection(
        table(spark, sf, "lineitem"), ["l_tax", "l_weight", "l_quantity", "l_discount"])
    return out.withColumn("missing", F.lit(",".join(missing)))


@query("drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def drop_columns(spark, sf):
    return table(spark, sf, "lineitem").drop(
        *NUM, "l_returnflag", "l_linestatus", "l_shipdate")


@query("schema_diff", """
WITH l AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id)),
     r AS (SELECT count(*) AS n FROM documents),
     names AS (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS "column",
                      'common' AS side
               UNION ALL SELECT unnest(['quality', 'toxic']), 'left')
SELECT "column", side, (SELECT n FROM l) AS left_rows,
  CASE side WHEN 'common' THEN (SELECT n FROM r) ELSE 0 END AS right_rows
FROM names""")
def schema_diff(spark, sf):
    docs = table(spark, sf, "documents")
    joined = docs.join(table(spark, sf, "labels"), "doc_id")
    n_left = joined.select(F.count(F.lit(1))).scalar()
    n_right = docs.select(F.count(F.lit(1))).scalar()
    return clean.schema_diff(joined, docs).select(
        "column", "side",
        F.when(F.col("side") == "right", 0).otherwise(n_left).alias("left_rows"),
        F.when(F.col("side") == "left", 0).otherwise(n_right).alias("right_rows"))


@query("column_set_ops", """
WITH a AS (SELECT DISTINCT props->>'k' AS name FROM events WHERE event_type = 'error'),
     b AS (SELECT DISTINCT props->>'k' AS name FROM events WHERE value > 450)
SELECT name, 'common' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT name, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT name, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def column_set_ops(spark, sf):
    events = table(spark, sf, "events")
    names = lambda rows: rows.select(F.get_json_object("props", "$.k").alias("name")).distinct()
    a, b = names(events.filter("event_type = 'error'")), names(events.filter("value > 450"))
    tag = lambda df, side: df.withColumn("side", F.lit(side))
    return tag(a.intersect(b), "common").unionByName(tag(a.exceptAll(b), "left")).unionByName(
        tag(b.exceptAll(a), "right"))


@query("numeric_columns", "SELECT p_size, p_retailprice FROM part")
def numeric_columns(spark, sf):
    part = table(spark, sf, "part")
    return part.select(clean.numeric_columns(part, ["p_partkey"]))


@query("feature_views", f"""
WITH {FEATS}
SELECT doc_id, {q6(" + ".join(VIEW_SIZE), "view_1")}, {q6(" + ".join(VIEW_STYLE), "view_2")}
FROM feats""")
def feature_views(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from halflight.operators.featurize import view_vectors

    one, two = clean.feature_views(DESC, VIEW_SIZE, VIEW_STYLE)
    total = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x)
    return view_vectors(descriptors(spark, sf), one, two).select(
        "doc_id", r6(total("view_1"), "view_1"), r6(total("view_2"), "view_2"))


# --- rows ----------------------------------------------------------------------------------

ODD = """
odd AS (
  SELECT o_orderkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'NaN'::DOUBLE WHEN '2-HIGH' THEN NULL
      ELSE o_totalprice END AS x,
    CASE o_orderstatus WHEN 'P' THEN 'Infinity'::DOUBLE ELSE o_totalprice / 7 END AS y
  FROM orders)"""


def odd_rows(spark, sf):
    """Orders with NaN, missing and infinite values put in."""
    prio, price = F.col("o_orderpriority"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(prio == "1-URGENT", F.lit(float("nan"))).when(
            prio != "2-HIGH", price).alias("x"),
        F.when(F.col("o_orderstatus") == "P", F.lit(float("inf"))).otherwise(
            price / 7).alias("y"))


@query("drop_nulls", """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def drop_nulls(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels"), "doc_id", "left")
    return clean.drop_nulls(rows, ["quality", "toxic"])


@query("class_filter", """
SELECT doc_id, lang, source, n_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def class_filter(spark, sf):
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1)
    return table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").drop("text")


@query("finite_rows", f"""
WITH {ODD}, kept AS (SELECT * FROM odd WHERE x IS NOT NULL AND isfinite(x) AND isfinite(y))
SELECT o_orderkey, {q6("x")}, {q6("y")},
  (SELECT count(*) FROM odd) - (SELECT count(*) FROM kept) AS removed FROM kept""")
def finite_rows(spark, sf):
    odd = odd_rows(spark, sf)
    removed = clean.finite_report(odd, ["x", "y"]).select("rows_removed").scalar()
    return rounded(clean.finite_rows(odd, ["x", "y"]), ["x", "y"]).withColumn("removed", removed)


@query("inf_to_null", f"""
WITH {ODD} SELECT o_orderkey, CASE WHEN isfinite(x) THEN {q6("x", "_")[:-5]} END AS x,
  CASE WHEN isfinite(y) THEN {q6("y", "_")[:-5]} END AS y FROM odd""")
def inf_to_null(spark, sf):
    return rounded(clean.inf_to_null(odd_rows(spark, sf), ["x", "y"]), ["x", "y"])


@query("median_impute", f"""
WITH {ODD}, fin AS (SELECT o_orderkey, CASE WHEN isfinite(x) THEN x END AS x,
  CASE WHEN isfinite(y) THEN y END AS y FROM odd)
SELECT o_orderkey, {q6("coalesce(x, (SELECT median(x) FROM fin))", "x")},
  {q6("coalesce(y, (SELECT median(y) FROM fin))", "y")} FROM fin""")
def median_impute(spark, sf):
    return rounded(clean.median_impute(odd_rows(spark, sf), ["x", "y"]), ["x", "y"])


@query("fill_constant", f"""
WITH {ODD} SELECT o_orderkey,
  {q6("CASE WHEN x IS NULL OR isnan(x) THEN 0.5 ELSE x END", "x")} FROM odd""")
def fill_constant(spark, sf):
    return rounded(clean.fill_table(odd_rows(spark, sf), ["x"], 0.5), ["x"]).drop("y")


CLIP = ",\n".join(
    f"greatest(least({c}, m_{c} + 1.5 * s_{c}), m_{c} - 1.5 * s_{c}) AS {c}" for c in NUM)
CLIP_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NUM)
CLIP_HITS = " + ".join(
    f"count(*) FILTER (abs({c} - m_{c}) > 1.5 * s_{c})" for c in NUM)


@query("clip_outliers", f"""
WITH st AS (SELECT {CLIP_STATS} FROM lineitem),
hits AS (SELECT {CLIP_HITS} AS outlier_count FROM lineitem, st),
clipped AS (SELECT l_orderkey, l_linenumber, {CLIP} FROM lineitem, st)
SELECT l_orderkey, l_linenumber, {R6_NUM}, outlier_count FROM clipped, hits""")
def clip_outliers(spark, sf):
    out = clean.clip_outliers(table(spark, sf, "lineitem"), NUM, k=1.5)
    return rounded(out.table.select("l_orderkey", "l_linenumber", *NUM), NUM).withColumn(
        "outlier_count", out.outliers.scalar())


@query("any_positive_label", """
SELECT doc_id, greatest(toxic, 1 - quality) AS label FROM documents LEFT JOIN labels USING (doc_id)
WHERE greatest(toxic, 1 - quality) IS NOT NULL""")
def any_positive_label(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels"), "doc_id", "left")
    return clean.any_positive_label(
        rows.withColumn("low", 1 - F.col("quality")).drop("quality"), ["toxic", "low"])


RULE = """
mols AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice / 100 AS "MolWt",
    l_quantity / 8 AS "LogP", l_linenumber AS "NumHDonors", l_suppkey % 20 AS "NumHAcceptors"
  FROM lineitem),
ruled AS (
  SELECT *, "MolWt" <= 500 AND "LogP" <= 5 AND "NumHDonors" <= 5 AND "NumHAcceptors" <= 10 AS ok
  FROM mols)"""


def ruled_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        (F.col("l_extendedprice") / 100).alias("MolWt"), (F.col("l_quantity") / 8).alias("LogP"),
        F.col("l_linenumber").alias("NumHDonors"), (F.col("l_suppkey") % 20).alias("NumHAcceptors"))


@query("lipinski_flag", f"WITH {RULE} SELECT l_orderkey, l_linenumber, ok FROM ruled")
def lipinski_flag(spark, sf):
    return ruled_lines(spark, sf).select(
        "l_orderkey", "l_linenumber", rule_flag(LIPINSKI_LIMITS).alias("ok"))


@query("row_rule", f"WITH {RULE} SELECT l_orderkey, l_linenumber, \"MolWt\" > 300 AND \"LogP\" < 3 AS heavy FROM mols")
def row_rule(spark, sf):
    from halflight.operators.featurize import row_rule as apply_rule

    out = apply_rule(ruled_lines(spark, sf), lambda w, p: (w > 300) & (p < 3), "heavy",
                     ["MolWt", "LogP"])
    return out.select("l_orderkey", "l_linenumber", "heavy")


@query("null_target", """
SELECT doc_id, lang, CAST(NULL AS INT) AS label FROM documents ANTI JOIN labels USING (doc_id)""")
def null_target(spark, sf):
    pool = table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels"), "doc_id", "left_anti")
    return clean.null_target(pool)


@query("validate_input", """
SELECT conv_id, turn, trim(CASE role WHEN 'system' THEN '  ' ELSE concat('  ', text, ' ') END)
  AS text, CASE role WHEN 'system' THEN 'input cannot be empty' END AS error FROM conversations""")
def validate_input(spark, sf):
    """All turns with blanks around their text; system turns come with blanks alone."""
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", "  ").otherwise(
            F.concat(F.lit("  "), F.col("text"), F.lit(" "))).alias("text"))
    return clean.validate_input(rows, "text")


@query("split_valid_invalid", f"""
WITH {CLEANED}
SELECT row_id, smiles AS input, CASE WHEN clean IS NULL THEN 'Invalid SMILES' END AS error
FROM cleaned""")
def split_valid_invalid(spark, sf):
    good, bad = clean.split_valid_invalid(
        structures(spark, sf), "row_id", "smiles",
        clean_structure(F.col("smiles")).isNotNull(), "Invalid SMILES")
    fine = good.select("row_id", F.col("smiles").alias("input"),
                       F.lit(None).cast("string").alias("error"))
    return fine.unionByName(bad)


@query("dedupe_by_key", """
SELECT min(doc_id) AS doc_id, md5(text) AS key, (SELECT count(*) - count(DISTINCT text)
  FROM documents) AS removed FROM documents GROUP BY text""")
def dedupe_by_key(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    removed = clean.dedupe_report(docs, "key").select("rows_removed").scalar()
    return clean.dedupe_by_key(docs, "key", "doc_id").withColumn("removed", removed)


# --- key joins -----------------------------------------------------------------------------

R6_DESC = ", ".join(q6(c) for c in DESC)


@query("attach_features", f"""
WITH {FEATS} SELECT doc_id, lang, source, {R6_DESC} FROM documents JOIN feats USING (doc_id)""")
def attach_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return rounded(clean.attach(docs, descriptors(spark, sf), "doc_id"), DESC)


@query("attach_target", f"""
WITH {FEATS} SELECT doc_id, {R6_DESC}, toxic FROM feats JOIN labels USING (doc_id)""")
def attach_target(spark, sf):
    target = table(spark, sf, "labels").select("doc_id", "toxic")
    return rounded(clean.attach(descriptors(spark, sf), target, "doc_id"), DESC)


@query("broadcast_stats", f"""
WITH st AS (SELECT {CLIP_STATS} FROM lineitem)
SELECT l_orderkey, l_linenumber,
  {", ".join(q6(f"({c} - m_{c}) / s_{c}", f"{c}_dev") for c in NUM)} FROM lineitem, st""")
def broadcast_stats(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUM)
    return rounded(clean.apply_stats(lines, lines, NUM).drop(*NUM), [f"{c}_dev" for c in NUM])


@query("pool_minus_selected", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def pool_minus_selected(spark, sf):
    return sample.pool_minus_selected(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"),
        "doc_id")


@query("pool_selected", "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def pool_selected(spark, sf):
    return sample.pool_selected(
        table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"),
        "doc_id")


@query("nearest_centroid", f"""
WITH {NODES},
long AS (SELECT e.label AS centre_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
           unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings e),
centres AS (SELECT centre_id, list(m ORDER BY pos) AS centre FROM (
  SELECT centre_id, pos, avg(x) AS m FROM long GROUP BY centre_id, pos) GROUP BY centre_id),
gaps AS (SELECT id, centre_id, list_distance(v, centre) AS dist FROM nodes, centres)
SELECT id, arg_min(centre_id, dist) AS centre_id, {q6("min(dist)", "dist")} FROM gaps GROUP BY id""")
def nearest_centroid(spark, sf):
    vectors = table(spark, sf, "embeddings")
    centres = class_centres(vectors, "embedding", "label")
    return rounded(
        nearest(graph_nodes(spark, sf).select("id", "v"), "v", centres).drop("v"), ["dist"])


# --- feature preparation -------------------------------------------------------------------

SCALE_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in DESC)


def scale_sql(cols, stats="st"):
    return ", ".join(
        q6(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END", c) for c in cols)


@query("standard_scale", f"""
WITH {LABELLED}, st AS (SELECT {SCALE_STATS} FROM labelled)
SELECT doc_id, {scale_sql(DESC)} FROM feats, st""")
def standard_scale(spark, sf):
    return rounded(
        clean.standard_scale(descriptors(spark, sf), DESC, fit_on=labelled_docs(spark, sf)), DESC)


@query("variance_filter", f"""
WITH {FEATS}, long AS (UNPIVOT (SELECT {", ".join(DESC)} FROM feats) ON {", ".join(DESC)}
  INTO NAME feature VALUE x)
SELECT feature, {q6("var_pop(x)", "variance")} FROM long GROUP BY feature
HAVING var_pop(x) > 0.01""")
def variance_filter(spark, sf):
    rows = descriptors(spark, sf)
    kept = clean.variance_filter(rows, DESC, 0.01)
    return rows.agg(*[F.var_pop(c).alias(c) for c in kept]).select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), r6(c, "variance")) for c in kept]
    )).alias("_e")).select("_e.*")


def _pairs_sql(cols, source):
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS f1, '{cols[j]}' AS f2,"
        f" corr({cols[i]}, {cols[j]}) AS r FROM {source}"
        for i in range(len(cols)) for j in range(i + 1, len(cols)))


@query("correlation_filter", f"""
WITH {FEATS}, pairs AS ({_pairs_sql(DESC, "feats")}),
names AS (SELECT unnest({DESC}) AS feature)
SELECT feature, (SELECT count(*) FROM feats) AS n FROM names
WHERE feature NOT IN (SELECT f2 FROM pairs WHERE abs(r) > 0.9)""")
def correlation_filter(spark, sf):
    rows = descriptors(spark, sf)
    kept = clean.correlation_filter(rows, DESC, 0.9)
    return rows.agg(*[F.count(c).alias(c) for c in kept]).select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in kept]
    )).alias("_e")).select("_e.*")


PREP = ["t_chars", "t_lines", "t_wordlen", "t_distinct", "t_punct"]


@query("preprocess_descriptors", f"""
WITH {FEATS}, pairs AS ({_pairs_sql(["t_chars", "t_lines", "t_wordlen", "t_distinct"], "feats")}),
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, var_pop({c}) AS v_{c}" for c in PREP)} FROM feats),
long AS (
  {" UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, ({c} - m_{c}) / s_{c} AS x, v_{c} AS v FROM feats, st" for c in PREP)})
SELECT doc_id, feature, {q6("x", "value")} FROM long
WHERE v > 0.01 AND feature NOT IN (SELECT f2 FROM pairs WHERE abs(r) > 0.9)""")
def preprocess_descriptors(spark, sf):
    out, kept = clean.preprocess_descriptors(
        descriptors(spark, sf).select("doc_id", *PREP), PREP, 0.01, 0.9)
    return out.select("doc_id", F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), r6(c, "value")) for c in kept]
    )).alias("_e")).select("doc_id", "_e.*")


def _clip_sql(source, name):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in DESC)
    cols = ", ".join(
        f"greatest(least({c}, m_{c} + 3 * s_{c}), m_{c} - 3 * s_{c}) AS {c}" for c in DESC)
    return (f"{name}_st AS (SELECT {stats} FROM {source}),"
            f" {name} AS (SELECT doc_id, {cols} FROM {source}, {name}_st)")


@query("process_enhanced", f"""
WITH {LABELLED}, {_clip_sql("labelled", "cl")}, {_clip_sql("pool", "cp")},
st AS (SELECT {SCALE_STATS} FROM cl),
both_rows AS (SELECT c.*, l.toxic AS label FROM cl c JOIN labels l USING (doc_id)
  UNION ALL SELECT *, NULL FROM cp)
SELECT doc_id, label, {scale_sql(DESC)} FROM both_rows, st""")
def process_enhanced(spark, sf):
    done = training.process_enhanced(
        labelled_docs(spark, sf), pool_docs(spark, sf), training.Experiment(row_id="doc_id"))
    return rounded(done.labelled.unionByName(done.pool), DESC)


@query("prepare_labelled", f"""
WITH {FEATS},
rows AS (SELECT f.*, greatest(toxic, 1 - quality) AS label FROM feats f
  JOIN documents d USING (doc_id) JOIN labels USING (doc_id) WHERE length(trim(d.text)) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label
    ORDER BY md5(concat(doc_id, '-42')), doc_id) AS rn FROM rows),
labelled AS (SELECT * FROM ranked WHERE rn <= (
  SELECT min(n) FROM (SELECT count(*) AS n FROM rows GROUP BY label))),
{_clip_sql("labelled", "cl")}
SELECT doc_id, label, {R6_DESC} FROM cl JOIN (SELECT doc_id, label FROM labelled) USING (doc_id)""")
def prepare_labelled(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels"), "doc_id", "left").withColumn("low", 1 - F.col("quality"))
    text = F.col("text")
    return rounded(
        training.prepare_labelled(
            rows, "doc_id", "text", F.when(F.length(F.trim(text)) > 0, text),
            ["toxic", "low"], text_descriptors(text)).select("doc_id", "label", *DESC), DESC)
