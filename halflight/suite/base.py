"""Registry of queries and the inputs they share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflight.functions.text import PUNCTUATION
from halflight.plans.training import describe_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison; only ever in a last projection."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def q6(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"


# --- documents: descriptors, labels, pool --------------------------------------------------

DESC = ["t_chars", "t_words", "t_distinct", "t_digit", "t_upper", "t_punct", "t_lines",
        "t_wordlen"]


def descriptors(spark, sf):
    return describe_documents(table(spark, sf, "documents"))


def doc_labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))


def labelled_docs(spark, sf):
    """Descriptors and the toxic label of every labelled document."""
    labels = doc_labels(spark, sf)
    # rows are chosen before any text is measured
    chosen = table(spark, sf, "documents").join(labels, "doc_id", "left_semi")
    return describe_documents(chosen).join(labels, "doc_id")


def pool_docs(spark, sf):
    return describe_documents(
        table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti"))


def _share(chars: str) -> str:
    quoted = chars.replace("'", "''")
    return (f"coalesce((length(text) - length(translate(text, '{quoted}', '')))"
            f" / nullif(length(text), 0), 0.0)")


FEATS = rf"""
tokens AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w
  FROM documents),
feats AS (
  SELECT doc_id,
    CAST(length(text) AS DOUBLE) AS t_chars,
    CAST(len(w) AS DOUBLE) AS t_words,
    coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0.0) AS t_distinct,
    {_share("0123456789")} AS t_digit,
    {_share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS t_upper,
    {_share(PUNCTUATION)} AS t_punct,
    CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS t_lines,
    coalesce(length(translate(text, concat(' ', chr(9), chr(13), chr(10)), ''))
      / nullif(len(w), 0), 0.0) AS t_wordlen
  FROM tokens)"""

LABELLED = f"""{FEATS},
labelled AS (SELECT f.*, l.toxic AS label FROM feats f JOIN labels l USING (doc_id)),
pool AS (SELECT f.* FROM feats f ANTI JOIN labels l USING (doc_id))"""


# --- lineitem: numeric matrix, two scores and a label --------------------------------------

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def squash(z: Column) -> Column:
    """A number put between 0 and 1 by plain arithmetic, so both engines get the same bits."""
    return F.lit(0.5) + z / (F.lit(2.0) * (F.lit(1.0) + F.abs(z)))


def squash_sql(z: str) -> str:
    return f"0.5::DOUBLE + ({z}) / (2.0::DOUBLE * (1.0::DOUBLE + abs({z})))"


def scored_lines(spark, sf):
    """Every line with a label, a main score, a second score and the run it belongs to."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.col("l_returnflag").alias("method"),
        F.year("l_shipdate").cast("long").alias("n_unlabeled"),
        F.when(q + t * 200 > 30, 1).otherwise(0).alias("label"),
        squash((q - 25) / 8 - d * 10).alias("p1"),
        squash(t * 40 - d * 5 - 1).alias("p2"),
        squash(q / 10 - t * 20 - 2).alias("p3"),
    )


LINES = f"""
scored AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag AS method,
    CAST(year(l_shipdate) AS BIGINT) AS n_unlabeled,
    CASE WHEN l_quantity + l_tax * 200 > 30 THEN 1 ELSE 0 END AS label,
    {squash_sql("(l_quantity - 25) / 8 - l_discount * 10")} AS p1,
    {squash_sql("l_tax * 40 - l_discount * 5 - 1")} AS p2,
    {squash_sql("l_quantity / 10 - l_tax * 20 - 2")} AS p3
  FROM lineitem)"""


# --- part: line notations put together from fragments --------------------------------------

# Fragments of line notations; a few are broken on purpose.
FRAGMENTS = ["CC(=O)O", "c1ccccc1", "N", "C(=O)N", "[Na+].[Cl-]", "CBr", "C1CC1", "OC(F)F",
             "c1ccc2ccccc2c1", "C%12CCC%12", "[nH]"]
BROKEN = ["C(", "C1C", "C]", "C?"]


def structures(spark, sf):
    """A notation for every part; some parts get one that is broken or empty."""
    pick = F.array(*[F.lit(f) for f in FRAGMENTS])
    bad = F.array(*[F.lit(f) for f in BROKEN])
    at = lambda c, arr, n: F.element_at(arr, (F.pmod(c, F.lit(n)) + 1).cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    body = F.concat(at(k, pick, len(FRAGMENTS)), at(size, pick, len(FRAGMENTS)),
                    at(k + size, pick, len(FRAGMENTS)))
    text = F.when(size == 13, F.lit("  ")).when(
        size > 45, F.concat(body, at(k, bad, len(BROKEN)))
    ).otherwise(F.concat(F.lit(" "), body))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), text.alias("smiles"), "p_size", "p_type", "p_brand"
    )


def _sql_list(items):
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _pick(expr, items):
    return f"({_sql_list(items)})[CAST(({expr}) % {len(items)} + 1 AS INT)]"


_BODY = "concat({}, {}, {})".format(
    _pick("p_partkey", FRAGMENTS), _pick("p_size", FRAGMENTS),
    _pick("p_partkey + p_size", FRAGMENTS))

STRUCTURES = f"""
structures AS (
  SELECT p_partkey AS row_id, p_size, p_type, p_brand,
    CASE WHEN p_size = 13 THEN '  '
         WHEN p_size > 45 THEN concat({_BODY}, {_pick("p_partkey", BROKEN)})
         ELSE concat(' ', {_BODY}) END AS smiles
  FROM part)"""

_DIGITS = " AND ".join(
    f"(length(narrow) - length(replace(narrow, '{d}', ''))) % 2 = 0" for d in "0123456789")

CLEANED = rf"""{STRUCTURES},
bare AS (
  SELECT *, trim(smiles) AS s,
    regexp_replace(trim(smiles), '\[[^\[\]]+\]', '', 'g') AS b FROM structures),
narrowed AS (SELECT *, regexp_replace(b, '%[0-9][0-9]', '', 'g') AS narrow FROM bare),
cleaned AS (
  SELECT row_id, p_size, p_type, p_brand, smiles,
    CASE WHEN length(s) > 0
      AND regexp_matches(s, '^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$')
      AND NOT regexp_matches(b, '[\[\]]')
      AND length(replace(b, '(', '')) = length(replace(b, ')', ''))
      AND NOT regexp_matches(b, '^[^(]*\)')
      AND len(regexp_extract_all(b, '%[0-9][0-9]')) % 2 = 0
      AND {_DIGITS} THEN s END AS clean
  FROM narrowed)"""


# --- events: monitoring log ----------------------------------------------------------------


def monitoring_log(events: DataFrame) -> DataFrame:
    """Latency, confidence and drift of every request; the run is the day."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("run"), "user_id", "event_type", "value",
        (F.col("value") / 10).alias("latency_ms"),
        (F.lit(0.4) + k / F.lit(170.0)).alias("confidence"),
        (F.col("value") / 1000).alias("drift"),
    )


LOG = """
log AS (
  SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS run, user_id, event_type, value,
    value / 10 AS latency_ms,
    CAST(0.4 AS DOUBLE) + CAST(json_extract_string(props, '$.k') AS INT) / 170.0 AS confidence,
    value / 1000 AS drift
  FROM events)"""


# --- embeddings: graph nodes ---------------------------------------------------------------


def graph_nodes(spark, sf):
    """id, v, the true class and the label, which is hidden for most rows by their hash."""
    truth = F.when(F.col("label") < 5, 1).otherwise(0)
    shown = F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("-42"))) < F.lit("4")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
        truth.alias("truth"), F.when(shown, truth).alias("label"),
    )


NODES = """
nodes AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
    CASE WHEN label < 5 THEN 1 ELSE 0 END AS truth,
    CASE WHEN md5(concat(vec_id, '-42')) < '4' THEN CASE WHEN label < 5 THEN 1 ELSE 0 END END
      AS label
  FROM embeddings)"""


def knn_sql(k: int, include_self: bool, queries: str = "nodes", data: str = "nodes") -> str:
    same = "" if include_self else "WHERE a.id <> b.id"
    return f"""
pairs AS (
  SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist
  FROM {queries} a CROSS JOIN {data} b {same}),
edges AS (
  SELECT src, dst, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM pairs)
  WHERE rn <= {k})"""
