"""Secrets in texts: fixed rules, and character Markov models of random strings and identifiers.

Each model is a table of character transitions, learned from labelled samples. A candidate, a run of
the characters that keys are made of outside of the rules' spans, is a secret if the random model
explains it better: its log-likelihood ratio, summed over its characters, reaches a threshold.
"""

from __future__ import annotations

from functools import partial
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflight.llm.common import computed_once, text_of

# Kinds in the order of the report, with their patterns. A match of ``assign`` counts if
# its second group has 12 characters or more, one of ``access`` if it has 18.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX_RUN = r"[0-9a-f]{16,}"  # the matches of [0-9a-f]+ that count
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

#: Candidates of the models: keys are runs of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}(?![A-Za-z0-9+/_-])"
#: Log-likelihood ratio from which a candidate is a secret: over 1,000 to 1.
THRESHOLD = 7.0
#: Matches whose lengths are summed at once; places come from blocks of this many.
BLOCK = 256
#: Labelled samples of each class that are made where the caller gives none.
SAMPLES = 4000

# Words that identifiers are put together from.
PARTS = (
    "get set put add new old max min sum avg num idx key val map list item user name path file line "
    "text word page node edge tree root leaf left right first last next prev begin end start stop "
    "open close read write load save init reset update delete create remove insert select order "
    "group count total size length width height depth level index offset buffer stream source "
    "target value type class object module package import export config option param argument "
    "result return error message status state event action handler listener manager service client "
    "server request response session context thread process queue stack cache memory storage table "
    "column row cell field record schema model view control button label image color style layout "
    "window frame panel dialog menu string number integer double float boolean array vector matrix "
    "random secure public private static final abstract interface default internal external").split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text, secret``: random strings of the usual alphabets (1), and identifiers in the usual
    styles made of two to five words (0). The same rows in every run."""
    digest = F.concat(*[F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit(s)), 256)) for s in "ab"])
    base64 = F.regexp_replace(F.base64(digest), r"[\r\n=]", "")
    length = (20 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(29))).cast("int")
    shape = F.pmod("id", F.lit(5))
    random = F.when(shape == 0, F.lower(F.hex(digest))).when(shape == 4, F.hex(digest)).when(
        shape == 1, F.upper(F.regexp_replace(base64, "[+/]", "")))
    random = random.when(shape == 2, F.translate(base64, "+/", "-_")).otherwise(base64)
    secret = spark.range(n).select(F.substring(random, F.lit(1), length).alias("text"),
                                   F.lit(1).alias("secret"))
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    words = F.transform(
        F.sequence(F.lit(1), (2 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4))).cast("int")),
        lambda i: F.get(parts, F.pmod(F.xxhash64("id", i), F.lit(len(PARTS))).cast("int")))
    style = F.pmod("id", F.lit(6))
    name = F.when(style == 0, F.concat_ws("_", words)).when(
        style == 1, F.concat_ws("", F.transform(words, F.initcap))).when(
        style == 2, F.upper(F.concat_ws("_", words))).when(
        style == 3, F.concat_ws("-", words)).when(style == 4, F.concat_ws("/", words)).otherwise(
        F.concat_ws("", words))
    name = F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0, F.concat(
        name, F.pmod(F.col("id"), F.lit(100)).cast("string"))).otherwise(name)
    return secret.unionByName(spark.range(n).select(name.alias("text"), F.lit(0).alias("secret")))


def _symbol(char: Column) -> Column:
    """Number of a character: a-z 0 to 25, A-Z 26 to 51, 0-9 52 to 61, others 62, the start 63."""
    code = F.ascii(char)
    return F.when(code.between(97, 122), code - 97).when(code.between(65, 90), code - 39).when(
        code.between(48, 57), code + 4).otherwise(62)


def _transitions(text: Column) -> Column:
    """Numbers of the transitions of a string, from its start."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), _symbol)
    return F.zip_with(F.concat(F.array(F.lit(63)), F.slice(chars, 1, F.greatest(
        F.size(chars) - 1, F.lit(0)))), chars, lambda a, b: a * 64 + b)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary: 4,096 numbers.

    ``samples`` has ``text`` and ``secret`` 0 or 1; null texts and labels are left out. Transitions are
    counted in Spark and smoothed by adding one; only the 4,096 ratios reach the driver.
    """
    seen = samples.filter("text is not null and secret is not null").select(
        (F.col("secret") > 0).alias("secret"), F.explode(_transitions(F.col("text"))).alias("step"))
    counts = seen.groupBy("step").agg(F.count_if(F.col("secret")).alias("random"),
                                      F.count_if(~F.col("secret")).alias("plain"))
    rows = F.floor(F.col("step") / 64)
    totals = counts.groupBy(rows.alias("row")).agg(F.sum("random").alias("r"), F.sum("plain").alias("p"))
    ratios = counts.join(totals, rows == F.col("row")).select("step", F.log(
        (F.col("random") + 1) / (F.col("r") + 64)) - F.log((F.col("plain") + 1) / (F.col("p") + 64)))
    of_row = {t.row: (t.r, t.p) for t in totals.collect()}  # 64 rows at most
    out = []
    for row in range(64):
        r, p = of_row.get(row, (0, 0))
        out += [_log_ratio(r, p)] * 64
    for step, ratio in ratios.collect():  # 4,096 rows at most
        out[step] = ratio
    return out


def _log_ratio(r: int, p: int) -> float:
    """Of a transition that neither class has."""
    return log(1 / (r + 64)) - log(1 / (p + 64))


def _with_places(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the lengths of each pattern's matches and the gaps before them, and the place at which
    each block of matches begins. No array is copied for a match, so a text may hold any number."""
    def added(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        return rows.select("*", *[computed_once(v).alias(c) for c, v in values.items()])

    def by_block(name: str, part) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(f"{name}_steps") - 1) / BLOCK).cast("int"))
        return F.when(F.size(f"{name}_steps") > 0, F.transform(blocks, lambda b: _sum(part(b))))

    rows = added(rows, {f"{n}_steps": F.zip_with(
        F.col(f"{n}_found"), F.slice(f"{n}_gaps", F.lit(1), F.size(f"{n}_found")),
        lambda match, gap: F.length(match) + F.length(gap)) for n in names})
    rows = added(rows, {f"{n}_sums": by_block(n, partial(_block, f"{n}_steps")) for n in names})
    return added(rows, {f"{n}_begin": by_block(n, partial(F.slice, f"{n}_sums", F.lit(1))) for n in names})


def _block(steps: str, b: Column) -> Column:
    return F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _spans(name: str, kind: int) -> Column:
    """Spans of a pattern's matches, in code points, from the columns of ``_with_places``."""
    def span(match: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        end = F.get(F.col(f"{name}_begin"), block) + _sum(F.slice(
            f"{name}_steps", block * BLOCK + 1, i % BLOCK + 1))
        return F.struct((end - F.length(match)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"))

    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    return F.coalesce(F.transform(f"{name}_found", span), none)


def _blanked(name: str, counts) -> Column:
    """The text with blanks for the matches that count, null where the pattern has no match."""
    def piece(match: Column, i: Column) -> Column:
        return F.concat(F.get(F.col(f"{name}_gaps"), i), F.when(
            counts(match, i), F.repeat(F.lit(" "), F.length(match))).otherwise(match))

    pieces = F.concat(F.transform(f"{name}_found", piece),
                      F.array(F.element_at(f"{name}_gaps", -1)))
    return F.when(F.size(f"{name}_found") > 0, F.array_join(pieces, ""))


def _blank_in_any(texts: list[Column]) -> Column:
    """Copies of one text laid over each other; nulls have no blanks of their own."""
    out = texts[0]
    for other in texts[1:]:
        both = F.array_join(F.zip_with(F.split(out, ""), F.split(other, ""),
                                       lambda x, y: F.when(x == " ", x).otherwise(y)), "")
        out = F.when(other.isNull(), out).when(out.isNull(), other).otherwise(both)
    return out


def _matches(name: str, gate: str, pattern: str, text_col: str = "text") -> list[Column]:
    """Matches and gaps of a pattern, null where the gate does not match the text."""
    text = F.col(text_col)
    passed = text.rlike(gate)
    return [computed_once(F.when(passed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias(
                f"{name}_found"),
            computed_once(F.when(passed, F.split(text, pattern, -1))).alias(f"{name}_gaps")]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``id, spans``: one row per row of ``docs``; ``spans`` is a sorted ``array<struct<start, kind, end>>``.

    Places are code points from 0, end exclusive; ``kind`` is the place in ``KINDS``. Rules and models
    see the whole text. Candidates of the models are runs of 12 characters or more of what the rules'
    spans leave of the text; the ratio alone decides on them. Null and empty texts have no spans, equal
    texts equal ones; ids are not looked at. A row is worked on alone, in time that grows with its length.
    """
    ratios = ratios if ratios is not None else train(labelled_samples(docs.sparkSession))
    table = F.split(F.lit(",".join(f"{r:.9f}" for r in ratios)), ",").cast("array<double>")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select(
        "id", "text", *_matches("assign", ASSIGN, ASSIGN),
        computed_once(F.when(text.rlike(ASSIGN), F.regexp_extract_all(
            text, F.lit(ASSIGN), F.lit(2)))).alias("values"),
        *_matches("access", rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4}}}", ACCESS),
        *_matches("hex", rf"[0-9a-f]{{{HEX_LENGTH}}}", HEX_RUN))
    rows = _with_places(rows, ["assign", "access", "hex"])
    assign = F.filter(_spans("assign", 0), lambda s, i: F.length(F.get("values", i)) >= ASSIGN_LENGTH)
    access = F.filter(_spans("access", 1), lambda s: s["end"] - s["start"] >= ACCESS_LENGTH)
    left = [_blanked("assign", lambda m, i: F.length(F.get("values", i)) >= ASSIGN_LENGTH),
            _blanked("access", lambda m, i: F.length(m) >= ACCESS_LENGTH),
            _blanked("hex", lambda m, i: F.lit(True))]
    rows = rows.select("id", computed_once(F.concat(assign, access, _spans("hex", 2))).alias("base"), "text",
                       *[computed_once(c).alias(f"left_{n}") for n, c in enumerate(left)])
    rows = rows.select("id", "base", computed_once(F.coalesce(_blank_in_any(
        [F.col(f"left_{n}") for n in range(len(left))]), F.col("text"))).alias("text"))
    rows = _with_places(rows.select("id", "base", "text", *_matches("long", CANDIDATE, CANDIDATE)), ["long"])

    def worth(candidate: Column) -> Column:
        return F.aggregate(_transitions(candidate), F.lit(0.0).cast("double"),
                           lambda a, t: a + F.get(table, t.cast("int")))

    secret = F.filter(_spans("long", 3), lambda s, i: worth(F.get("long_found", i)) >= threshold)
    return rows.select("id", F.array_sort(F.concat("base", secret)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Columns of the query from the scan's."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))
