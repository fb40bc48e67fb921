"""Extendible hashing: shards of documents that fit a byte limit.

A shard is a prefix of hash bits. The directory starts with one bucket, the empty prefix; a bucket
over the limit splits on one more bit, the others stay. Sizes are summed per fine cell first, so a
round of ``STEP_BITS`` levels reads the rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflight.session import cut_lineage

#: Levels settled by one pass over the rows. The first directory has 2 ** STEP_BITS cells at most.
STEP_BITS = 12
#: Bits from the row's id and text, then bits that part rows which are equal in both.
KEY_BITS, TWIN_BITS = 60, 24
#: Bytes of text in one shard.
LIMIT_BYTES = 64 * 1024 * 1024


def _bits(id_col: str, text_col: str):
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                         F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    head = F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("long")
    twin = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2 ** TWIN_BITS))
    return F.concat(F.lpad(F.bin(head), KEY_BITS, "0"), F.lpad(F.bin(twin), TWIN_BITS, "0"))


def _round(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Directory of one round: each cell of ``high`` bits with the bucket it falls into.

    ``_b_shard`` is null where the cell itself is over the limit and splits in the next round. A
    bucket of one row cannot split and counts as settled.
    """
    cells = rows.groupBy(F.substring("_b_bits", 1, high).alias("_b_cell")).agg(
        F.sum("_b_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    cells = cut_lineage(cells)
    by_depth = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    prefix = F.expr("substring(_b_cell, 1, depth)")
    sizes = by_depth.groupBy("depth", prefix.alias("prefix")).agg(
        F.sum("bytes").alias("_b_shard_bytes"), F.sum("rows").alias("_b_shard_rows"))
    settled = sizes.filter((F.col("_b_shard_bytes") <= limit) | (F.col("_b_shard_rows") <= 1))
    fits = by_depth.select("_b_cell", "depth", prefix.alias("prefix")).join(
        settled, ["depth", "prefix"])
    first = fits.groupBy("_b_cell").agg(F.min(F.struct(
        "depth", "prefix", "_b_shard_bytes", "_b_shard_rows")).alias("s"))
    return cells.select("_b_cell").join(first, "_b_cell", "left").select(
        "_b_cell", F.col("s.prefix").alias("_b_shard"),
        F.col("s._b_shard_bytes").alias("_b_shard_bytes"),
        F.col("s._b_shard_rows").alias("_b_shard_rows"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Every row of ``docs`` with its shard.

    Adds ``shard`` (the bucket's bits, empty for the undivided table), ``shard_depth``,
    ``shard_bytes`` and ``shard_rows``; a column of ``docs`` with such a name is replaced. Bytes are
    those of the text in UTF-8, 0 for null. A null id counts as an empty one. Rows with equal id and
    text are parted by their place in the input, which must give the same rows in the same order
    when it is read again (a table or a checkpoint does). A single row over the limit is a shard of
    its own. An empty table gives an empty result.

    Only the first directory, of 2 ** STEP_BITS cells at most, is broadcast. Later ones join by the
    hashed prefix; nothing reaches the driver but one count a round.
    """
    own = ["shard", "shard_depth", "shard_bytes", "shard_rows"]
    rows = docs.drop(*own).withColumns({
        "_b_bits": _bits(id_col, text_col),
        "_b_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")})
    narrow = rows.select("_b_bits", "_b_bytes")
    done, low, pending, directories = 0, 0, None, []
    while True:
        high = min(low + STEP_BITS, KEY_BITS + TWIN_BITS)
        part = narrow if pending is None else narrow.join(
            pending, F.substring("_b_bits", 1, low) == F.col("_b_over"), "left_semi")
        directory = cut_lineage(_round(part, low, high, limit_bytes))
        directories.append((high, directory))
        over = directory.filter(F.col("_b_shard").isNull())
        done = high
        if done == KEY_BITS + TWIN_BITS or over.isEmpty():
            break
        pending, low = over.select(F.col("_b_cell").alias("_b_over")), high
    found = ["_b_shard", "_b_shard_bytes", "_b_shard_rows"]
    for n, (high, directory) in enumerate(directories):
        named = directory.toDF("_b_cell", *[f"{c}_{n}" for c in found])
        named = F.broadcast(named) if n == 0 else named
        key = F.substring("_b_bits", 1, high)
        if n:  # rows that are settled stay out of the later, larger directories' keys
            key = F.when(F.col(f"_b_shard_{n - 1}").isNull(), key)
        rows = rows.join(named, key == F.col("_b_cell"), "left").drop("_b_cell")
    last = F.substring("_b_bits", 1, done)  # bits ran out: the cell is the shard
    pick = {c: F.coalesce(*[F.col(f"{c}_{n}") for n in range(len(directories))]) for c in found}
    rows = rows.withColumns({
        "shard": F.coalesce(pick["_b_shard"], last),
        "shard_bytes": pick["_b_shard_bytes"], "shard_rows": pick["_b_shard_rows"]})
    return rows.withColumn("shard_depth", F.length("shard")).select(
        *[c for c in docs.columns if c not in own], *own)


def oracle(limit_bytes: int = LIMIT_BYTES) -> str:
    """DuckDB: the shortest prefix that fits, from the sizes of all prefixes."""
    return f"""
WITH k AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':'
      || md5(coalesce(text, ''))), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
d AS (SELECT unnest(range(0, 30)) AS depth),
p AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(bytes)::BIGINT AS bytes,
        count(*) AS n FROM k, d GROUP BY ALL),
f AS (SELECT * FROM p WHERE bytes <= {limit_bytes} OR n = 1),
m AS (SELECT k.doc_id, k.bits, min(f.depth) AS depth FROM k JOIN f
        ON f.shard = substr(k.bits, 1, f.depth) GROUP BY ALL)
SELECT m.doc_id, f.shard, f.depth::INT AS shard_depth, f.bytes AS shard_bytes, f.n AS shard_rows
FROM m JOIN f ON f.depth = m.depth AND f.shard = substr(m.bits, 1, m.depth)"""
