"""SpotSigs: document fingerprints of content words that follow common-word anchors.

A signature is a common word and the next content words after it, with the few common words between
left out; longer runs of common words break the chain. A fingerprint is the set of a text's signatures. Two sets are compared by Jaccard likeness;
their lengths alone rule most pairs out, since a likeness of t needs lengths within a factor of t.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halflight.llm.common import null_safe_key, text_of
from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

# Common words of four languages, the anchors of the chains.
ANCHORS = (
    "the a an and of to in is was are be been for on with as by at from that this it not or "
    "der die das und ist von zu mit den dem ein eine nicht auf für des sich im "
    "le la les de du et un une est en que qui dans pour sur pas au avec par "
    "el los las y del se por con una al lo es su").split()
#: Content words in a chain, and common words that may stand before each of them.
CHAIN, GAP = 2, 8


def normal(text: Column) -> Column:
    """Lower-cased runs of letters and digits with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def signatures(words: Column, anchors: tuple[str, ...] | list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted set of signatures, 31 bits each, of a normal text.

    A text without a full chain has one signature, that of all its words, so that equal texts are
    alike and others are not.
    """
    anchor = f"(?:{'|'.join(sorted(set(anchors)))})"
    common = rf" {anchor}(?![^ ])"
    spot = rf"(?<![^ ])(?=({anchor}(?= )(?:(?:{common}){{0,{GAP}}}+(?!{common}) [^ ]+){{{chain}}}))"
    chains = F.regexp_extract_all(words, F.lit(spot), F.lit(1))

    def bits(value: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 33).cast("int")

    found = F.transform(chains, lambda c: bits(F.regexp_replace(c, common, "")))
    return F.array_sort(F.array_distinct(F.concat(found, F.when(
        ~words.rlike(spot), F.array(bits(words))).otherwise(F.expr("cast(array() as array<int>)")))))


def written(sigs: Column) -> Column:
    """A fingerprint as text: eight hex digits per signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def length_partition(sigs: Column, at_least: float) -> Column:
    """Number of the partition of a set by its length; sets with a likeness of ``at_least`` or more
    are in the same partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / -math.log(at_least)).cast("int")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two fingerprints; 0 where their lengths show that it is under ``at_least``,
    without a look at their members."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))
    if at_least <= 0:
        return exact
    return F.when(small >= large * at_least, F.when(exact >= at_least, exact)).otherwise(F.lit(0.0))


def next_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """``this, next``: each distinct id with the next smaller one, the smallest with the largest.

    Null ranks below all ids. Ids are dealt out by range; each range is one window, and the heads of
    the ranges, as many as partitions, join the ranges up.
    """
    ref = F.struct(F.col(id_col).alias("id"))
    parts = ids.select(ref.alias("ref")).distinct()
    parts = cut_lineage(parts.repartitionByRange(F.col("ref").desc()).select(
        "ref", F.spark_partition_id().alias("part")))
    inside = parts.withColumn("lead", F.lead("ref").over(
        Window.partitionBy("part").orderBy(F.col("ref").desc())))
    heads = cut_lineage(parts.groupBy("part").agg(F.max("ref").alias("head")))
    order = Window.orderBy("part")  # one row per partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("after"))
    return inside.join(broadcast_if_small(heads), "part").select(
        F.col("ref.id").alias("this"), F.coalesce("lead", "after")["id"].alias("next"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, sigs, edited, edited_sigs, next_sigs``: one row per row of ``docs``.

    ``edited`` is the text with its last third, rounded down, replaced by as many first code points of
    the next document by descending id, or by all of it if it is shorter. Null texts are empty. Where
    several rows have the next id, the least of their heads is taken; rows of equal id have the same
    next document. Texts move once, by id; of the next document only the head that is needed moves on.
    """
    # the key alone names a row until the end: both joins read the same columns of one shuffle
    texts = docs.select(null_safe_key(id_col).alias("key"), text_of(text_col).alias("text"))
    texts = texts.withColumn("sigs", signatures(normal(F.col("text"))))
    follow = next_ids(docs, id_col)
    follow = follow.select(null_safe_key("this").alias("key"), null_safe_key("next").alias("next"))
    takes = texts.select("key", F.floor(F.length("text") / 3).cast("int").alias("take")).groupBy("key").agg(
        F.max("take").alias("take"))
    wanted = follow.join(takes, "key").select(F.col("key").alias("this"), "next", "take")
    heads = texts.join(wanted, F.col("key") == F.col("next")).select(
        "this", F.expr("substring(text, 1, take)").alias("head"), F.col("sigs").alias("next_sigs"))
    heads = heads.groupBy("this").agg(F.min(F.struct("head", "next_sigs")).alias("given"))
    rows = texts.join(heads, F.col("key") == F.col("this"))
    own = F.when(F.col("key") != "", F.substring("key", 2, 2 ** 31 - 1).cast(docs.schema[id_col].dataType))
    rows = rows.select(own.alias("id"), "text", "sigs", F.col("given.next_sigs").alias("next_sigs"), F.expr(
        "concat(substring(text, 1, length(text) - cast(floor(length(text) / 3) as int)), "
        "substring(given.head, 1, cast(floor(length(text) / 3) as int)))").alias("edited"))
    return rows.withColumn("edited_sigs", signatures(normal(F.col("edited"))))


def digest(compared: DataFrame) -> DataFrame:
    """Columns of the query."""
    return compared.select(
        F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), written(F.col("sigs")).alias("fingerprint"),
        written(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_partition(F.col("sigs"), 0.8).alias("length_partition"))
