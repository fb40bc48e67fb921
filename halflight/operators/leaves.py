"""What one more training row would change in a forest whose trees keep their shape.

Every row falls into one leaf of each tree. With the shapes held fixed a new row only adds its weight
to the class counts of its leaves, so it moves the probability of exactly the rows beside it there.
The F1 of a validation table with each of many candidates added, one at a time, comes from one join of
candidates and validation rows by leaf; no forest is grown again.

Only validation rows that a candidate could push over the decision take part: a row's probability
cannot move further than if a candidate shared all its leaves.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.functions.scoring import decide
from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

#: Probabilities are compared at this many digits, so that the order of a sum does not matter.
DIGITS = 12


def forest_leaves(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, tree, leaf: one row for each row and tree of a fitted forest."""
    forest = model.stages[-1].copy().setLeafCol("_leaf")
    made = rows
    for stage in model.stages[:-1]:
        made = stage.transform(made)
    return forest.transform(made).select(*keep, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf")).select(
        *keep, "tree", F.col("leaf").cast("int").alias("leaf"))


def leaf_counts(train_leaves: DataFrame, target: str, weights: dict[int, float]) -> DataFrame:
    """``tree, leaf, n0, n1``: weight of each class among the training rows of every leaf."""
    total = lambda y: F.sum(F.when(F.col(target) == y, F.lit(float(weights[y]))).otherwise(0.0))
    return train_leaves.filter(F.col(target).isNotNull()).groupBy("tree", "leaf").agg(
        total(0).alias("n0"), total(1).alias("n1"))


def leaf_scores(leaves: DataFrame, counts: DataFrame, keys: list[str], trees: int) -> DataFrame:
    """``keys``, p1, up, down: mean share of class 1 over the leaves of a row, and how far one more row of
    class 1 or 0 in all its leaves would move it. A leaf without training rows counts for nothing."""
    p, up, down = _moves()
    moved = counts.select("tree", "leaf", p.alias("p"), up.alias("up"), down.alias("down"))
    joined = leaves.join(broadcast_if_small(moved), ["tree", "leaf"], "left")
    mean = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0.0))) / trees, DIGITS)
    return joined.groupBy(*keys).agg(*[
        mean(F.col(c)).alias(name) for c, name in (("p", "p1"), ("up", "up"), ("down", "down"))])


def _moves() -> tuple[Column, Column, Column]:
    """Share of class 1 in a leaf, and its change by one more row of class 1 or of class 0."""
    n0, n1, w0, w1 = F.col("n0"), F.col("n1"), F.col("w0"), F.col("w1")
    share = n1 / (n0 + n1)
    return share, (n1 + w1) / (n0 + n1 + w1) - share, n1 / (n0 + n1 + w0) - share


def candidate_f1(
    train_leaves: DataFrame, validate_leaves: DataFrame, candidate_leaves: DataFrame, row_id: str,
    target: str, weights: dict[int, float] | None = None,
) -> DataFrame:
    """``row_id, tp, fp, fn, f1, base_f1``: validation F1 with each candidate added alone.

    Every table has one row for each row and tree: ``row_id``, ``tree``, ``leaf`` and ``target``, for
    candidates the label they would be given. ``weights`` are those of the classes, by default balanced
    over the training rows. Validation rows without a label take no part; an F1 without any positive row
    or decision is 0.
    """
    trees = train_leaves.agg(F.countDistinct("tree")).first()[0] or 1
    if weights is None:
        seen = {r[target]: r["count"] for r in train_leaves.filter("tree = 0").groupBy(target).count().collect()}
        known = {y: n for y, n in seen.items() if y is not None}
        weights = {y: sum(known.values()) / (2 * known[y]) if known.get(y) else 1.0 for y in (0, 1)}
    counts = cut_lineage(leaf_counts(train_leaves, target, weights).withColumns(
        {"w0": F.lit(float(weights[0])), "w1": F.lit(float(weights[1]))}))
    judged = validate_leaves.filter(F.col(target).isNotNull())
    scored = cut_lineage(leaf_scores(judged, counts, [row_id, target], trees).withColumn(
        "prediction", decide(F.col("p1"))))
    y, said = F.col(target) == 1, F.col("prediction") == 1
    number = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    base = scored.agg(number(y & said).alias("tp"), number(~y & said).alias("fp"),
                      number(y & ~said).alias("fn")).first()

    near = scored.filter((~said & (decide(F.col("p1") + F.col("up")) == 1))
                         | (said & (decide(F.col("p1") + F.col("down")) == 0)))
    near = near.select(row_id, F.col(target).alias("truth"), "p1", "prediction")
    beside = judged.select(row_id, "tree", "leaf").join(broadcast_if_small(cut_lineage(near)), row_id).select(
        F.col(row_id).alias("other"), "truth", "p1", "prediction", "tree", "leaf")
    _, up, down = _moves()
    moved = counts.select("tree", "leaf", up.alias("up"), down.alias("down"))
    label = F.col(target) == 1
    asked = candidate_leaves.join(broadcast_if_small(moved), ["tree", "leaf"]).select(
        row_id, "tree", "leaf", label.alias("positive"), F.when(label, F.col("up")).otherwise(F.col("down")).alias("move"))
    # a row of class 1 only lifts decisions of 0, one of class 0 only lowers decisions of 1
    pairs = asked.join(beside, ["tree", "leaf"]).filter(F.col("positive") == (F.col("prediction") == 0))
    sums = pairs.groupBy(row_id, "other", "truth", "p1", "prediction").agg(
        F.round(F.sum("move") / trees, DIGITS).alias("move"))
    flipped = sums.filter(decide(F.round(F.col("p1") + F.col("move"), DIGITS)) != F.col("prediction"))
    true, gain = F.col("truth") == 1, F.when(F.col("prediction") == 0, 1).otherwise(-1)
    per = flipped.groupBy(row_id).agg(
        F.sum(F.when(true, gain).otherwise(0)).alias("d_tp"), F.sum(F.when(~true, gain).otherwise(0)).alias("d_fp"))
    rows = candidate_leaves.select(row_id).distinct().join(per, row_id, "left").na.fill(0, ["d_tp", "d_fp"])
    tp, fp = F.lit(base["tp"]) + F.col("d_tp"), F.lit(base["fp"]) + F.col("d_fp")
    fn = F.lit(base["fn"]) - F.col("d_tp")
    f1 = lambda t, a, b: F.coalesce(2 * t / F.nullif(2 * t + a + b, F.lit(0)), F.lit(0.0))
    return rows.select(row_id, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), f1(tp, fp, fn).alias("f1"),
                       f1(F.lit(base["tp"]), F.lit(base["fp"]), F.lit(base["fn"])).alias("base_f1"))
