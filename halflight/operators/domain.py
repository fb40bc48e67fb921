"""Projection, clustering, and the distance-based domain in which a model is trusted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halflight.operators.clusters import best_run, cluster_runs
from halflight.operators.quantiles import exact_quantiles

CENTRE_BLOCK = 5000


def pca_project(
    train: DataFrame, test: DataFrame, features: str = "features", components: int = 2
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Centred projection fitted on train; (train, test, explained variance shares)."""
    centre = StandardScaler(
        inputCol=features, outputCol="_centred", withMean=True, withStd=False
    ).fit(train)
    centred = centre.transform(train)
    pca = PCA(k=components, inputCol="_centred", outputCol="pca").fit(centred)
    shares = list(pca.explainedVariance.toArray())
    return (
        pca.transform(centred).drop("_centred"),
        pca.transform(centre.transform(test)).drop("_centred"),
        shares,
    )


def distance_to(vector: Column, centre: Column) -> Column:
    """Euclidean distance of two array columns."""
    squares = F.zip_with(vector, centre, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def nearest_centroid(df: DataFrame, vector: str, centres: DataFrame) -> DataFrame:
    """Nearest centre and its distance, ties to the lowest id; ``centres`` has centre_id and an
    array column centre. A row without a vector, or any row when there is no centre, gets nulls.

    Centres go through the driver and to the tasks in blocks of ``CENTRE_BLOCK`` by id, as arrays;
    each Arrow batch of rows meets a block as one matrix, and the best of all blocks counts.
    """
    kind = centres.schema["centre_id"].dataType.simpleString()
    known = centres.select("centre_id", F.col("centre").cast("array<double>")).orderBy("centre_id")
    x = F.col(vector).cast("array<double>")
    block, found = [], []

    def matched(rows) -> Column:
        ids = [r["centre_id"] for r in rows]
        places = np.array([r["centre"] for r in rows], dtype=float)

        @F.pandas_udf(f"dist double, centre_id {kind}")
        def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                there = batch.notna().to_numpy()
                dist, best = np.full(len(batch), np.nan), [None] * len(batch)
                where = np.flatnonzero(there)
                step = max(1, 4_000_000 // places.size)
                for at in range(0, len(where), step):
                    part = where[at:at + step]
                    q = np.stack(batch.iloc[part].to_numpy()).astype(float)
                    gaps = np.sqrt(np.square(q[:, None, :] - places[None]).sum(2))
                    nearest = gaps.argmin(1)
                    dist[part] = gaps[np.arange(len(part)), nearest]
                    for i, j in zip(part, nearest, strict=True):
                        best[i] = ids[j]
                yield pd.DataFrame({"dist": dist, "centre_id": pd.Series(best, dtype=object)})

        return match(x)

    for row in known.toLocalIterator():
        block.append(row)
        if len(block) == CENTRE_BLOCK:
            found.append(matched(block))
            block = []
    if block:
        found.append(matched(block))
    if not found:
        return df.withColumns({"centre_id": F.lit(None).cast(kind), "dist": F.lit(None).cast("double")})
    names = [f"_n{i}" for i in range(len(found))]
    placed = df.withColumns(dict(zip(names, found, strict=True)))
    best = F.array_min(F.array(*names)) if len(names) > 1 else F.col(names[0])
    missing = F.col(vector).isNull()
    return placed.select(
        *df.columns, F.when(~missing, best["centre_id"]).alias("centre_id"),
        F.when(~missing, best["dist"]).alias("dist"))


def class_centres(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector per class; partial means are merged before rows move."""
    rows = df.select(
        F.col(label).alias("centre_id"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return rows.groupBy("centre_id").agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre"))


def inertia_by_k(
    train: DataFrame, features: str, ks: range = range(2, 11), seed: int = 42
) -> list[tuple[int, float]]:
    """Within-cluster sum of squares of the best seeding for each k; all runs share their passes."""
    runs = cluster_runs(train, features, ks, seed=seed)
    return [(k, best_run(runs, k).inertia) for k in ks]


def elbow_k(inertias: DataFrame) -> DataFrame:
    """k whose second difference ratio of the inertia is smallest; input k, inertia.

    The table has one row per tried k. The ratio at position i names the k two steps on.
    """
    by_k = W.orderBy("k")
    steps = inertias.select("k", (F.col("inertia") - F.lag("inertia").over(by_k)).alias("d"))
    ratios = steps.select(
        "k", (F.col("d") / F.lag("d").over(by_k)).alias("ratio")
    ).filter("ratio is not null")
    return ratios.agg(F.min_by("k", F.struct("ratio", "k")).alias("best_k"))


def kmeans_assign(
    train: DataFrame, test: DataFrame, features: str = "features", k: int | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters fitted on train, both tables assigned to their nearest centre.

    Returns (train, test, centres); k comes from the elbow when not given, with the clustering that
    the elbow has seen. Where no elbow can be told, the smallest k is taken.
    """
    spark = train.sparkSession
    ks = range(2, 11) if k is None else range(k, k + 1)
    runs = cluster_runs(train, features, ks, seed=seed)
    if k is None:
        tried = spark.createDataFrame([(n, best_run(runs, n).inertia) for n in ks],
                                      "k int, inertia double")
        k = elbow_k(tried).first()["best_k"] or ks[0]
    centres = spark.createDataFrame(
        list(enumerate(best_run(runs, k).centres)), "centre_id int, centre array<double>")

    def assign(df):
        return nearest_centroid(
            df.withColumn("_x", F.when(F.col(features).isNotNull(), vector_to_array(features))), "_x", centres
        ).drop("_x")

    return assign(train), assign(test), centres


def domain_threshold(train: DataFrame, dist: str = "dist", level: float = 0.95) -> float:
    return exact_quantiles(train, [dist], [level])[dist][0]


def applicability_domain(
    train: DataFrame, test: DataFrame, dist: str = "dist", level: float = 0.95
) -> DataFrame:
    """Test rows flagged inside when their distance is within the training percentile."""
    threshold = domain_threshold(train, dist, level)
    return test.withColumn("threshold", F.lit(threshold)).withColumn(
        "inside", F.col(dist) <= F.lit(threshold)
    )


def domain_accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows, share and accuracy inside and outside the domain."""
    total = F.lit(df.count())
    return df.groupBy("inside").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
    ).withColumn("share", F.col("n") / total)


def distance_profile(df: DataFrame, dist: str = "dist") -> DataFrame:
    p95 = exact_quantiles(df, [dist], [0.95])[dist][0]
    x = F.col(dist)
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    ).withColumn("p95", F.lit(p95))
