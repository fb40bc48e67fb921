"""End-to-end preparation and training, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.functions.text import DESCRIPTORS, measure_texts
from halflight.operators.clean import (
    any_positive_label,
    attach,
    clip_outliers,
    drop_nulls,
    feature_intersection,
    finite_rows,
    null_target,
    select_features,
    standard_scale,
)
from halflight.operators.graph import (
    knn_edges,
    label_propagation,
    label_spreading,
    rbf_edges,
)
from halflight.operators.kernel import LANDMARKS, kernel_learn
from halflight.operators.sample import downsample_majority, stratified_split
from halflight.session import cut_lineage


@dataclass(frozen=True)
class Experiment:
    """Settings of one run; the defaults are those of the clinical-toxicity experiment."""

    target: str = "label"
    row_id: str = "row_id"
    threshold: float = 0.8
    pool_size: int = 2500
    test_share: float = 0.2
    val_share: float = 0.2
    clip_deviations: float = 3.0
    fit_on: str = "all"  # 'all' labelled rows, or 'train' rows only
    seed: int = 42
    exclude: list[str] = field(default_factory=list)


class Prepared(NamedTuple):
    labelled: DataFrame
    pool: DataFrame
    features: list[str]
    missing: list[str]


def describe_documents(documents: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Row id plus the numeric descriptors of the whole text, as ``text_descriptors`` gives them."""
    kind = documents.schema[row_id].dataType.simpleString()
    return documents.select(row_id, "text").mapInArrow(
        measure_texts, f"`{row_id}` {kind}, " + ", ".join(f"{c} double" for c in DESCRIPTORS))


def process_enhanced(
    labelled: DataFrame, pool: DataFrame, settings: Experiment,
    canonical: list[str] | None = None,
) -> Prepared:
    """Select, clip each table with its own bounds, keep finite rows, scale by the labelled rows.

    Both results are written once, so that every later fit reads finished numbers.
    """
    canonical = canonical or DESCRIPTORS
    ids = [settings.row_id, settings.target]
    usable, missing = feature_intersection(
        select_features(labelled, settings.exclude + ids), canonical
    )
    features = usable.columns
    # the numeric rows are far smaller than what they were computed from
    numbers = cut_lineage(labelled.select(*ids, *features))
    pool_numbers = cut_lineage(pool.select(settings.row_id, *features))
    clipped = clip_outliers(numbers, features, settings.clip_deviations).table
    clipped_pool = clip_outliers(pool_numbers, features, settings.clip_deviations).table
    rows = finite_rows(clipped, features)
    pool_rows = finite_rows(clipped_pool, features)
    fit_on = rows
    if settings.fit_on == "train":
        # the share of test rows is set apart before any number is fitted
        split = stratified_split(
            rows, settings.target, settings.row_id, settings.test_share, settings.seed)
        fit_on = split.filter("split = 'train'").drop("split")
    elif settings.fit_on != "all":
        raise ValueError(f"fit_on is 'all' or 'train', not {settings.fit_on!r}")
    fit_on = cut_lineage(fit_on)
    return Prepared(
        cut_lineage(standard_scale(rows, features, fit_on=fit_on)),
        cut_lineage(
            null_target(standard_scale(pool_rows, features, fit_on=fit_on), settings.target)
        ),
        features,
        missing,
    )


def prepare_labelled(
    rows: DataFrame, row_id: str, text: str, clean: Column, assays: list[str],
    features: list[Column], k: float = 3.0, seed: int = 42,
) -> DataFrame:
    """Clean text, one label from the assays, features, balance, drop gaps, clip.

    Texts are read once: balancing and all after it work on the labelled rows' numbers, written once.
    """
    kept = rows.withColumn(text, clean).filter(F.col(text).isNotNull())
    labelled = any_positive_label(kept, assays)
    numbers = cut_lineage(labelled.select(row_id, "label", *features))
    names = [c for c in numbers.columns if c not in (row_id, "label")]
    balanced = cut_lineage(downsample_majority(numbers, "label", row_id, seed))
    described = balanced.select(row_id, *names)
    whole = drop_nulls(attach(balanced.select(row_id, "label"), described, row_id), names)
    whole = cut_lineage(whole)
    return clip_outliers(whole, names, k).table


def graph_learn(
    nodes: DataFrame, method: str, graph: str, n_features: int, alpha: float = 0.2, k: int = 7,
    max_iter: int = 1000, tolerance: float | None = 1e-3, landmarks: int = LANDMARKS, **kw,
) -> DataFrame:
    """Label propagation or spreading over a graph.

    ``method`` is 'propagation' or 'spreading'; ``graph`` is 'knn' for unit weights or 'rbf_knn' for
    kernel weights to the k nearest neighbours, or 'rbf' for the kernel of all pairs through
    ``landmarks`` rows; γ is 1 / ``n_features``. ``nodes`` has id, v and a nullable label.
    """
    if method not in ("propagation", "spreading") or graph not in ("knn", "rbf_knn", "rbf"):
        raise ValueError(f"unknown method or graph: {method}, {graph}")
    if graph == "rbf":
        return kernel_learn(nodes, method, 1.0 / n_features, landmarks, alpha, max_iter, tolerance)[0]
    if graph == "knn":
        edges = knn_edges(nodes, "id", "v", k, include_self=True, **kw).withColumn("w", F.lit(1.0))
    else:
        edges = rbf_edges(nodes, "id", "v", 1.0 / n_features, k, include_self=True, **kw)
    if method == "propagation":
        return label_propagation(nodes, edges, max_iter, tolerance)
    return label_spreading(nodes, edges, alpha, max_iter, tolerance)
