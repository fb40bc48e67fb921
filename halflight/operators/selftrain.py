"""Self-training and co-training: loops that turn pool rows into training rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halflight.functions.scoring import confidence, decide, uncertainty
from halflight.operators.evaluate import evaluate_scores
from halflight.operators.kernel import LANDMARKS, kernel_learn, kernel_predict
from halflight.operators.forest import forest_scores, grow_forests
from halflight.operators.keys import BROADCAST_ROWS, broadcast_if_small
from halflight.operators.leaves import candidate_f1, forest_leaves
from halflight.operators.models import apply_inputs, fit_inputs, grown_forest, predict, random_forest
from halflight.operators.ordering import with_global_rank
from halflight.operators.search import search, trials_table
from halflight.session import cut_lineage

# Fixed values of the experiments.
SELF_TRAINING_ROUNDS = 10
CO_TRAINING_ROUNDS = 20
CO_TRAINING_PER_ROUND = 50
CO_TRAINING_CONFIDENCE = 0.80
GRAPH_ROUNDS = 100
KEEP_F1_SHARE = 0.95
METHODS = ("Self-Training", "Co-Training", "Label Propagation", "Label Spreading")


def confidence_rank(
    scored: DataFrame, row_id: str, n: int, threshold: float | None = None
) -> DataFrame:
    """The n most confident rows (strictly above the threshold), best first, ties by id.

    ``orderBy.limit`` keeps n rows per partition before anything is gathered.
    """
    rows = scored if threshold is None else scored.filter(F.col("confidence") > threshold)
    top = rows.orderBy(F.desc("confidence"), row_id).limit(n)
    # the window only sees the n chosen rows
    return top.withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("confidence"), row_id))
    )


def uncertainty_order(scored: DataFrame, row_id: str) -> DataFrame:
    """Every pool row with its position from most to least uncertain."""
    marked = scored.withColumn("uncertainty", uncertainty(F.col("p1")))
    return with_global_rank(marked, [F.col("uncertainty"), F.col(row_id)], "position")


def unique_candidates(picks: DataFrame, row_id: str, teacher: str = "teacher") -> DataFrame:
    """One row per pool row; the lower-numbered teacher's label wins."""
    first = W.partitionBy(row_id).orderBy(teacher)
    return picks.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def co_training_round(
    scored: DataFrame, row_id: str, p_cols: tuple[str, str] = ("p_first", "p_second"),
    threshold: float = CO_TRAINING_CONFIDENCE, per_round: int = CO_TRAINING_PER_ROUND,
) -> DataFrame:
    """Rows both teachers hand over in one round: row id, label, teacher.

    The scores are read once for all teachers, and each partition keeps ``per_round`` rows a teacher
    before anything is gathered.
    """
    said = F.explode(F.array(*[F.struct(F.lit(n).alias("teacher"), F.col(p).alias("p"))
                               for n, p in enumerate(p_cols, start=1)])).alias("t")
    rows = scored.select(row_id, said).select(
        row_id, decide(F.col("t.p")).alias("label"), F.col("t.teacher").alias("teacher"),
        confidence(F.col("t.p")).alias("confidence")).filter(F.col("confidence") > threshold)
    best = W.partitionBy("teacher").orderBy(F.desc("confidence"), row_id)
    picks = rows.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= per_round)
    return unique_candidates(picks.select(row_id, "label", "teacher"), row_id)


def view_ensemble(first: DataFrame, second: DataFrame, row_id: str) -> DataFrame:
    """Mean of two models' probabilities with its decision."""
    both = first.select(row_id, F.col("p1").alias("p_first")).join(
        second.select(row_id, F.col("p1").alias("p_second")), row_id
    )
    p = (F.col("p_first") + F.col("p_second")) / 2
    return both.withColumn("p1", p).withColumn("prediction", decide(F.col("p1"))).withColumn(
        "confidence", confidence(F.col("p1"))
    )


# --- choosing pool rows --------------------------------------------------------------------


def select_beneficial(
    scored: DataFrame, row_id: str, target_size: int, threshold: float, keeps_quality=None,
) -> DataFrame:
    """Choose ``target_size`` pool rows (all when the pool is smaller).

    With no more confident rows than the target, testing cannot change the outcome: the
    result is the most confident ``target_size`` rows. Otherwise ``keeps_quality(rows)`` gives the
    ``row_id`` of those candidates that, each added alone, keep validation F1; the first of these among
    the 2·target most confident are taken, then the most confident of the rest. A test that answers yes
    or no is asked about each candidate alone.
    """
    confident = scored.filter(F.col("confidence") > threshold).count()
    if confident <= target_size or keeps_quality is None:
        return confidence_rank(scored, row_id, target_size)
    candidates = cut_lineage(
        confidence_rank(scored, row_id, min(confident, 2 * target_size), threshold)
    )
    passed = keeps_quality(candidates)
    if not isinstance(passed, DataFrame):
        ids = [r[row_id] for r in candidates.select(row_id).collect()]  # 2·target at most
        good = [i for i in ids if keeps_quality(candidates.filter(F.col(row_id) == F.lit(i)))]
        passed = candidates.filter(F.col(row_id).isin(good))
    passed = passed.select(row_id, F.lit(True).alias("_good"))
    marked = candidates.join(broadcast_if_small(cut_lineage(passed)), row_id, "left").fillna(False, ["_good"])
    return marked.orderBy(F.desc("_good"), "rank").limit(target_size).drop("_good")


def leaf_quality_test(
    train_leaves: DataFrame, validate_leaves: DataFrame, leaves_of, target: str, row_id: str,
    keep_share: float = KEEP_F1_SHARE,
):
    """A ``keeps_quality`` test: F1 with each candidate and its predicted label in its leaves stays at
    ``keep_share`` of what it is. ``leaves_of(candidates)`` gives their trees and leaves."""

    def keeps(candidates: DataFrame) -> DataFrame:
        labels = candidates.select(row_id, F.col("prediction").cast("int").alias(target))
        beside = leaves_of(candidates).select(row_id, "tree", "leaf").join(labels, row_id)
        found = candidate_f1(train_leaves, validate_leaves, beside, row_id, target)
        return found.filter(F.col("f1") >= keep_share * F.col("base_f1")).select(row_id)

    return keeps


def forest_quality_test(
    model, train: DataFrame, validate: DataFrame, pool: DataFrame, target: str, row_id: str,
):
    """``leaf_quality_test`` over the trees of a fitted forest. Leaf tables are written once."""
    keep = [row_id, target]
    return leaf_quality_test(
        cut_lineage(forest_leaves(model, train, keep)), cut_lineage(forest_leaves(model, validate, keep)),
        lambda rows: forest_leaves(model, pool.join(rows.select(row_id), row_id, "left_semi"), [row_id]),
        target, row_id)


# --- loops ---------------------------------------------------------------------------------


def _grown(train: DataFrame, extra: DataFrame) -> DataFrame:
    """Training rows with a round's new ones, both written before; in as many parts as there are cores at
    most, else each round would add the parts of the pool."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.unionByName(extra).coalesce(cores)


def self_training(
    labelled: DataFrame, pool: DataFrame, features: list[str], target: str, row_id: str,
    threshold: float = 0.75, max_iter: int = SELF_TRAINING_ROUNDS, trees: int = 100,
    max_depth: int = 10, seed: int = 42, first=None,
):
    """(model, pseudo-label table): fit, label confident pool rows, repeat.

    A round scores the rows that have no label yet and writes them once: those that get one, which teach
    from then on, and the rest for the next round. ``first`` may give the forest of the labelled rows, if
    it is fitted already.
    """
    names = [row_id, *features, target]
    train = cut_lineage(labelled.select(row_id, *features, F.col(target).cast("int").alias(target)))
    rest = pool.select(row_id, *features)
    pseudo = rest.limit(0).select(row_id, F.lit(0).alias(target), F.lit(0).alias("round"), F.lit(0.0).alias("confidence"))
    model = first or grown_forest(train, features, target, trees, max_depth, seed=seed)
    for i in range(1, max_iter + 1):
        scored = cut_lineage(predict(model, rest, names[:-1]))
        found = scored.filter(F.col("confidence") > threshold).withColumn(target, F.col("prediction"))
        if found.isEmpty():
            break
        pseudo = pseudo.unionByName(found.select(row_id, target, F.lit(i).alias("round"), "confidence"))
        train = _grown(train, found.select(names))
        rest = scored.filter(F.col("confidence") <= threshold).select(row_id, *features)
        model = grown_forest(train, features, target, trees, max_depth, seed=seed)
    return model, pseudo


def co_training(
    labelled: DataFrame, pool: DataFrame, first_view: list[str], second_view: list[str],
    target: str, row_id: str, threshold: float = CO_TRAINING_CONFIDENCE,
    per_round: int = CO_TRAINING_PER_ROUND, max_iter: int = CO_TRAINING_ROUNDS,
    trees: int = 100, max_depth: int = 10, seed: int = 42, first=None,
):
    """((model, model), pseudo-label table): two view models label rows for each other.

    The pool is written once; a round scores it in one pass by both models, without the rows taken
    before, and writes the 2 · ``per_round`` rows at most that it takes, which are broadcast. Both models
    grow in one pass over the training rows. ``first`` may give those of the labelled rows, if they are
    fitted already.
    """
    features = list(dict.fromkeys(first_view + second_view))
    names = [row_id, *features, target]
    train = cut_lineage(labelled.select(row_id, *features, F.col(target).cast("int").alias(target)))
    whole = cut_lineage(pool.select(row_id, *features))
    pseudo = whole.limit(0).select(row_id, *[F.lit(0).alias(c) for c in (target, "teacher", "round")])
    # 2 · per_round rows a round at most
    small = F.broadcast if 2 * per_round * max_iter <= BROADCAST_ROWS else broadcast_if_small
    rest = whole

    def fit(rows):
        return tuple(grow_forests(rows, [first_view, second_view], target, trees, max_depth, seed=seed))

    models = first or fit(train)
    for i in range(1, max_iter + 1):
        scored = forest_scores(rest, dict(zip(("p_first", "p_second"), models, strict=True)))
        picks = co_training_round(scored, row_id, ("p_first", "p_second"), threshold, per_round)
        said = picks.select(row_id, F.col("label").alias(target), "teacher", F.lit(i).alias("round"))
        found = cut_lineage(whole.join(F.broadcast(said), row_id).repartition(1))
        if found.isEmpty():
            break
        pseudo = pseudo.unionByName(found.select(row_id, target, "teacher", "round"))
        train = _grown(train, found.select(names))
        rest = whole.join(small(pseudo.select(row_id)), row_id, "left_anti")
        models = fit(train)
    return models, pseudo


def pair_scores(models: tuple, test: DataFrame, target: str, row_id: str) -> DataFrame:
    """Row id, target, the two view models' mean probability and its decision."""
    both = forest_scores(test, dict(zip(("p_first", "p_second"), models, strict=True)))
    p = (F.col("p_first") + F.col("p_second")) / 2
    return both.select(row_id, target, p.alias("p1")).withColumn("prediction", decide(F.col("p1")))


def co_training_metrics(
    models: tuple, test: DataFrame, target: str, row_id: str
) -> DataFrame:
    """Metrics of the two view models' mean probability on test rows; one row."""
    return evaluate_scores(pair_scores(models, test, target, row_id), target, "prediction", "p1")


def self_training_run(
    train: DataFrame, validate: DataFrame, test: DataFrame, pool: DataFrame | None,
    features: list[str], target: str, row_id: str, threshold: float = 0.8,
    target_size: int = 2500, trees: int = 100, max_iter: int = SELF_TRAINING_ROUNDS, seed: int = 42,
) -> DataFrame:
    """Baseline, choice of pool rows, self-training, metrics on validation and test rows.

    Each candidate of the choice is tested alone, in the leaves of the baseline's trees. Without a pool
    the baseline is the model. One row per part and evaluated split.
    """
    keep = [row_id, target]
    baseline = random_forest(train, features, target, trees=trees, seed=seed)
    parts = [
        predict(baseline, validate, keep).withColumns(
            {"stage": F.lit("baseline"), "split": F.lit("val")}),
        predict(baseline, test, keep).withColumns(
            {"stage": F.lit("baseline"), "split": F.lit("test")}),
    ]
    if pool is not None and not pool.isEmpty():
        scored = cut_lineage(predict(baseline, pool, [row_id]))
        keeps = forest_quality_test(baseline, train, validate, pool, target, row_id)
        chosen = select_beneficial(scored, row_id, target_size, threshold, keeps)
        chosen_pool = pool.join(chosen.select(row_id), row_id, "left_semi")
        model, _ = self_training(train, chosen_pool, features, target, row_id, threshold,
                                 max_iter, trees, seed=seed)
        for name, rows in (("val", validate), ("test", test)):
            parts.append(
                predict(model, rows, keep).withColumns(
                    {"stage": F.lit("self-training"), "split": F.lit(name)})
            )
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return evaluate_scores(scored, target, "prediction", "p1", ["stage", "split"])


def unlabelled_size_sweep(
    labelled: DataFrame, test: DataFrame, ordered_pool: DataFrame, features: list[str],
    target: str, row_id: str, sizes: list[int], views: tuple[list[str], list[str]],
    position: str = "position", methods: tuple[str, ...] = METHODS, threshold: float = 0.75,
    trees: int = 100, max_iter: int = SELF_TRAINING_ROUNDS, co_rounds: int = CO_TRAINING_ROUNDS,
    graph_rounds: int = GRAPH_ROUNDS, landmarks: int = LANDMARKS, parallel: int = 4, seed: int = 42,
) -> DataFrame:
    """Learning curves of the methods over pool prefixes of growing size; one row per method and size.

    Sizes are clipped to the pool, and each is run once. Without pool rows the forest of the labelled
    rows stands for all methods but co-training, which has its two view models. The graph methods
    take the whole kernel, γ = 1 / features, through ``landmarks`` rows;
    ``n_pseudo_labeled`` is how many pool rows got a label or were reached by one.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    known, pool_rows = labelled.count(), ordered_pool.count()
    gamma = 1.0 / len(features)
    inputs, _ = fit_inputs(labelled, features, target)
    keep = [row_id, target]
    baseline = grown_forest(labelled, features, target, trees, seed=seed)
    view_models = tuple(grow_forests(labelled, list(views), target, trees, seed=seed)) if "Co-Training" in methods else None

    def as_nodes(df: DataFrame, label) -> DataFrame:
        vector = F.array(*[F.col(c).cast("double") for c in features]).alias("v")
        return apply_inputs(df, inputs, features).select(
            F.col(row_id).alias("id"), vector, label.cast("int").alias("label"))

    def graph_scores(method: str, part: DataFrame):
        nodes = as_nodes(labelled, F.col(target)).unionByName(as_nodes(part, F.lit(None)))
        kind = "propagation" if method == "Label Propagation" else "spreading"
        reached, model = kernel_learn(nodes, kind, gamma, landmarks, max_iter=graph_rounds)
        seen = as_nodes(test, F.lit(None)).select(F.col("id").alias(row_id), kernel_predict(F.col("v"), model).alias("p1"))
        rows = test.select(keep).join(seen, row_id)
        return (rows.withColumn("prediction", decide(F.col("p1"))),
                reached.filter("not known and f0 + f1 > 0").count())

    def run(item):
        method, size = item
        part = ordered_pool.filter(F.col(position) <= size)
        if method == "Co-Training":
            pair, pseudo = co_training(labelled, part, *views, target, row_id, trees=trees, seed=seed,
                                       max_iter=co_rounds if size else 0, first=view_models)
            rows, added = pair_scores(pair, test, target, row_id), pseudo.count()
        elif size == 0:
            rows, added = predict(baseline, test, keep), 0
        elif method == "Self-Training":
            model, pseudo = self_training(labelled, part, features, target, row_id, threshold,
                                          max_iter, trees, seed=seed, first=baseline)
            rows, added = predict(model, test, keep), pseudo.count()
        else:
            rows, added = graph_scores(method, part)
        return cut_lineage(rows.select(*keep, "p1", "prediction").withColumns(
            {"method": F.lit(method), "n_unlabeled": F.lit(size), "n_pseudo_labeled": F.lit(added),
             "final_train_size": F.lit(known + added)}))

    items = [(m, n) for n in sorted({min(n, pool_rows) for n in sizes}) for m in methods]
    with ThreadPoolExecutor(parallel) as threads:  # small fits: a few share the cluster
        parts = list(threads.map(run, items))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return evaluate_scores(scored, target, "prediction", "p1",
                           ["method", "n_unlabeled", "n_pseudo_labeled", "final_train_size"])


#: Effort of the rungs of a semi-supervised trial, in shares of its pool rows and rounds.
SEMI_RUNGS = (1 / 3, 1.0)


def semi_supervised_search(
    labelled: DataFrame, validate: DataFrame, ordered_pool: DataFrame, features: list[str], target: str,
    row_id: str, space: dict, n_trials: int = 50, position: str = "position", forest: dict | None = None,
    landmarks: int = LANDMARKS, parallel: int = 4, rungs: tuple[float, ...] = SEMI_RUNGS, seed: int = 42,
) -> DataFrame:
    """One row per trial: settings as JSON, validation F1 and ROC-AUC, pool rows that got a label, F1 over
    the forest of the labelled rows alone in percent; the best of full effort marked.

    The settings are ``ssl_method`` ('label_propagation' or 'self_training'), ``n_unlabeled`` pool rows
    from the head of the given order, ``lp_gamma`` and ``lp_max_iter`` of the whole kernel, ``st_threshold``
    and ``st_max_iter`` of the loop. Sizes beyond the pool mean all of it. ``forest`` has the trees and
    depth of the forests. Trials are proposed from those before them; a rung gives a trial that share of
    its pool rows and rounds.
    """
    forest = forest or {}
    keep = [row_id, target]
    inputs, _ = fit_inputs(labelled, features, target)
    vector = F.array(*[F.col(c).cast("double") for c in features])

    def as_nodes(df: DataFrame, label) -> DataFrame:
        return apply_inputs(df, inputs, features).select(
            F.col(row_id).alias("id"), vector.alias("v"), label.cast("int").alias("label"))

    known = cut_lineage(as_nodes(labelled, F.col(target)))
    judged = cut_lineage(apply_inputs(validate, inputs, features).select(*keep, vector.alias("v")))
    baseline = grown_forest(labelled, features, target, seed=seed, **forest)
    metrics = lambda rows: evaluate_scores(rows, target, "prediction", "p1").first()
    base_f1 = metrics(predict(baseline, validate, keep))["f1"]

    def evaluate(s: dict, effort: float):
        part = ordered_pool.filter(F.col(position) <= max(1, round(s["n_unlabeled"] * effort)))
        rounds = lambda name: max(1, round(s[name] * effort))
        if s["ssl_method"] == "label_propagation":
            nodes = known.unionByName(as_nodes(part, F.lit(None)))
            reached, model = kernel_learn(nodes, "propagation", s["lp_gamma"], landmarks, max_iter=rounds("lp_max_iter"))
            rows = judged.select(*keep, kernel_predict(F.col("v"), model).alias("p1")).withColumn(
                "prediction", decide(F.col("p1")))
            added = reached.filter("not known and f0 + f1 > 0").count()
        else:
            model, pseudo = self_training(labelled, part, features, target, row_id, s["st_threshold"],
                                          rounds("st_max_iter"), seed=seed, first=baseline, **forest)
            rows, added = predict(model, validate, keep), pseudo.count()
        got = metrics(rows)
        gain = (got["f1"] - base_f1) / base_f1 * 100 if base_f1 else None
        return got["f1"], {"f1": got["f1"], "roc_auc": got["roc_auc"], "n_pseudo_labeled": added, "gain_pct": gain}

    trials = search(space, evaluate, n_trials, parallel, rungs, seed=seed)
    return trials_table(labelled.sparkSession, trials, "f1 double, roc_auc double, n_pseudo_labeled long, "
                                                       "gain_pct double").drop("score")
