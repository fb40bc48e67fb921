"""Graphs, self- and co-training, models, searches and the domain of a model."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from halflight.functions.text import VIEW_SIZE, VIEW_STYLE
from halflight.operators import domain, evaluate, graph, kernel, leaves, models, sample, selftrain
from halflight.plans import training
from halflight.session import cut_lineage, gathered, scratch_path
from halflight.sources import models as bundles
from halflight.suite.base import (
    DESC,
    LABELLED,
    NODES,
    descriptors,
    doc_labels,
    graph_nodes,
    knn_sql,
    labelled_docs,
    pool_docs,
    q6,
    query,
    r6,
    squash,
    squash_sql,
    table,
)
from halflight.suite.cleaning import rounded
from halflight.suite.sampling import hash_rank

TREES = 100


# --- graphs --------------------------------------------------------------------------------


@query("knn_edges", f"""
WITH {NODES}, {knn_sql(7, False)} SELECT src, dst, {q6("dist")} FROM edges""")
def knn_edges(spark, sf):
    return rounded(graph.knn_edges(graph_nodes(spark, sf), "id", "v", 7), ["dist"])


@query("rbf_edges", f"""
WITH {NODES}, {knn_sql(7, False)}
SELECT src, dst, {q6("exp(-(1.0 / 64) * dist * dist)", "w")} FROM edges""")
def rbf_edges(spark, sf):
    return rounded(
        graph.rbf_edges(graph_nodes(spark, sf), "id", "v", 1.0 / 64).drop("dist"), ["w"])


SPLIT_NODES = f"""{NODES},
test_nodes AS (SELECT * FROM nodes WHERE label IS NULL),
train_nodes AS (SELECT * FROM nodes WHERE label IS NOT NULL)"""


@query("knn_classify", f"""
WITH {SPLIT_NODES}, {knn_sql(5, True, "test_nodes", "train_nodes")}
SELECT src AS id, {q6("avg(t.label)", "p1")} FROM edges JOIN train_nodes t ON dst = t.id
GROUP BY src""")
def knn_classify(spark, sf):
    nodes = graph_nodes(spark, sf)
    test, train = nodes.filter("label is null"), nodes.filter("label is not null")
    return rounded(graph.knn_classify(test, train, "id", "v", "label", 5), ["p1"])


START = """
start AS (SELECT id, label IS NOT NULL AS known, CASE label WHEN 0 THEN 1.0 ELSE 0.0 END AS y0,
  CASE label WHEN 1 THEN 1.0 ELSE 0.0 END AS y1 FROM nodes),
f_0 AS MATERIALIZED (SELECT id, CAST(y0 AS DOUBLE) AS f0, CAST(y1 AS DOUBLE) AS f1 FROM start)"""


def rounds_sql(n: int, mix: str, weights: str = "wts", tolerance: float = 1e-3) -> str:
    """At most n rounds over (src, dst, w), ended by the first that moves less than ``tolerance``;
    ``mix`` turns sums s0, s1 into the new f0, f1."""
    steps, moves = [], []
    for i in range(1, n + 1):
        steps.append(f"""
s_{i} AS (SELECT src AS id, sum(w * f0) AS s0, sum(w * f1) AS s1 FROM {weights}
  JOIN f_{i - 1} f ON dst = f.id GROUP BY src),
f_{i} AS MATERIALIZED (SELECT start.id, {mix} FROM start LEFT JOIN s_{i} USING (id))""")
        moves.append(f"""SELECT {i} AS r, sum(abs(a.f0 - b.f0) + abs(a.f1 - b.f1)) AS moved
  FROM f_{i} a JOIN f_{i - 1} b USING (id)""")
    every = " UNION ALL ".join(f"SELECT {i} AS r, * FROM f_{i}" for i in range(1, n + 1))
    return ",".join(steps) + f""",
moves AS ({" UNION ALL ".join(moves)}),
ended AS (SELECT coalesce(min(r) FILTER (moved < {tolerance}), max(r)) AS r FROM moves),
final AS (SELECT id, f0 / CASE f0 + f1 WHEN 0 THEN 1 ELSE f0 + f1 END AS f0,
  f1 / CASE f0 + f1 WHEN 0 THEN 1 ELSE f0 + f1 END AS f1
  FROM ({every}) WHERE r = (SELECT r FROM ended))"""


CLAMP = """CASE WHEN known THEN y0 ELSE coalesce(s0 / nullif(s0 + s1, 0), 0) END AS f0,
  CASE WHEN known THEN y1 ELSE coalesce(s1 / nullif(s0 + s1, 0), 0) END AS f1"""
MIX = """coalesce(s0, 0) * 0.2::DOUBLE + y0 * 0.8::DOUBLE AS f0,
  coalesce(s1, 0) * 0.2::DOUBLE + y1 * 0.8::DOUBLE AS f1"""
KERNEL = "wts AS (SELECT src, dst, exp(-(1.0 / 64) * dist * dist) AS w FROM edges)"
NORMAL = """
deg AS (SELECT dst AS id, sum(w) AS d FROM wts WHERE src <> dst GROUP BY dst),
norm AS (SELECT src, dst, w / sqrt(coalesce(a.d, 1)) / sqrt(coalesce(b.d, 1)) AS w
  FROM wts LEFT JOIN deg a ON src = a.id LEFT JOIN deg b ON dst = b.id WHERE src <> dst)"""
ONES = "wts AS (SELECT src, dst, 1.0 AS w FROM edges)"
FINAL = f"SELECT id, {q6('f0')}, {q6('f1')} FROM final"
#: Rounds of the registered queries at most; they settle before on the given tables.
ROUNDS = 100


def learnt(spark, sf, method: str, kind: str):
    out = training.graph_learn(graph_nodes(spark, sf), method, kind, 64, max_iter=ROUNDS)
    return rounded(out.drop("known"), ["f0", "f1"])


@query("label_propagation",
       f"WITH {NODES}, {knn_sql(7, True)}, {ONES}, {START}, {rounds_sql(ROUNDS, CLAMP)} {FINAL}")
def label_propagation(spark, sf):
    return learnt(spark, sf, "propagation", "knn")


@query("label_propagation_rbf",
       f"WITH {NODES}, {knn_sql(7, True)}, {KERNEL}, {START}, {rounds_sql(ROUNDS, CLAMP)} {FINAL}")
def label_propagation_rbf(spark, sf):
    return learnt(spark, sf, "propagation", "rbf_knn")


@query("label_spreading",
       f"WITH {NODES}, {knn_sql(7, True)}, {ONES}, {NORMAL}, {START},"
       f" {rounds_sql(ROUNDS, MIX, 'norm')} {FINAL}")
def label_spreading(spark, sf):
    return learnt(spark, sf, "spreading", "knn")


@query("label_spreading_rbf",
       f"WITH {NODES}, {knn_sql(7, True)}, {KERNEL}, {NORMAL}, {START},"
       f" {rounds_sql(ROUNDS, MIX, 'norm')} {FINAL}")
def label_spreading_rbf(spark, sf):
    return learnt(spark, sf, "spreading", "rbf_knn")


#: γ of the whole kernel, and landmarks; with as many rows or fewer the kernel is that of all pairs.
FULL_GAMMA, FULL_LANDMARKS = 0.25, 1024
FULL = f"wts AS (SELECT src, dst, exp(-{FULL_GAMMA} * dist * dist) AS w FROM pairs)"


def whole_kernel(spark, sf, method: str):
    out, _ = kernel.kernel_learn(graph_nodes(spark, sf), method, FULL_GAMMA, FULL_LANDMARKS, max_iter=ROUNDS)
    return rounded(out.drop("known"), ["f0", "f1"])


@query("label_propagation_kernel",
       f"WITH {NODES}, {knn_sql(7, True)}, {FULL}, {START}, {rounds_sql(ROUNDS, CLAMP)} {FINAL}")
def label_propagation_kernel(spark, sf):
    """Over the kernel of all pairs, as rows and landmarks."""
    return whole_kernel(spark, sf, "propagation")


@query("label_spreading_kernel",
       f"WITH {NODES}, {knn_sql(7, True)}, {FULL}, {NORMAL}, {START},"
       f" {rounds_sql(ROUNDS, MIX, 'norm')} {FINAL}")
def label_spreading_kernel(spark, sf):
    return whole_kernel(spark, sf, "spreading")


@query("graph_learn",
       f"WITH {NODES}, {knn_sql(7, True)}, {KERNEL}, {START}, {rounds_sql(ROUNDS, CLAMP)} "
       f"SELECT count(*) AS n, {q6('avg(CASE WHEN (f1 >= 0.5) = (truth = 1) THEN 1.0 ELSE 0.0 END)', 'accuracy')} "
       "FROM final JOIN nodes USING (id) WHERE label IS NULL")
def graph_learn(spark, sf):
    """How often the hidden classes come out right after propagation with kernel weights."""
    nodes = graph_nodes(spark, sf)
    out = training.graph_learn(nodes, "propagation", "rbf_knn", 64, max_iter=ROUNDS)
    scored = out.join(nodes.select("id", "truth", "label"), "id").filter("label is null")
    hit = F.avg((F.when(F.round("f1", 9) >= 0.5, 1).otherwise(0) == F.col("truth")).cast("double"))
    return rounded(scored.agg(F.count(F.lit(1)).alias("n"), hit.alias("accuracy")), ["accuracy"])


PARTS = f"""{NODES.replace("nodes AS", "all_nodes AS", 1)},
nodes AS (SELECT * FROM all_nodes WHERE id % 4 <> 0),
test_nodes AS (SELECT * FROM all_nodes WHERE id % 4 = 0)"""


@query("inductive_graph_predict", f"""
WITH {PARTS}, {knn_sql(7, True)}, {KERNEL}, {START}, {rounds_sql(ROUNDS, CLAMP)},
new_pairs AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist
  FROM test_nodes a CROSS JOIN nodes b),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn
  FROM new_pairs) WHERE rn <= 7),
votes AS (SELECT src AS id, sum(exp(-(1.0 / 64) * dist * dist) * f0) AS s0,
  sum(exp(-(1.0 / 64) * dist * dist) * f1) AS s1 FROM near JOIN final ON dst = final.id GROUP BY src)
SELECT id, {q6("coalesce(s1 / nullif(s0 + s1, 0), 0.5)", "p1")} FROM votes""")
def inductive_graph_predict(spark, sf):
    """A quarter of the nodes, unseen by the propagation, scored from its distributions."""
    nodes = graph_nodes(spark, sf)
    seen, unseen = nodes.filter("id % 4 <> 0"), nodes.filter("id % 4 = 0")
    reached = training.graph_learn(seen, "propagation", "rbf_knn", 64, max_iter=ROUNDS)
    return rounded(graph.inductive_graph_predict(
        unseen.select("id", "v"), seen.select("id", "v"), reached, gamma=1.0 / 64), ["p1"])


# --- choosing rows -------------------------------------------------------------------------

EVENTS = f"""
ev AS (SELECT event_id,
    {squash_sql("(value - 120) / 60")} AS p_first,
    CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS p_second FROM events),
sc AS (SELECT event_id, p_first AS p1, CASE WHEN p_first >= 0.5 THEN p_first ELSE 1 - p_first END
  AS confidence, CASE WHEN p_first >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ev)"""


def two_scores(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        squash((F.col("value") - 120) / 60).alias("p_first"),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("p_second"))


def scored_pool(spark, sf):
    p = F.col("p_first")
    return two_scores(spark, sf).select(
        "event_id", p.alias("p1"), F.when(p >= 0.5, p).otherwise(1 - p).alias("confidence"),
        F.when(p >= 0.5, 1).otherwise(0).alias("prediction"))


def ranked_sql(where: str, n: int) -> str:
    return f"""SELECT event_id, {q6("confidence")}, rn AS "rank" FROM (
  SELECT *, row_number() OVER (ORDER BY confidence DESC, event_id) AS rn FROM sc {where})
WHERE rn <= {n}"""


@query("confidence_rank", f"WITH {EVENTS} {ranked_sql('WHERE confidence > 0.75', 500)}")
def confidence_rank(spark, sf):
    out = selftrain.confidence_rank(scored_pool(spark, sf), "event_id", 500, 0.75)
    return out.select("event_id", r6("confidence"), "rank")


@query("uncertainty_order", f"""
WITH {EVENTS} SELECT event_id, {q6("abs(p1 - 0.5)", "uncertainty")},
  row_number() OVER (ORDER BY abs(p1 - 0.5), event_id) AS position FROM sc""")
def uncertainty_order(spark, sf):
    out = selftrain.uncertainty_order(scored_pool(spark, sf), "event_id")
    return out.select("event_id", r6("uncertainty"), "position")


def picks_sql(n: int) -> str:
    def one(p, no):
        conf = f"CASE WHEN {p} >= 0.5 THEN {p} ELSE 1 - {p} END"
        return f"""SELECT event_id, CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END AS label, {no} AS teacher
  FROM (SELECT *, row_number() OVER (ORDER BY {conf} DESC, event_id) AS rn FROM ev
        WHERE {conf} > 0.8) WHERE rn <= {n}"""
    return f"""picks AS ({one("p_first", 1)} UNION ALL {one("p_second", 2)}),
chosen AS (SELECT event_id, arg_min(label, teacher) AS label, min(teacher) AS teacher
  FROM picks GROUP BY event_id)"""


@query("co_training_round", f"WITH {EVENTS}, {picks_sql(50)} SELECT * FROM chosen")
def co_training_round(spark, sf):
    return selftrain.co_training_round(two_scores(spark, sf), "event_id")


@query("unique_candidates", f"WITH {EVENTS}, {picks_sql(10**9)} SELECT * FROM chosen")
def unique_candidates(spark, sf):
    both = two_scores(spark, sf)
    picks = None
    for number, p in enumerate(("p_first", "p_second"), start=1):
        c = F.col(p)
        part = both.filter(F.greatest(c, 1 - c) > 0.8).select(
            "event_id", F.when(c >= 0.5, 1).otherwise(0).alias("label"),
            F.lit(number).alias("teacher"))
        picks = part if picks is None else picks.unionByName(part)
    return selftrain.unique_candidates(picks, "event_id")


# Leaf tables of a few trees over the events: a leaf is a cell of value and number.
LEAF_TREES = [(6, 5), (9, 4), (5, 7), (12, 3), (8, 6)]
#: A tested choice: rows wanted, confidence asked for, and the share of F1 that a candidate must keep.
CHOICE = (400, 0.8, 1.0)
LEAF_ROWS = f"""
placed AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CAST(user_id % 5 AS INT) AS part FROM events),
rows_of AS (SELECT event_id, part, CASE WHEN value + k > 200 THEN 1 ELSE 0 END AS label, {" UNION ALL ".join(
    ("SELECT event_id, part, CASE WHEN value + k > 200 THEN 1 ELSE 0 END AS label, " if n else "")
    + f"{n} AS tree, CAST(floor(value / {a}) * 100 + floor(k / {b}) AS INT) AS leaf FROM placed"
    for n, (a, b) in enumerate(LEAF_TREES))})"""


def leaf_rows(spark, sf):
    """event_id, part, label, tree, leaf; parts 0 teach, parts 1 judge, the others are the pool."""
    k = F.get_json_object("props", "$.k").cast("int")
    cells = [F.struct(F.lit(n).alias("tree"), (F.floor(F.col("value") / a) * 100 + F.floor(k / b)).cast("int").alias(
        "leaf")) for n, (a, b) in enumerate(LEAF_TREES)]
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("part"),
        F.when(F.col("value") + k > 200, 1).otherwise(0).alias("label"), F.explode(F.array(*cells)).alias("c")
    ).select("event_id", "part", "label", "c.tree", "c.leaf")


#: Every candidate against every judged row, tree by tree.
LEAF_F1 = f"""
w AS (SELECT label, (SELECT count(*) FROM rows_of WHERE part = 0 AND tree = 0) / (2.0 * count(*)) AS w
  FROM rows_of WHERE part = 0 AND tree = 0 GROUP BY label),
counts AS (SELECT tree, leaf, coalesce(sum(w) FILTER (label = 0), 0) AS n0,
  coalesce(sum(w) FILTER (label = 1), 0) AS n1 FROM rows_of JOIN w USING (label) WHERE part = 0 GROUP BY tree, leaf),
judged AS (SELECT r.event_id, r.label, r.tree, r.leaf, n0, n1 FROM rows_of r LEFT JOIN counts USING (tree, leaf)
  WHERE part = 1),
before AS (SELECT event_id, label, round(sum(coalesce(n1 / (n0 + n1), 0)) / {len(LEAF_TREES)}, 12) AS p
  FROM judged GROUP BY event_id, label),
alone AS (SELECT c.event_id AS cand, j.event_id, round(sum((n1 + c.label * w.w) / (n0 + n1 + w.w) - n1 / (n0 + n1))
    / {len(LEAF_TREES)}, 12) AS move
  FROM cands c JOIN w ON w.label = c.label JOIN judged j ON j.tree = c.tree AND j.leaf = c.leaf AND n0 + n1 > 0
  GROUP BY c.event_id, j.event_id),
after AS (SELECT x.cand, b.label, CASE WHEN round(p + coalesce(move, 0), 12) >= 0.5 THEN 1 ELSE 0 END AS said
  FROM (SELECT DISTINCT event_id AS cand FROM cands) x CROSS JOIN before b
  LEFT JOIN alone a ON a.cand = x.cand AND a.event_id = b.event_id),
quality AS (SELECT cand AS event_id, sum(label * said) AS tp, sum((1 - label) * said) AS fp,
  sum(label * (1 - said)) AS fn, coalesce(2 * sum(label * said) / nullif(sum(label) + sum(said), 0), 0.0) AS f1
  FROM after GROUP BY cand),
base AS (SELECT coalesce(2 * sum(label * (p >= 0.5)::INT) / nullif(sum(label) + sum((p >= 0.5)::INT), 0), 0.0) AS base_f1
  FROM before)"""


#: Scores of the pool that know nothing of the value, so that some labels are wrong.
SECOND = """
sc2 AS (SELECT event_id, part, CASE WHEN p_second >= 0.5 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN p_second >= 0.5 THEN p_second ELSE 1 - p_second END AS confidence
  FROM ev JOIN placed USING (event_id) WHERE part > 1)"""


def second_scores(spark, sf):
    """The pool, scored, without the rows that teach or judge."""
    p = F.col("p_second")
    pool = table(spark, sf, "events").filter("user_id % 5 > 1").select("event_id")
    return two_scores(spark, sf).join(pool, "event_id").select(
        "event_id", F.when(p >= 0.5, 1).otherwise(0).alias("prediction"),
        F.when(p >= 0.5, p).otherwise(1 - p).alias("confidence"))


@query("candidate_f1", f"""
WITH {EVENTS}, {LEAF_ROWS}, {SECOND}, cands AS (SELECT event_id, prediction AS label, tree, leaf
  FROM (SELECT event_id, tree, leaf FROM rows_of) JOIN sc2 USING (event_id) WHERE confidence > 0.9),
{LEAF_F1} SELECT event_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  {q6("f1")}, {q6("base_f1")} FROM quality, base""")
def candidate_f1(spark, sf):
    """Validation F1 with each of many candidates added alone, from leaves."""
    rows = leaf_rows(spark, sf)
    labels = second_scores(spark, sf).filter("confidence > 0.9").select("event_id", F.col("prediction").alias("label"))
    cands = rows.select("event_id", "tree", "leaf").join(labels, "event_id")
    out = leaves.candidate_f1(rows.filter("part = 0"), rows.filter("part = 1"), cands, "event_id", "label")
    return rounded(out, ["f1", "base_f1"])


@query("select_beneficial", f"""
WITH {EVENTS}, {LEAF_ROWS}, {SECOND},
ranked AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, event_id) AS rn FROM sc2 WHERE confidence > {CHOICE[1]}),
tested AS (SELECT * FROM ranked WHERE rn <= {2 * CHOICE[0]}),
cands AS (SELECT r.event_id, prediction AS label, tree, leaf FROM rows_of r JOIN tested USING (event_id)),
{LEAF_F1}, chosen AS (SELECT t.*, row_number() OVER (ORDER BY f1 >= {CHOICE[2]} * base_f1 DESC, rn) AS place
  FROM tested t JOIN quality USING (event_id), base)
SELECT event_id, {q6("confidence")}, rn AS "rank" FROM chosen WHERE place <= {CHOICE[0]}""")
def select_beneficial(spark, sf):
    """The choice of pool rows with every candidate tested alone."""
    rows = leaf_rows(spark, sf)
    keeps = selftrain.leaf_quality_test(
        rows.filter("part = 0"), rows.filter("part = 1"),
        lambda cands: rows.join(cands.select("event_id"), "event_id", "left_semi"), "label", "event_id", CHOICE[2])
    out = selftrain.select_beneficial(second_scores(spark, sf), "event_id", *CHOICE[:2], keeps)
    return out.select("event_id", r6("confidence"), "rank")


@query("select_confident", f"WITH {EVENTS} {ranked_sql('', 2500)}")
def select_confident(spark, sf):
    """The choice where few rows are confident, so that no test can change it."""
    out = selftrain.select_beneficial(scored_pool(spark, sf), "event_id", 2500, 0.998)
    return out.select("event_id", r6("confidence"), "rank")


# --- forests and loops over documents ------------------------------------------------------


def prepared(spark, sf):
    return training.process_enhanced(
        labelled_docs(spark, sf), pool_docs(spark, sf), training.Experiment(row_id="doc_id"))


def labelled_split(spark, sf, labelled=None):
    """The labelled documents with a 'split' column; their texts are read and measured once."""
    docs = cut_lineage(labelled_docs(spark, sf) if labelled is None else labelled)
    return cut_lineage(sample.stratified_split(gathered(docs, docs.count()), "label", "doc_id", 0.3))


def labelled_parts(spark, sf, labelled=None):
    """(train, test) of the labelled documents; clipped and scaled by the training rows."""
    split = labelled_split(spark, sf, labelled)
    train = split.filter("split = 'train'").drop("split")
    inputs, _ = models.fit_inputs(train, DESC, "label", clip=3.0, scale=True)
    made = cut_lineage(models.apply_inputs(split, inputs, DESC))
    take = lambda name: made.filter(F.col("split") == name).drop("split")
    return take("train"), take("test"), inputs


def split_docs(spark, sf):
    train, test, _ = labelled_parts(spark, sf)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")))


def parts(spark, sf):
    """(train, test, pool) of all documents; their texts are read and measured once."""
    docs, labels = cut_lineage(descriptors(spark, sf)), doc_labels(spark, sf)
    train, test, inputs = labelled_parts(spark, sf, docs.join(labels, "doc_id"))
    pool = docs.join(labels, "doc_id", "left_anti")
    return train, test, cut_lineage(models.apply_inputs(pool, inputs, DESC))


def flagship(spark, sf):
    train, test, _ = labelled_parts(spark, sf)
    model = models.random_forest(train, DESC, "label", trees=TREES)
    scored = models.predict(model, test, ["doc_id", "label"])
    return evaluate.evaluate_scores(scored, "label", "prediction", "p1")


@query("random_forest")
def random_forest(spark, sf):
    train, test, _ = labelled_parts(spark, sf)
    return models.predict(
        models.random_forest(train, DESC, "label", trees=TREES), test, ["doc_id", "label"])


@query("logistic_regression")
def logistic_regression(spark, sf):
    train, test, _ = labelled_parts(spark, sf)
    return models.predict(
        models.logistic_regression(train, DESC, "label"), test, ["doc_id", "label"])


@query("rbf_svm")
def rbf_svm(spark, sf):
    train, test, _ = labelled_parts(spark, sf)
    return models.rbf_svm(train, test, DESC, "label", ["doc_id", "label"])


@query("compare_models")
def compare_models(spark, sf):
    split = split_docs(spark, sf)
    return models.compare_models(
        split, {"all": DESC, "size": VIEW_SIZE}, "label", "doc_id", trees=TREES)


# Fixed values of the settings searches.
FOREST_SPACE = {"trees": [50, 100, 150, 200], "max_depth": [10, 15, 20, 25, 30],
                "min_leaf": [1, 2, 4], "subset": ["sqrt", "log2"]}


@query("hyperparameter_search")
def hyperparameter_search(spark, sf):
    """The trials; the best is fitted again on all training rows and stored with its test metrics."""
    split = labelled_split(spark, sf)
    part = lambda df, name: df.filter(F.col("split") == name).drop("split")
    train, test = part(split, "train"), part(split, "test")
    inputs, _ = models.fit_inputs(train, DESC, "label", clip=3.0, scale=True)
    ready = models.apply_inputs(train, inputs, DESC)
    inner = cut_lineage(sample.stratified_split(ready, "label", "doc_id", 0.25, seed=43))
    tried = cut_lineage(models.hyperparameter_search(
        part(inner, "train"), part(inner, "test"), DESC, "label", FOREST_SPACE, 20))
    # clipping and scaling become part of the stored model
    model, _ = models.refit_best(tried, train, DESC, "label", clip=3.0, scale=True)
    scored = models.predict(model, test, ["doc_id", "label"])
    got = evaluate.evaluate_scores(scored, "label", "prediction", "p1").first()
    path = scratch_path(spark, "best-forest")
    bundles.save_model(model, path, "best-forest", "RandomForest", "documents", "toxic", DESC,
                       {"f1": got["f1"], "roc_auc": got["roc_auc"]}, spark)
    return tried.withColumn("best_model", F.when(F.col("is_best"), F.lit(path)))


#: Trials of the registered search and trees of its forests; the operator's defaults are 50 and 100.
SEMI_TRIALS, SEMI_TREES = 12, 50
SEMI_SPACE = {"ssl_method": ["label_propagation", "self_training"], "n_unlabeled": [5000, 10000, 15000, 20000],
              "lp_gamma": (0.001, 0.5, "log"), "lp_max_iter": [500, 1000, 1500],
              "st_threshold": (0.7, 0.95), "st_max_iter": [5, 10, 15]}


@query("semi_supervised_search")
def semi_supervised_search(spark, sf):
    """Trials over method, pool size, γ, rounds and threshold; the test part validates."""
    train, test, pool = parts(spark, sf)
    ordered = cut_lineage(sample.shuffle_order(pool, "doc_id"))
    return selftrain.semi_supervised_search(
        train, test, ordered, DESC, "label", "doc_id", SEMI_SPACE, SEMI_TRIALS, forest={"trees": SEMI_TREES})


def half_folds(spark, sf):
    return cut_lineage(
        sample.stratified_folds(labelled_docs(spark, sf), "label", "doc_id", 2))


MASKS = [[1] * 8, [1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 0, 1, 0, 1, 0, 1], [1, 1, 1, 0, 0, 0, 0, 0],
         [0] * 8, [0, 0, 0, 1, 1, 1, 1, 1]]


def _weight_sql(i: int) -> str:
    within = " + ".join(
        f"(t.q{i}_{y} - t.n_{y} * (t.s{i}_{y} / t.n_{y}) * (t.s{i}_{y} / t.n_{y}))" for y in (0, 1))
    return f"""coalesce((t.s{i}_1 / t.n_1 - t.s{i}_0 / t.n_0) / (
      CASE WHEN {within} > (t.q{i}_0 + t.q{i}_1) * 1e-12 THEN {within} END
      / (t.n_0 + t.n_1 - 2)), 0.0) AS w{i}"""


_W = [_weight_sql(i) for i in range(8)]
_SUMS = ", ".join(
    f"count(*) FILTER (label = {y}) AS n_{y}, " + ", ".join(
        f"sum({c}) FILTER (label = {y}) AS s{i}_{y}, sum({c} * {c}) FILTER (label = {y}) AS q{i}_{y}"
        for i, c in enumerate(DESC)) for y in (0, 1))
_SCORES = " UNION ALL ".join(
    f"SELECT {m} AS mask_id, fold, label, "
    + (" + ".join(f"{c} * w{i}" for i, c in enumerate(DESC) if mask[i]) or "0.0")
    + " AS p FROM weighed" for m, mask in enumerate(MASKS))


@query("ga_fitness", f"""
WITH {LABELLED}, ranked AS ({hash_rank("labelled", "doc_id")}),
folds AS (SELECT *, (rn - 1) % 2 AS fold FROM ranked),
t AS (SELECT f.fold, {_SUMS} FROM (SELECT DISTINCT fold FROM folds) f
  JOIN folds r ON r.fold <> f.fold GROUP BY f.fold),
w AS (SELECT fold, {", ".join(_W)} FROM t),
weighed AS (SELECT folds.*, w.* EXCLUDE (fold) FROM folds JOIN w USING (fold)),
scored AS ({_SCORES}),
per AS (SELECT mask_id, fold, p, sum(label) AS pos, sum(1 - label) AS neg FROM scored
  GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY mask_id, fold ORDER BY p) - neg AS below,
  sum(pos) OVER (PARTITION BY mask_id, fold) AS ap, sum(neg) OVER (PARTITION BY mask_id, fold) AS an
  FROM per),
auc AS (SELECT mask_id, fold, sum(pos * (below + neg / 2)) / max(ap) / max(an) AS a FROM cum
  GROUP BY mask_id, fold HAVING count(*) > 1),
masks AS (SELECT unnest({list(range(len(MASKS)))}) AS mask_id,
  unnest({["".join(map(str, m)) for m in MASKS]}) AS mask, unnest({[sum(m) for m in MASKS]}) AS n_selected)
SELECT mask_id, mask, n_selected, {q6('''CASE WHEN n_selected = 0 OR avg(a) IS NULL THEN 0.0
  ELSE avg(a) - CASE WHEN n_selected / 8 > 0.5 THEN 0.01 * n_selected / 8 ELSE 0 END END''', "fitness")}
FROM masks LEFT JOIN auc USING (mask_id) GROUP BY mask_id, mask, n_selected""")
def ga_fitness(spark, sf):
    out = models.ga_fitness(half_folds(spark, sf), DESC, "label", MASKS)
    return rounded(out, ["fitness"])


@query("ga_feature_select")
def ga_feature_select(spark, sf):
    return models.ga_feature_select(half_folds(spark, sf), DESC, "label", population_size=100,
                                    generations=20)


@query("retrain_selected")
def retrain_selected(spark, sf):
    split = split_docs(spark, sf)
    return models.retrain_selected(split, DESC, VIEW_STYLE, "label", "doc_id", trees=TREES)


GENERATIONS = """
gens AS (SELECT CAST(year(l_shipdate) AS INT) AS generation, l_linenumber AS n_selected,
  l_discount + l_tax + l_extendedprice / 1000000 AS fitness FROM lineitem)"""


def generations(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("generation"), F.col("l_linenumber").alias("n_selected"),
        (F.col("l_discount") + F.col("l_tax") + F.col("l_extendedprice") / 1000000).alias(
            "fitness"))


STATS = [f"{c}_{s}" for c in ("n_selected", "fitness") for s in ("avg", "min", "max", "std")]


@query("feature_count_stats", f"""
WITH {GENERATIONS} SELECT generation, {", ".join(
    f"round({f}({c})::DOUBLE, 6) + 0.0 AS {c}_{s}" for c in ("n_selected", "fitness")
    for s, f in (("avg", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")))}
FROM gens GROUP BY generation""")
def feature_count_stats(spark, sf):
    return rounded(evaluate.generation_stats(generations(spark, sf)), STATS)


@query("best_of_generation_delta", f"""
WITH {GENERATIONS}, best AS (SELECT generation, max(fitness) AS fitness_max FROM gens
  GROUP BY generation),
f AS (SELECT arg_min(fitness_max, generation) AS first, max(fitness_max) AS top FROM best)
SELECT generation, {q6("fitness_max")}, {q6("(fitness_max - first) / first * 100", "gain_pct")},
  fitness_max = top AS is_best FROM best, f""")
def best_of_generation_delta(spark, sf):
    stats = evaluate.generation_stats(generations(spark, sf))
    return rounded(evaluate.generation_gain(stats, "generation", "fitness_max"),
                   ["fitness_max", "gain_pct"])


@query("self_training")
def self_training(spark, sf):
    train, _, pool = parts(spark, sf)
    _, pseudo = selftrain.self_training(train, pool, DESC, "label", "doc_id", 0.75, trees=TREES)
    return pseudo


@query("self_training_run")
def self_training_run(spark, sf):
    done = prepared(spark, sf)
    split = cut_lineage(sample.train_val_test_split(done.labelled, "label", "doc_id"))
    take = lambda name: split.filter(F.col("split") == name).drop("split")
    return selftrain.self_training_run(
        take("train"), take("val"), take("test"), done.pool, DESC, "label", "doc_id",
        threshold=0.8, target_size=2500, trees=TREES)


@query("co_training")
def co_training(spark, sf):
    train, _, pool = parts(spark, sf)
    _, pseudo = selftrain.co_training(train, pool, VIEW_SIZE, VIEW_STYLE, "label", "doc_id",
                                      trees=TREES)
    return pseudo


@query("co_training_result")
def co_training_result(spark, sf):
    """Test metrics of the two view models together, with what they were taught."""
    train, test, pool = parts(spark, sf)
    pair, pseudo = selftrain.co_training(train, pool, VIEW_SIZE, VIEW_STYLE, "label", "doc_id",
                                         trees=TREES)
    added = pseudo.count()
    return selftrain.co_training_metrics(pair, test, "label", "doc_id").withColumns(
        {"n_pseudo_labeled": F.lit(added), "final_train_size": F.lit(train.count() + added)})


#: Pool rows of the learning curves, clipped to the pool.
SWEEP_SIZES = [0, 500, 1000, 2500, 5000, 10000, 15000, 20000, 25000, 30000]


@query("unlabelled_size_sweep")
def unlabelled_size_sweep(spark, sf):
    train, test, pool = parts(spark, sf)
    ordered = cut_lineage(sample.shuffle_order(pool, "doc_id"))
    return selftrain.unlabelled_size_sweep(
        train, test, ordered, DESC, "label", "doc_id", SWEEP_SIZES, (VIEW_SIZE, VIEW_STYLE),
        trees=TREES)


# --- domain --------------------------------------------------------------------------------


def vectors(spark, sf):
    return cut_lineage(graph_nodes(spark, sf)).withColumn("features", array_to_vector("v"))


@query("pca_project")
def pca_project(spark, sf):
    rows = vectors(spark, sf)
    _, test, shares = domain.pca_project(
        rows.filter("label is not null"), rows.filter("label is null"))
    return test.select(
        "id", vector_to_array("pca").alias("pca"), F.lit(shares[0]).alias("first_share"))


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    rows = vectors(spark, sf)
    _, test, _ = domain.kmeans_assign(
        rows.filter("label is not null"), rows.filter("label is null"))
    return test.select("id", "centre_id", "dist")


@query("kmeans_inertia")
def kmeans_inertia(spark, sf):
    rows = vectors(spark, sf).filter("label is not null")
    return spark.createDataFrame(domain.inertia_by_k(rows, "features"), "k int, inertia double")


@query("elbow_k", f"""
WITH bins AS (SELECT k, least(floor((l_quantity - 1) / 49 * k), k - 1) AS bin, l_extendedprice AS x
  FROM lineitem, (SELECT unnest(range(2, 11)) AS k)),
ss AS (SELECT k, sum(s) AS inertia FROM (
  SELECT k, var_pop(x) * count(*) AS s FROM bins GROUP BY k, bin) GROUP BY k),
d AS (SELECT k, inertia - lag(inertia) OVER (ORDER BY k) AS d FROM ss),
r AS (SELECT k, d / lag(d) OVER (ORDER BY k) AS ratio FROM d)
SELECT CAST(arg_min(k, ratio) AS INT) AS best_k FROM r WHERE ratio IS NOT NULL""")
def elbow_k(spark, sf):
    k = F.col("k")
    bins = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"))
    spread = bins.groupBy(
        "k", F.least(F.floor((F.col("l_quantity") - 1) / 49 * k), k - 1).alias("bin")
    ).agg((F.var_pop("l_extendedprice") * F.count(F.lit(1))).alias("s"))
    return domain.elbow_k(spread.groupBy("k").agg(F.sum("s").alias("inertia")))


CENTRES = """
long AS (SELECT truth, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM nodes
  WHERE label IS NOT NULL),
centres AS (SELECT truth AS centre_id, list(m ORDER BY pos) AS centre FROM (
  SELECT truth, pos, avg(x) AS m FROM long GROUP BY truth, pos) GROUP BY truth),
dists AS (SELECT n.id, n.truth, n.label, min(list_distance(n.v, c.centre)) AS dist,
    arg_min(c.centre_id, list_distance(n.v, c.centre)) AS pred
  FROM nodes n, centres c GROUP BY n.id, n.truth, n.label),
thr AS (SELECT quantile_cont(dist, 0.95) AS threshold FROM dists WHERE label IS NOT NULL),
dom AS (SELECT d.*, threshold, dist <= threshold AS inside FROM dists d, thr WHERE label IS NULL)"""


def placed(spark, sf):
    nodes = graph_nodes(spark, sf)
    known = nodes.filter("label is not null")
    centres = domain.class_centres(known, "v", "label")
    rows = domain.nearest_centroid(nodes, "v", centres).withColumnRenamed("centre_id", "pred")
    return rows.filter("label is not null"), rows.filter("label is null")


@query("applicability_domain", f"""
WITH {NODES}, {CENTRES} SELECT id, {q6("dist")}, {q6("threshold")}, inside FROM dom""")
def applicability_domain(spark, sf):
    out = domain.applicability_domain(*placed(spark, sf))
    return rounded(out.select("id", "dist", "threshold", "inside"), ["dist", "threshold"])


@query("domain_accuracy", f"""
WITH {NODES}, {CENTRES} SELECT inside, count(*) AS n, {q6("avg((truth = pred)::INT)", "accuracy")},
  {q6("count(*) / (SELECT count(*) FROM dom)", "share")} FROM dom GROUP BY inside""")
def domain_accuracy(spark, sf):
    out = domain.applicability_domain(*placed(spark, sf))
    return rounded(domain.domain_accuracy(out, "truth", "pred"), ["accuracy", "share"])


@query("distance_profile", f"""
WITH {NODES}, {CENTRES} SELECT count(dist) AS n, {q6("avg(dist)", "mean")},
  {q6("stddev_pop(dist)", "std")}, {q6("min(dist)", "min")}, {q6("max(dist)", "max")},
  {q6("quantile_cont(dist, 0.95)", "p95")} FROM dists WHERE label IS NOT NULL""")
def distance_profile(spark, sf):
    train, _ = placed(spark, sf)
    return rounded(domain.distance_profile(train), ["mean", "std", "min", "max", "p95"])
