"""K-means of all runs at once: inertia from the returned centres in SQL, fixed points, odd tables."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from halflight.operators import clusters, domain

SF = "/root/testdata/sf0.01"


def frame(spark, points):
    df = spark.createDataFrame([(n, [float(v) for v in p] if p is not None else None)
                                for n, p in enumerate(points)], "id long, v array<double>")
    return df.withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector("v")))


def in_sql(points, centres):
    con = duckdb.connect()
    con.execute("CREATE TABLE p (id INT, v DOUBLE[]); CREATE TABLE c (no INT, v DOUBLE[])")
    con.executemany("INSERT INTO p VALUES (?, ?)", list(enumerate(points)))
    con.executemany("INSERT INTO c VALUES (?, ?)", list(enumerate(centres)))
    near = ("SELECT p.id, p.v, min(list_distance(p.v, c.v)) AS d, arg_min(c.no, list_distance(p.v, c.v)) AS no "
            "FROM p, c GROUP BY ALL")
    inertia = con.execute(f"SELECT sum(d * d) FROM ({near})").fetchone()[0]
    means = dict(con.execute(f"""SELECT no, list(m ORDER BY pos) FROM (SELECT no, pos, avg(x) AS m FROM (
        SELECT no, unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({near})) GROUP BY no, pos)
        GROUP BY no""").fetchall())
    return inertia, means


def test_inertia_and_centres_in_sql(spark):
    rng = np.random.default_rng(3)
    true = rng.normal(size=(4, 6)) * 20
    points = [(true[n % 4] + rng.normal(size=6) + 1e6).tolist() for n in range(400)]
    runs = clusters.cluster_runs(frame(spark, points).repartition(5), ks=range(2, 7), seedings=4)
    assert [(r.k, r.seeding) for r in runs] == [(k, s) for k in range(2, 7) for s in range(4)]
    assert all(0 < r.rounds < clusters.ROUNDS and len(r.centres) == r.k for r in runs)
    for k in range(2, 7):
        best = clusters.best_run(runs, k)
        inertia, means = in_sql(points, best.centres)
        assert best.inertia == pytest.approx(inertia, rel=1e-6)
        for no, mean in means.items():  # a settled run: each centre is the mean of its rows
            assert np.allclose(best.centres[no], mean, atol=1e-3)
    tried = [(k, clusters.best_run(runs, k).inertia) for k in range(2, 7)]
    assert all(b < a for (_, a), (_, b) in zip(tried, tried[1:], strict=False))
    found = np.array(sorted(clusters.best_run(runs, 4).centres))
    assert np.abs(found - np.array(sorted((true + 1e6).tolist()))).max() < 1


def test_seeds_follow_the_squares(spark):
    """Two near rows and a far one: the second centre is the far one nearly always, from either side."""
    points = [[0.0], [1.0], [100.0]]
    hits = clusters.cluster_runs(frame(spark, points), ks=range(2, 3), seedings=40, rounds=0)
    assert sum([100.0] in r.centres for r in hits) >= 38
    assert len({tuple(map(tuple, r.centres)) for r in hits}) > 2


def test_odd_tables(spark):
    few = frame(spark, [[1.0, 2.0]] * 5 + [[3.0, 4.0], None])
    runs = clusters.cluster_runs(few, ks=range(2, 5), seedings=2)
    assert all(sorted(r.centres) == [[1.0, 2.0], [3.0, 4.0]] and r.inertia == pytest.approx(0) for r in runs)
    none = clusters.cluster_runs(few.limit(0), ks=range(2, 4), seedings=1)
    assert [(r.k, r.inertia, r.centres) for r in none] == [(2, 0.0, []), (3, 0.0, [])]
    train, test, centres = domain.kmeans_assign(few, few, k=2)
    assert centres.count() == 2 and train.columns == [*few.columns, "centre_id", "dist"]
    assert [r.dist for r in test.orderBy("id").collect()][-1] is None


def test_queries(spark):
    from halflight.suite import QUERIES

    got = QUERIES["kmeans_inertia"](spark, SF).orderBy("k").collect()
    assert [r.k for r in got] == list(range(2, 11))
    assert all(b.inertia < a.inertia for a, b in zip(got, got[1:], strict=False))
