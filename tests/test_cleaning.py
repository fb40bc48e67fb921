import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflight.functions import scoring as fn
from halflight.functions import structure as st
from halflight.operators import clean, profile

NAN, INF = float("nan"), float("inf")


def column(df, c, key="id"):
    return [r[c] for r in df.orderBy(key).collect()]


def test_clip_skips_columns_with_infinity_and_keeps_nan(spark):
    df = spark.createDataFrame(
        [(i, float(i % 5), 1.0, NAN if i == 3 else 0.0) for i in range(20)]
        + [(20, 1000.0, INF, 50.0)], "id int, a double, b double, c double")
    out = clean.clip_outliers(df, ["a", "b", "c"], k=3)
    a = np.array([i % 5 for i in range(20)] + [1000.0])
    high = a.mean() + 3 * a.std(ddof=1)
    assert column(out.table, "a")[-1] == pytest.approx(high)
    assert column(out.table, "b")[-1] == INF
    assert math.isnan(column(out.table, "c")[3])
    assert out.outliers.first()[0] == 2


def test_scale_uses_population_deviation_and_leaves_constants(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 2.0, 7.0), (3, 6.0, 7.0)],
                               "id int, a double, b double")
    other = spark.createDataFrame([(1, 3.0, 9.0)], "id int, a double, b double")
    x = np.array([1.0, 2.0, 6.0])
    got = column(clean.standard_scale(df, ["a", "b"]), "a")
    assert got == pytest.approx(list((x - x.mean()) / x.std()))
    assert column(clean.standard_scale(other, ["a", "b"], fit_on=df), "b") == [2.0]


def test_finite_rows_and_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, INF), (4, None), (5, 4.0)],
                               "id int, x double")
    assert column(clean.finite_rows(df, ["x"]), "id") == [1, 5]
    assert column(clean.median_impute(df, ["x"]), "x") == [1.0, 2.5, 2.5, 2.5, 4.0]


def test_any_positive_drops_all_missing_rows(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, None, None), (3, NAN, 1.0), (4, NAN, NAN)],
                               "id int, a double, b double")
    out = clean.any_positive_label(df, ["a", "b"])
    assert [(r.id, r.label) for r in out.orderBy("id").collect()] == [(1, 0), (3, 1)]


def test_variance_and_correlation_filters(spark):
    rows = [(float(i), float(i) * 2 + 1, float((i * 7) % 11), 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert clean.variance_filter(df, ["a", "b", "c", "d"]) == ["a", "b", "c"]
    assert clean.correlation_filter(df, ["a", "b", "c"]) == ["a", "c"]


def test_wide_correlation_equals_narrow_with_missing_values(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 10)) + 1000
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    cols = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    key = lambda d: {(r.feature_1, r.feature_2): r.r for r in d.collect()}
    wide, narrow = key(profile._wide_pairs(df, cols)), key(profile._narrow_pairs(df, cols))
    assert wide.keys() == narrow.keys()
    assert all(wide[k] == pytest.approx(narrow[k], abs=1e-9) for k in wide)


def test_views_fall_back_to_halves():
    assert clean.feature_views(list("abcdef"), ["a", "b"], ["c"]) == (list("abc"), list("def"))


@pytest.mark.parametrize("text,rings,hetero,valid", [
    ("CC(=O)Oc1ccccc1C(=O)O", 1, 4, True),
    ("O=C1CCC(N2C(=O)c3ccccc3C2=O)C(=O)N1", 3, 6, True),
    ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", 1, 2, True),
    ("CN(C)C(=N)NC(=N)N", 0, 5, True),
    ("[Na+].[Cl-]", 0, 2, True),
    ("C%12CCCC%12", 1, 0, True),
    ("not a molecule!", None, None, False),
    ("C1CC", None, None, False),
    ("C(C", None, None, False),
    ("   ", None, None, False),
])
def test_line_notations(spark, text, rings, hetero, valid):
    df = spark.createDataFrame([(text,)], "s string")
    s = st.clean_structure(F.col("s"))
    row = df.select(s.alias("s"), st.ring_count(s).alias("r"),
                    st.hetero_count(st.atom_tokens(s)).alias("h")).first()
    assert (row.s is not None) == valid
    if valid:
        assert (row.r, row.h) == (rings, hetero)


@pytest.mark.parametrize("args,level", [
    ((1, 0, 0.81, 0.81), "LOW"), ((1, 0, 0.8, 0.9), "LOW-MODERATE"),
    ((1, 1, 0.9, 0.71), "MODERATE-HIGH"), ((1, 1, 0.9, 0.7), "MODERATE"),
    ((0, 0, 0.9, 0.9), "MODERATE"), ((0, 1, 0.71, 0.71), "HIGH"),
    ((0, 1, 0.7, 0.9), "MODERATE-HIGH"),
])
def test_decision_table(spark, args, level):
    cols = [F.lit(a) for a in args]
    assert spark.range(1).select(fn.risk_level(*cols)).first()[0] == level
