"""Temperature mixing: exponents against closed forms, quotas and blocks against a loop."""

import math
from collections import defaultdict

import pytest

from halflight.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, "w " * (5 + n % 7), "big" if n % 10 else f"small{n % 3}") for n in range(2000)]
    rows += [(3000 + n, "a b c", None) for n in range(20)] + [(5000, None, "one"), (5001, "", "one")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_exponents(docs):
    sizes = mixing.source_sizes(docs)
    t = [r.tokens for r in sizes.collect()]
    a = mixing.exponent_for_repeats(sizes, 3.0)
    assert abs(a - (1 - math.log(3) / math.log(max(t) / min(t)))) < 1e-9
    assert mixing.exponent_for_repeats(sizes, 1e9) == 0.0
    target = 1.0
    a = mixing.exponent_for_entropy(sizes, target)
    w = [x ** a for x in t]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - target) < 1e-6
    assert mixing.exponent_for_entropy(sizes, 99.0) == 0.0
    assert mixing.exponent_for_entropy(sizes, 0.0) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent_for_repeats(sizes, 0.5)


def brute(plan, used_from, block_tokens):
    """Uses per source from (source, epoch, place, id, tokens) rows of all epochs."""
    found = set()
    for source, (total, quota, budget) in plan.items():
        start = 0
        blocks = math.ceil(budget / block_tokens)
        for epoch in range(math.ceil(quota / total)):
            for place, i, n in sorted(used_from[source, epoch]):
                if start < quota:
                    found.add((i, source, epoch, math.floor(start / quota * blocks), place))
                start += n
    return found


@pytest.mark.parametrize("budget", [None, 6000])
def test_blocks_against_a_loop(docs, budget):
    plan = mixing.mixture_plan(docs, max_repeats=2.5, budget=budget)
    known = {r.source: (r.tokens, r.quota, r.budget) for r in plan.collect()}
    dealt = mixing._dealt(docs, plan, "doc_id", "text", "source", mixing.SEED).withColumn(
        "n", mixing.token_count()).collect()
    rows = defaultdict(list)
    for r in dealt:
        rows[r.source, r._m_epoch].append((r._m_place, r.doc_id, r.n))
    got = mixing.block_permutations(docs, plan, block_tokens=500).collect()
    assert {(r.id, r.source, r.epoch, r.block, r.place) for r in got} == brute(known, rows, 500)
    assert len(got) == len({(r.id, r.epoch) for r in got})
    for source, (_, quota, _) in known.items():
        assert quota <= sum(r.tokens for r in got if r.source == source) < quota + 20
    if budget is None:
        assert len({r.id for r in got}) == docs.count()


def test_mix_documents_keeps_columns_and_all_documents(spark, docs):
    wide = docs.withColumnRenamed("doc_id", "id").selectExpr("*", "1 as place", "2 as quota", "3 as tokens")
    out = mixing.mix_documents(wide, id_col="id")
    assert out.columns == wide.columns
    use = out.groupBy("id").count().collect()
    assert len(use) == docs.count() and max(r["count"] for r in use) == 2
    used = mixing.block_permutations(wide, mixing.mixture_plan(wide, id_col="id"), id_col="id")
    assert used.count() == out.count()
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    again = docs.filter("doc_id = 3").unionByName(docs.filter("doc_id = 3"))
    assert mixing.mix_documents(again).count() == 2
