from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing
from millrace.llm.common import Scratch


def corpus(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 3 else f"small{i % 4}") for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_weights_passes_and_blocks(spark):
    rows, df = corpus(spark)
    got = mixing.mixture(df, target_entropy=0.99, max_repeats=2.5, block_tokens=2000).collect()
    held, used = Counter(), Counter()
    for _, t, s in rows:
        held[s] += len(t.split())
    for r in got:
        used[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-9
    total = sum(used.values())
    for s in held:
        assert abs(used[s] / total - weight[s]) < 0.01
        assert used[s] / held[s] <= 2.5 * 1.01
    times = Counter(r.doc_id for r in got)
    assert set(times) == {i for i, *_ in rows}
    # The exponent is the one that the weights show, by brute force over a fine grid.
    p = {s: n / sum(held.values()) for s, n in held.items()}
    a = math.log(weight["big"] / weight["small0"]) / math.log(p["big"] / p["small0"])
    z = sum(x**a for x in p.values())
    assert all(abs(weight[s] - x**a / z) < 1e-6 for s, x in p.items())
    entropy = -sum(w * math.log(w) for w in weight.values())
    limit = (min(p.values()) / max(p.values())) ** (a - 1)
    assert abs(entropy - 0.99 * math.log(len(p))) < 1e-4 or abs(limit - 2.5) < 1e-4
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.block][r.source] += r.n_tokens
    for k in sorted(blocks)[:-1]:
        assert abs(blocks[k]["big"] / sum(blocks[k].values()) - weight["big"]) < 0.05
    # Within a pass each document is used at most once.
    assert max(Counter((r.doc_id, r["pass"]) for r in got).values()) == 1


def test_rows_repeat_as_planned(spark):
    _, df = corpus(spark)
    planned = Counter(r.doc_id for r in mixing.mixture(df, max_repeats=2.0).collect())
    assert planned == Counter(r.doc_id for r in mixing.mixed(df, max_repeats=2.0).collect())


def test_odd_rows(spark, odd):
    got = mixing.mixture(odd, max_repeats=1.5)
    assert got.filter("doc_id is not null").select("doc_id").distinct().count() == odd.filter("doc_id is not null").select("doc_id").distinct().count()
    assert mixing.mixed(odd, max_repeats=1.5).columns == odd.columns
    assert mixing.mixture(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_exponent_by_brute_force(spark):
    sources = spark.createDataFrame([("a", 10, 800), ("b", 10, 150), ("c", 10, 50)], "source string, docs long, total long")
    got = mixing.solve_exponent(Scratch(spark, "t").keep(sources, "s"), 0.9, 1e9)
    p = [0.8, 0.15, 0.05]

    def entropy(a):
        q = [x**a for x in p]
        return -sum(x / sum(q) * math.log(x / sum(q)) for x in q)

    best = max(k / 10000 for k in range(10001) if entropy(k / 10000) >= 0.9 * math.log(3))
    assert abs(got - best) < 2e-4


@pytest.mark.parametrize("budget", [None, 20_000.0, 27_600.0])
def test_no_document_is_used_too_often(spark, budget):
    rows = [(i, "w " * 10, "big" if i < 900 else "small") for i in range(920)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(df, target_entropy=0.99, max_repeats=3.0, budget=budget).collect()
    assert max(Counter(r.doc_id for r in got).values()) <= 3
    if budget:
        assert abs(sum(r.n_tokens for r in got) - budget) <= 20


def test_a_budget_beyond_all_weights_is_an_error(spark):
    df = spark.createDataFrame([(i, "w " * 10, "big" if i < 900 else "small") for i in range(920)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="budget"):
        mixing.mixture(df, max_repeats=3.0, budget=60_000.0)
