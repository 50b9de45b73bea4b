from __future__ import annotations

import random
from collections import Counter

import numpy as np

from millrace.llm.docstats import counts
from millrace.llm.outliers import FEATURES, SHARE, TAIL, P, chi2_cdf, chi2_quantile, robust_outliers, transformed
from tests.llm.conftest import prose


def base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counters(spark, odd, odd_rows):
    got = Counter(tuple(r)[:7] for r in robust_outliers(odd).collect())
    expected = Counter()
    for i, text, *_ in odd_rows:
        b = base(text)
        expected[(i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == expected


def test_junk_goes_and_prose_stays(spark):
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(60, 500)), "en", f"s{i % 3}") for i in range(400)]
    junk = [(1000 + i, " ".join(f"{w}***" for w in prose(r, 120).split()), "en", "s0") for i in range(25)]
    got = {x.doc_id: x.kept for x in robust_outliers(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string"), min_group=50).collect()}
    assert not any(got[i] for i, *_ in junk)
    assert sum(got[i] for i, *_ in rows) == len(rows)


def test_a_small_source_is_judged_by_all_rows(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(60, 500)), "en", f"s{i % 2}") for i in range(200)]
    junk = [(1000 + i, " ".join(f"{w}***" for w in prose(r, 120).split()), lang, "new") for i, lang in enumerate(["xx", "xx", None, "en"])]
    few = [(2000, prose(r, 120), "yy", "new")]
    got = {x.doc_id: x.kept for x in robust_outliers(spark.createDataFrame(rows + junk + few, "doc_id long, text string, lang string, source string"), min_group=50).collect()}
    assert not any(got[i] for i, *_ in junk)
    assert all(got[i] for i, *_ in rows + few)


def test_quantiles():
    for x in (2.0, 7.0, 12.0):
        assert abs(chi2_quantile(P, 1 - chi2_cdf(P, x)) - x) < 0.1
    sample = (np.random.default_rng(0).normal(size=(100_000, P)) ** 2).sum(1)
    assert abs((sample <= 8).mean() - chi2_cdf(P, 8)) < 0.01


def test_empty(spark, odd):
    assert robust_outliers(odd.limit(0)).count() == 0


def determinant_estimate(x, draw):
    """The covariance of least determinant over SHARE of the rows, by exact concentration from 150 random starts, then reweighted."""
    floor, h = np.diag(np.square(list(FEATURES.values()))), int(np.ceil(SHARE * len(x)))
    far = lambda mean, cov: np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    scaled = lambda part, share: np.cov(part.T, bias=True) * (share / chi2_cdf(P + 2, chi2_quantile(P, 1 - share)) if share < 0.999 else 1) + floor
    best = None
    for _ in range(150):
        part = x[draw.choice(len(x), P + 1, replace=False)]
        for _ in range(30):
            part = x[np.argsort(far(part.mean(0), scaled(part, SHARE)), kind="stable")[:h]]
        found = np.linalg.slogdet(scaled(part, SHARE))[1], part
        best = found if best is None or found[0] < best[0] else best
    part = best[1]
    near = x[far(part.mean(0), scaled(part, SHARE)) <= chi2_quantile(P, 0.025)]
    return far(near.mean(0), scaled(near, max(len(near) / len(x), 0.975)))


def test_verdicts_by_exact_concentration(spark):
    r = random.Random(8)
    rows = [(i, prose(r, r.randint(60, 500)), "en", "s0") for i in range(300)]
    for i in range(60):
        words = prose(r, r.randint(60, 300)).split()
        rows.append((1000 + i, " ".join(w + "*" * (i % 4) if i % 2 else w.upper() for w in words), "en", "s0"))
    got = {x.doc_id: x for x in robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    judged = [(i, transformed(counts(t))) for i, t, *_ in rows if not got[i].base_failed]
    wanted = determinant_estimate(np.array([x for _, x in judged]), np.random.default_rng(0))
    distance = np.array([got[i].distance for i, _ in judged])
    clear = np.abs(np.log(wanted / chi2_quantile(P, TAIL))) > 0.2
    assert clear.mean() > 0.9
    assert [got[i].kept for (i, _), c in zip(judged, clear, strict=True) if c] == (wanted[clear] <= chi2_quantile(P, TAIL)).tolist()
    assert np.median(np.abs(np.log(distance / wanted))) < 0.2
