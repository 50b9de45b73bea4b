from __future__ import annotations

import random
import zlib

import numpy as np

from millrace.llm import rff_quality as q
from millrace.llm.rff_quality import accepted, classify, isotonic
from tests.llm.conftest import prose


def corpus(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = prose(r, r.randint(40, 200))
        rows.append((i, " ".join(f"{w}###" for w in text.split()) if bad else text))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = {r.doc_id for r in accepted(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_labels_of_the_held_fold_are_not_used(spark):
    docs, labels, _ = corpus(spark)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    assert sorted(classify(docs, labels).collect()) == sorted(classify(docs, turned).collect())


def test_odd_rows(spark, odd, labels):
    got = classify(odd, labels).collect()
    assert len(got) == odd.count() and all(r.score is not None for r in got)
    assert {r.score for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    assert classify(odd.limit(0), labels).count() == 0
    assert accepted(odd, labels).columns == odd.columns


def test_isotonic():
    r = np.random.default_rng(1)
    raw = r.normal(size=500)
    label = (r.random(500) < 1 / (1 + np.exp(-3 * raw))).astype(float)
    at, value = isotonic(raw, label)
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all()


def rising(raw, label):
    """Isotonic regression by its max-min formula over distinct raw scores: value of each."""
    at = sorted(set(raw))
    groups = [[y for x, y in zip(raw, label, strict=True) if x == a] for a in at]

    def mean(i, j):
        inside = [y for g in groups[i : j + 1] for y in g]
        return sum(inside) / len(inside)

    return at, [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]


def test_pooling_by_brute_force():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 60):
        raw, label = r.integers(0, 25, n) / 4, r.integers(0, 2, n).astype(float)
        at, value = isotonic(raw, label)
        places, wanted = rising(raw.tolist(), label.tolist())
        pools = {}
        for place, v in zip(places, wanted, strict=True):
            pools.setdefault(round(v, 12), []).extend([place] * int((raw == place).sum()))
        assert np.allclose(at, [np.mean(p) for p in pools.values()])
        assert np.allclose(value, np.clip(list(pools), 0.001, 0.999))


def test_ties_of_both_labels_are_one_pool():
    at, value = isotonic(np.array([0.0, 1.0, 1.0, 1.0, 2.0]), np.array([0.0, 0.0, 0.0, 1.0, 1.0]))
    assert at.tolist() == [0.0, 1.0, 2.0] and np.allclose(value, [0.001, 1 / 3, 0.999])


def test_ridge_by_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(90, q.N_STATS)) * r.uniform(0.5, 3, q.N_STATS) + 1
    y = (x[:, 0] + x[:, 3] > 2).astype(int)
    part = ["calibrate" if i % 4 == 0 else "fit" for i in range(90)]
    train = spark.createDataFrame([(v.tolist(), int(t), p) for v, t, p in zip(x, y, part, strict=True)], "stats array<double>, label int, part string")
    model = q.fit(train.repartition(5))
    fit_x, fit_y = x[[p == "fit" for p in part]], y[[p == "fit" for p in part]]
    z = (fit_x - fit_x.mean(0)) / fit_x.std(0)
    draw = np.random.default_rng(q.SEED)
    w, b = draw.normal(size=(q.N_STATS, q.FEATURES)) / np.sqrt(q.N_STATS), draw.uniform(0, 2 * np.pi, q.FEATURES)
    design = np.array([[np.sqrt(2 / q.FEATURES) * np.cos(sum(v[k] * w[k, f] for k in range(q.N_STATS)) + b[f]) for f in range(q.FEATURES)] + [1.0] for v in z])
    # Ridge as least squares with a row for each penalty.
    penalties = np.diag(np.sqrt([q.RIDGE] * q.FEATURES + [1e-6]))
    wanted = np.linalg.lstsq(np.vstack([design, penalties]), np.concatenate([fit_y, np.zeros(q.FEATURES + 1)]), rcond=None)[0]
    assert np.allclose(model.weights, wanted, atol=1e-6)


def test_features_approximate_the_kernel():
    r = np.random.default_rng(4)
    x = r.normal(size=(40, q.N_STATS))
    f = q.Model(np.zeros(q.N_STATS), np.ones(q.N_STATS), None, None).features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * q.N_STATS))
    assert np.abs(f @ f.T - kernel).mean() < 0.08
