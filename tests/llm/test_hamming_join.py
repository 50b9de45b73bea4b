from __future__ import annotations

import random
from collections import Counter

import pytest

from millrace.llm.hamming_join import CHUNKS, DISTANCE, POSITIONS, chunk_keys, drop_near_duplicates, near_duplicates
from tests.llm.conftest import prose


def brute(rows, n, percent=80):
    sets = []
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


@pytest.mark.parametrize("n", [2, 5])
def test_against_all_pairs(spark, odd, odd_rows, n):
    got = [tuple(r) for r in near_duplicates(odd, n=n).collect()]
    assert Counter(got) == Counter(brute(odd_rows, n))


def test_family_of_chained_copies(spark):
    r = random.Random(5)
    rows, words = [], prose(r, 150).split(" ")
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[r.randrange(len(words))] = f"w{i}"
    r.shuffle(rows)
    got = [tuple(x) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()]
    assert Counter(got) == Counter(brute(rows, 2))


def test_keys_find_every_pair_within_the_distance():
    r, keys = random.Random(1), chunk_keys(POSITIONS, CHUNKS, DISTANCE)
    for _ in range(2000):
        wrong = set(r.sample(range(POSITIONS), DISTANCE))
        assert any(not wrong & set(k) for k in keys)


def test_one_of_each_group_stays(spark, odd, odd_rows):
    """All rows of an id stay or go together; null ids stay; columns keep their names, values and order, whatever they are called."""
    stays = {i for i, _, _, kept in brute(odd_rows, 5) if kept}
    clash = odd.withColumns({c: odd.n_chars for c in ("__slot", "__word", "__mask", "__hit", "__id")})
    got = drop_near_duplicates(clash)
    assert got.columns == clash.columns
    held = Counter((r.doc_id, r.text, r["__slot"], r["__hit"], r["__id"]) for r in got.collect())
    assert held == Counter((i, t, *[len(t or "")] * 3) for i, t, *_ in odd_rows if i in stays)
    assert drop_near_duplicates(clash.limit(0)).count() == 0


def test_empty(spark, odd):
    assert near_duplicates(odd.limit(0)).count() == 0
