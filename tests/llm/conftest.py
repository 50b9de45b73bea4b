"""Documents with everything odd: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, rep string, label int, digest string, comp string, start string, word string, uid string, score string, __runs string, pass string"
EXTRA = ("x", 1, "r", 9, "d", "c", "s", "w", "u", "z", "q", "p")


def prose(r: random.Random, words: int, line: int = 12) -> str:
    vocabulary = [a + b + c for a in ("th", "on", "er", "ke", "mi") for b in ("a", "e", "io", "u") for c in ("n", "st", "", "tion", "ly")]
    out = [r.choice(vocabulary) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + line]).capitalize() + "." for i in range(0, words, line))


def make_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(r, r.randint(20, 200)), r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None])))
    base = prose(r, 150)
    rows[3] = (3, base, "en", "s0")
    rows += [(n, base, "en", "s0"), (n + 1, base.upper(), "en", "s1"), (n + 2, base + " extra words here", "en", "s1"), (n + 3, "intro line\n" + base, "en", "s2")]
    words = base.split(" ")
    for k in range(4):
        words[5 * k + 2] = f"changed{k}"
        rows.append((n + 4 + k, " ".join(words), "en", "s0"))
    rows += [
        (n + 10, None, None, None), (n + 11, "", "en", "s0"), (n + 12, "  \t\n \r\n", "en", "s0"), (n + 13, "One", "en", "s1"), (n + 14, "one", "en", "s1"),
        (n + 15, "é ß 中文 \U0001f600 mixed   text\x1c here " * 9, "fr", "s2"), (n + 16, "a" * 9000, "en", "s0"), (n + 17, "same words again " * 400, "en", "s0"),
        (n + 18, prose(r, 6000), "en", "s0"), (n + 19, "mail a.b@c-d.org or 10.0.0.1, +1 (499) 555-6503 and 4111 1111 1111 1111.", "en", "s1"),
        (None, "row without id " * 5, "en", "s0"), (n + 20, "twice", "en", "s0"), (n + 20, "twice", "en", "s0"), (n + 21, base, "de", "s0"), (n + 21, prose(r, 60), "de", "s0"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return make_rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in odd_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(i, 0 if i % 9 == 0 else 1, 0) for i, *_ in odd_rows if i is not None and i % 2 == 0]
    return spark.createDataFrame([*rows, (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
