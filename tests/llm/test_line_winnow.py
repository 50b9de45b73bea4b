from __future__ import annotations

import numpy as np

import pyarrow as pa

from millrace.llm.line_winnow import Passages, drop_repeated_lines, word_counts


def words_of(text):
    return text.encode().split()


def brute(rows, least=50, line_words=5, line_places=20):
    """All windows of `least` words, and written lines at many places: (text, words deleted) by id and text."""
    order = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None}, key=lambda x: x[0])
    seen, lines, gone = {}, {}, {}
    for i, t in order:
        words = words_of(t)
        for a in range(len(words) - least + 1):
            seen.setdefault(tuple(words[a : a + least]), []).append((i, a, t, least))
        at = 0
        for x in t.encode().split(b"\n"):
            n = len(x.split())
            if n >= line_words:
                lines.setdefault(tuple(x.split()), []).append((i, at, t, n))
            at += n
    for places in [p for p in seen.values() if len(p) > 1] + [p for p in lines.values() if len(p) >= line_places]:
        low = min((i, a) for i, a, *_ in places)
        for i, a, t, n in places:
            if (i, a) != low:
                gone.setdefault((i, t), set()).update(range(a, a + n))
    out = {}
    for i, t in order:
        drop, left, at = gone.get((i, t), set()), [], 0
        for k, w in enumerate(words_of(t)):
            data = t.encode()
            begin = data.index(w, at)
            if k == 0:
                left.append(data[:begin])
            at = begin + len(w)
            end = at
            while end < len(data) and data[end : end + 1].isspace():
                end += 1
            if k not in drop:
                left.append(data[begin:end])
            at = end
        out[i, t] = (b"".join(left).decode() if drop and len(drop) < len(words_of(t)) else "" if drop else t, len(drop))
    return out


def test_against_all_windows(spark, odd, odd_rows):
    # Rows that share both id and place are told apart by a hash of the text, which a brute force needn't repeat.
    plain = odd.filter("doc_id is null or doc_id < 81")
    expected = brute([r for r in odd_rows if r[0] is None or r[0] < 81])
    got = drop_repeated_lines(plain).collect()
    assert len(got) == plain.count()
    texts = {i: t for i, t, *_ in odd_rows if i is not None and i < 81}
    for r in got:
        if r["doc_id"] is None or texts[r["doc_id"]] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["text"], r["n_removed"]) == expected[r["doc_id"], texts[r["doc_id"]]]
    assert any(r["n_removed"] for r in got) and set(odd.columns) < set(got[0].asDict())


def test_passages_inside_lines_and_frequent_lines(spark):
    draw = np.random.default_rng(3)
    some = lambda n: " ".join("w" + str(k) for k in draw.integers(0, 100_000, n))
    passages = [some(n) for n in (50, 51, 60, 120, 49)]
    rows = []
    for i in range(60):
        text = some(int(draw.integers(1, 90))) + " "
        for p in draw.choice(5, 2):
            cut = int(draw.integers(0, 8)) if i % 3 else 0
            text += " ".join(passages[p].split(" ")[cut:]).replace(" ", "\n" if i % 4 == 0 else " ", 3) + " " + some(int(draw.integers(0, 40))) + "\n"
        rows.append((i, text + ("\nthis line stands in every document" if i % 2 else "\nthis line not")))
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_removed int, removed string").repartition(4)
    for kwargs in ({}, {"line_places": None}):
        expected = brute(rows, line_places=kwargs.get("line_places", 20) or 1 << 30)
        got = {r.doc_id: (r.text, r.n_removed) for r in drop_repeated_lines(df, **kwargs).collect()}
        assert got == {i: expected[i, t] for i, t in rows}
    assert drop_repeated_lines(df).columns == ["doc_id", "text", "n_words", "n_removed", "removed"]


def test_any_passage_has_its_fingerprints_anywhere(odd_rows):
    passage = [f"word{k}".encode() for k in range(60)]
    inside = None
    for before, after in ((0, 0), (1, 7), (70, 90), (13, 0)):
        found = Passages([b" ".join([b"x%d" % k for k in range(before)] + passage + [b"y%d" % k for k in range(after)])])
        start, n, mark, _ = found.pieces(50, 16)
        each = {int(a) + k - before: int(m) for a, c, m in zip(start, n, mark, strict=True) for k in range(c)}
        inside = inside or {k: each[k] for k in range(11)}
        assert {k: each[k] for k in range(11)} == inside
        low = found.hashes(np.arange(before, before + 11), 50)
        assert np.array_equal(low[0], Passages([b"\n".join(passage)]).hashes(np.arange(11), 50)[0])


def test_word_counts(odd_rows):
    texts = [t for _, t, *_ in odd_rows]
    assert word_counts(pa.array(texts)).tolist() == [len((t or "").encode().split()) for t in texts]
    assert word_counts(pa.array(["x", *texts, " a b"]).slice(1, len(texts))).tolist() == [len((t or "").encode().split()) for t in texts]
    assert word_counts(pa.array([], pa.string())).tolist() == [] and word_counts(pa.array([None, ""], pa.string())).tolist() == [0, 0]


def test_empty(spark, odd):
    assert drop_repeated_lines(odd.limit(0)).count() == 0
