from __future__ import annotations

import math
import zlib
from collections import Counter

import public_tokenizers as P
import pytest

from millrace.llm import lattice_lm as q

PATH = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("head", [0, 20, 100_000])
def test_base_counts(spark, odd, odd_rows, head):
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in q.lattice_scores(odd, PATH, head=head).collect())
    words = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in odd_rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    expected = Counter()
    for i, t, *_ in odd_rows:
        expected[(i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6))] += 1
    assert got == expected


def test_sums_over_all_segmentations():
    vocabulary = q.Vocabulary(PATH)
    lattice = q.Lattice(vocabulary, vocabulary.prior)
    pieces = {vocabulary.model.id_to_piece(i): i for i in vocabulary.ids if not vocabulary.model.is_byte(i)}
    p = vocabulary.prior / vocabulary.prior.sum()

    def every(text):
        if not text:
            return 1.0
        total = math.exp(sum(lattice.bytes[b] for b in text[0].encode())) * every(text[1:])
        return total + sum(p[pieces[text[:k]]] * every(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces)

    for word in ("the", "nation", "é", "中a", "xqz"):
        assert math.isclose(lattice.words([word.encode()])[0], math.log(every(q.SPACE + word)), rel_tol=1e-9)


def test_words_of_all_lengths():
    vocabulary = q.Vocabulary(PATH)
    lattice = q.Lattice(vocabulary, vocabulary.prior)
    words = [("the nation é中 xq" * 40)[:n].replace(" ", "").encode() for n in (1, 5, 9, 30, 80, 300)] + [b"a" * 5000, b"the"]
    together = lattice.words(words)
    for w, log in zip(words, together, strict=True):
        assert math.isclose(log, lattice._long(q.SPACE + w.decode()), rel_tol=1e-9)


def test_training_helps_on_held_out_texts(spark):
    texts = spark.createDataFrame([(i, "the nation of the then onto " * (1 + i % 4)) for i in range(60)], "doc_id long, text string")
    rows = [r for r in q.lattice_scores(texts, PATH).collect() if r.held_out]
    vocabulary = q.Vocabulary(PATH)
    lattice = q.Lattice(vocabulary, vocabulary.prior)
    untrained = lambda t: (lattice.end + lattice.words(q.words_of(t)).sum()) / math.log(10)
    held = dict(texts.collect())
    assert rows and all(r.score > untrained(held[r.doc_id]) for r in rows)


def test_empty(spark, odd):
    assert q.lattice_scores(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("learn", [True, False])
def test_scores_by_brute_force(spark, learn):
    """Weights counted and all segmentations summed here, without the module's recursion."""
    texts = {i: ["the nation of", "then the", "", "onto the né", None, "the then of of"][i % 6] for i in range(36)}
    got = {r.doc_id: r for r in q.lattice_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH, learn=learn).collect()}
    train = [t or "" for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, ends = Counter(w for t in train for w in t.split()), len(train)
    vocabulary = q.Vocabulary(PATH)
    weights = vocabulary.prior.copy()
    if learn:
        for w, c in counts.items():
            for i in vocabulary.model.encode(w):
                weights[i] += c
        weights[vocabulary.model.eos_id()] += ends
    p = weights / weights.sum()
    kind = {vocabulary.model.id_to_piece(i): i for i in vocabulary.ids}
    tokens, kinds = sum(counts.values()) + ends, len(counts) + 1

    def every(text):
        if not text:
            return 1.0
        spelt = math.prod(p[kind[f"<0x{b:02X}>"]] for b in text[0].encode()) * every(text[1:])
        return spelt + sum(p[kind[text[:k]]] * every(text[k:]) for k in range(1, len(text) + 1) if text[:k] in kind)

    def token(way, c):
        return (c + kinds * way) / (tokens + kinds) if learn else way

    for i, t in texts.items():
        ways = [token(every(q.SPACE + w), counts[w]) for w in (t or "").split()] + [token(p[vocabulary.model.eos_id()], ends)]
        assert math.isclose(got[i].score, sum(map(math.log10, ways)), rel_tol=1e-9), (i, t)
