from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from millrace.llm.bpe_tree import TreeCodec, encode_decode, is_seam, load_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", "é", "'", "s", "t", " ", "  ", "\n", "1", "2", "!", "ß", " ", "中", "文", "\U0001f600", "ll", "'ve", "\t", "\x1c", "\x85", "٠", "ª", "ok", "the "]


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_with_small_leaves(ranks, library):
    r, codec = random.Random(1), TreeCodec(ranks, P.PATTERN, leaf_chars=20, long_match=64)
    for _ in range(1500):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(1, 200)))
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 1500, "ab" * 700, "1234567" * 200, " " * 1500, "!?" * 700, "中文" * 400, "\n" * 900 + "x"])
def test_long_matches(ranks, library, text):
    assert TreeCodec(ranks, P.PATTERN, leaf_chars=50, long_match=64).encode(text) == library.encode_ordinary(text)


def test_seams_are_borders_of_matches(library):
    import regex

    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice(PARTS) for _ in range(40))
        borders = {m.start() for m in regex.finditer(P.PATTERN, text)}
        assert all(i in borders for i in range(1, len(text)) if is_seam(text[i - 1], text[i]))


def test_query(spark, odd, odd_rows, library):
    got = sorted(map(tuple, encode_decode(odd, PATH, P.PATTERN).collect()), key=repr)
    expected = []
    for i, text, *_ in odd_rows:
        ids = library.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert encode_decode(odd.limit(0), PATH, P.PATTERN).count() == 0


def test_scripts_without_spaces():
    import random

    import public_tokenizers as P
    import tiktoken

    from millrace.llm.bpe_tree import TreeCodec, load_ranks

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = TreeCodec(ranks, P.PATTERN, leaf_chars=256)
    r = random.Random(5)
    pools = ["的一是在不了有和人这中大为上个国我以要他", "あいうえおかきくけこさしすせそ漢字", "абвгдежзийклмнопрст", "กขคงจฉชซ" + "ะาิีึ", "א" "בגדהוזחט", "abc", "!?。，、", "'s't", "0123٣٤", "\U0001f600é́"]
    for k in range(60):
        text = "".join("".join(r.choice(r.choice(pools)) if r.random() < 0.03 else r.choice(pools[k % 10]) for _ in range(r.randint(1, 900))) + r.choice([" ", "", "\n", "。"]) for _ in range(3))
        assert codec.encode(text) == whole.encode_ordinary(text)
