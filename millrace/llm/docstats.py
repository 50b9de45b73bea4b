"""Counts that describe one text; words are runs of characters other than space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

import math

import numpy as np

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARKS = b"!?.,;:"
_NOT_ASCII = bytes(range(128, 256))
_CONTINUATION = bytes(range(128, 192))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _without(data: bytes, drop: bytes) -> int:
    """How many bytes of data are in drop."""
    return len(data) - len(data.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text holds twice or more, the first one included."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = (h[:-2] * _A + h[1:-1]) * _B + h[2:]
    windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def counts(text: str | None) -> dict[str, float]:
    """Counts of a text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    characters = len(data) - _without(data, _CONTINUATION)
    return {
        "n_words": len(words),
        "word_chars": characters - _without(data, WHITE),
        "n_symbols": _without(data, SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_chars": characters,
        "n_lines": len(lines),
        "n_distinct": len(set(words)),
        "n_upper": _without(data, _UPPER),
        "n_lower": _without(data, _LOWER),
        "n_digit": _without(data, _DIGIT),
        "n_marks": _without(data, _MARKS),
        "n_bang": data.count(b"!"),
        "n_bar": data.count(b"|"),
        "n_same": sum(a == b for a, b in zip(words, words[1:], strict=False)),
        "n_wide": _without(data, _NOT_ASCII) - _without(data, _CONTINUATION),
    }


def quality_vector(c: dict[str, float]) -> list[float]:
    """A fixed number of finite statistics, bounded ratios on a square-root scale and lengths on a log scale."""
    words, chars, lines = max(1, c["n_words"]), max(1, c["n_chars"]), max(1, c["n_lines"])
    ratio = lambda a, b: math.sqrt(c[a] / b)
    return [
        math.log1p(c["n_words"]),
        math.log1p(c["word_chars"] / words),
        math.log1p(c["n_words"] / lines),
        ratio("n_symbols", words),
        ratio("n_dup_lines", lines),
        ratio("n_repeat_words", words),
        ratio("n_distinct", words),
        ratio("n_upper", chars),
        ratio("n_lower", chars),
        ratio("n_digit", chars),
        ratio("n_marks", chars),
        ratio("n_bang", words),
        ratio("n_bar", words),
        ratio("n_same", words),
        ratio("n_wide", chars),
    ]
