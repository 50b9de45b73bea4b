"""Byte-level BPE by monoid tree reduction.

A text is halved until the parts are short; parts are encoded, and neighbours are
joined by encoding a window around their border again. The window grows until its
two ends are places where the tokens outside can't change:

* The splitting pattern never lets one match hold a non-space character followed
  by white space, a letter followed by a digit or sign, a digit followed by a
  letter or sign, or a sign followed by a digit, and it looks ahead only behind
  white space. Such a change of kind is therefore a border between matches in any
  surroundings ("seam"), and what is encoded on either side of it is final.
* Within one match there are no seams. Where the border lies so far inside a run of
  characters of one kind, as in scripts without spaces, that it is inside one match, a
  join is final when the tokens on both sides of each window end are what the merges
  give for those two tokens alone: a token sequence is the encoding of its bytes if and
  only if each neighbouring pair is.

Kinds of characters are those on which the oldest character table at hand and the
newest agree, so that no seam depends on the version of a library's tables.

The join is associative, so any tree over the parts gives the same ids. Decoding
concatenates the parts' bytes up the same kind of tree.

Nulls and empty texts have no tokens. Texts of any length are encoded whole. Repeated rows
give repeated results; an empty table gives an empty result; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a part that is encoded at once, and bytes of a single match above which it is halved itself.
LEAF_CHARS, LONG_MATCH = 512, 4096
WINDOW = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Kinds(dict):
    """1 letter, 2 number, 3 other and, for the four plain ones, 0 white space: the classes of the splitting pattern; -1 where tables may differ."""

    def __missing__(self, c: str) -> int:
        old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        kind = {"L": 1, "N": 2, "M": 3, "P": 3, "S": 3}.get(new[0], -1)
        self[c] = kind = kind if old[0] == new[0] and ord(c) > 126 or 32 < ord(c) < 127 else 0 if c in " \t\n\r" else -1
        return kind


_KINDS = _Kinds()
_SEAMS = {(1, 0), (2, 0), (3, 0), (1, 2), (2, 1), (1, 3), (2, 3), (3, 2)}


def is_seam(left: str, right: str) -> bool:
    return (_KINDS[left], _KINDS[right]) in _SEAMS


class TreeCodec:
    """Encodes and decodes whole texts; ranks: the vocabulary, pattern: its splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, long_match: int = LONG_MATCH):
        self.ranks = ranks
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars, self.long_match = leaf_chars, long_match
        self.names = {rank: str(rank) for rank in ranks.values()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.unbroken = re.compile(r"[^\s]{%d,}|\s{%d,}" % (long_match, long_match))

    # -- encoding ---------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        return self._node(text, 0, len(text))

    def _leaf(self, text: str) -> list[int]:
        if len(text) < self.long_match or not self.unbroken.search(text):
            return self.leaf.encode_ordinary(text)
        import regex

        ids: list[int] = []
        for match in regex.finditer(self.leaf._pat_str, text):
            piece = match.group().encode()
            ids += self._piece(piece) if len(piece) > self.long_match else self.leaf.encode_ordinary(match.group()) if len(piece) < 3 else self._merge(piece)
        return ids

    def _node(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self._leaf(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._node(text, start, middle), self._node(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its halves."""
        width = WINDOW
        while True:
            low = next((i for i in range(middle, max(start, middle - width), -1) if is_seam(text[i - 1], text[i])), start if middle - width <= start else -1)
            high = next((i for i in range(middle, min(end, middle + width)) if i > start and is_seam(text[i - 1], text[i])), end if middle + width >= end else -1)
            if low >= 0 and high >= 0:
                break
            if width == WINDOW and middle - width > start and middle + width < end:
                joined = self._join_inside(text[middle - width : middle], text[middle : middle + width], left, right)
                if joined is not None:
                    return joined
            width *= 2
        # Outside the seams both halves' tokens are final; the window's own tokens are counted by encoding its halves.
        old_left = len(self._leaf(text[low:middle])) if low < middle else 0
        old_right = len(self._leaf(text[middle:high])) if middle < high else 0
        window = self._leaf(text[low:high]) if low < high else []
        return left[: len(left) - old_left] + window + right[old_right:]

    def _join_inside(self, before: str, after: str, left: list[int], right: list[int]) -> list[int] | None:
        """The join where all characters around the border are of one kind, so that it is inside one match; None if they aren't, or too few are near."""
        kind = _KINDS[before[0]]
        if kind < 1 or any(_KINDS[c] != kind for c in before) or any(_KINDS[c] != kind for c in after):
            return None
        # The first characters of a run may belong to another match, as those of 's do, and so are not used.
        most = [len(before[8:].encode()), len(after.encode()) - 8]
        take = 4
        while True:
            ends = left[-take:], right[:take]
            sizes = [sum(len(self.bytes_of[t]) for t in x) for x in ends]
            if sizes[0] > most[0] or sizes[1] > most[1] or take >= min(len(left), len(right)):
                return None
            window = self._merge_bytes(b"".join(self.bytes_of[t] for x in ends for t in x))
            if self._holds(left[-take - 1], window[0]) and self._holds(window[-1], right[take]):
                return left[:-take] + window + right[take:]
            take *= 2

    # -- one long match ---------------------------------------------------
    def _merge(self, piece: bytes) -> list[int]:
        """The ids of one match, as the library gives them."""
        return self.leaf._encode_single_piece(piece)

    def _merge_bytes(self, piece: bytes) -> list[int]:
        if len(piece) > 128:  # longer than any token, so that the library's look-up of whole matches finds none
            return self.leaf._encode_single_piece(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _holds(self, a: int, b: int) -> bool:
        if (a, b) not in self._pairs:
            if len(self._pairs) > 100_000:
                self._pairs.clear()
            self._pairs[a, b] = self._merge_bytes(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self._pairs[a, b]

    def _piece(self, piece: bytes) -> list[int]:
        if len(piece) <= max(256, self.long_match // 2):
            return self._merge_bytes(piece)
        middle = len(piece) // 2
        left, right = self._piece(piece[:middle]), self._piece(piece[middle:])
        take = 16
        while True:
            i, j = max(0, len(left) - take), min(len(right), take)
            window = self._merge_bytes(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self._holds(left[i - 1], window[0])) and (j == len(right) or self._holds(window[-1], right[j])):
                return left[:i] + window + right[j:]
            take *= 2

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return self.leaf.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_decode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    with_decoded: bool = False,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """Per row of df: id, n_tokens, ids_sha256, decoded_sha256, and on request the ids and the decoded text themselves.

    ranks_path: a rank file that every executor can read, a parameter; it is never
    copied. A null text counts as empty. Repeated rows give repeated results;
    further columns of df are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or TreeCodec(load_ranks(ranks_path), pattern, leaf_chars)
            name = codec.names.__getitem__
            counts, ids_hash, bytes_hash, all_texts = [], [], [], []
            flat = array("i")  # four bytes an id
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                data = codec.decode(ids)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    flat.extend(ids)
                if with_decoded:
                    all_texts.append(data.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *counts])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(all_texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_decoded else "")
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)
