"""Line dedup by winnowing over line hashes.

A passage may begin and end inside a line, where hashes of written lines give no
guarantee. So the lines that are winnowed are rolling ones: at every word of a text a
line of LINE words begins. A window is `min_words` consecutive words, and its fingerprint
the least hash of the rolling lines in it: any passage of that many words has, wherever
it stands, the same windows and the same fingerprints, so no repeat is missed. Windows
next to each other mostly share their minimum; those that do are a piece, and pieces are
some 2 / (min_words - LINE + 2) of the words.

1. The places of fingerprints are counted over all documents; those at one place only are
   dropped.
2. Equal pieces, by a 128-bit hash of all their words, are joined by their positions: all
   but the first, by document id and then place, are repeats as a whole.
3. A fingerprint with several different pieces stands where matches begin or end. There
   the first place of each piece is extended to the exact borders: its windows are
   compared one by one, and those that occur at an earlier place are repeats.
4. Repeats that touch or overlap make up the whole repeated run. The words of repeated runs
   are deleted, with the white space behind them; the first occurrence stays.

With `line_places`, a written line of `line_words` words or more that stands at so many
places is a repeated run as well, however short, at all places but its first.

Each step is a count or a minimum by key, summed map-side, and a join against one row
per key, which Spark can split where a key is frequent; the places of a line are never
paired with each other. Only texts that change are shuffled.

Definitions for odd input: words are told apart by their bytes, and lines and passages by
their words, whatever the white space between them; a null text stays null and an empty
one empty; a run that repeats within one document is deleted at its later place; a
document that loses all its words ends with an empty text; rows are told apart by id and,
if several share an id, by their text (equal rows are one document and get equal
results); a row with a null id is left as it is; texts of any length are taken whole; an
empty table gives an empty result; columns of the input that have the name of one of the
three new columns are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, likely, session_of, unlikely

MIN_WORDS, LINE, LINE_WORDS, LINE_PLACES = 50, 16, 5, 20
NEW = ("n_words", "n_removed", "removed")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of texts that are worked on together, and of which words are hashed at once.
CHUNK_BYTES = 1 << 18


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes begin and end."""
    white = np.concatenate([[True], _WHITE[data], [True]])
    change = np.flatnonzero(white[1:] != white[:-1])
    return change[::2], change[1::2]


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words of each text; 0 for null."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, i = np.zeros(len(texts), np.int64), 0
    while i < len(texts):  # some texts at a time, so that little memory is needed beside them
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 4 * CHUNK_BYTES, "right")) - 1)
        some, at = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        white = _WHITE[some]
        begins = ~white
        begins[1:] &= white[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = ~white[first]
        out[i:j] = np.diff(np.searchsorted(np.flatnonzero(begins), at))
        i = j
    return out


class Passages:
    """128-bit hashes of any runs of words of some texts: differences of running sums of the words' hashes times powers of a base."""

    _powers: list[np.ndarray] = []

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        begin, end = word_edges(self.data)
        self.n = len(begin)
        ends = np.cumsum([len(t) + 1 for t in texts])
        #: Of each text, the first word and the one past the last.
        self.last = np.searchsorted(begin, ends)
        self.first = np.concatenate([[0], self.last[:-1]])
        each = self._words(begin, end)
        self._prepare(self.n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((each if k == 0 else (each ^ (each >> np.uint64(29))) * _MIX) * self._powers[2 * k][: self.n])]) for k in range(2)]
        self.begin = begin

    def _words(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each word's bytes, by the same kind of sums; words are taken in blocks, so that a text of any length needs little memory."""
        out = np.empty(len(begin), np.uint64)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK_BYTES, "right")))
            a, b = begin[i:j] - begin[i], end[i:j] - begin[i]
            self._prepare(int(b[-1]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data[begin[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)) * self._powers[0][: b[-1]])])
            h = (sums[b] - sums[a]) * self._powers[1][a]
            h = (h ^ (h >> np.uint64(32))) * _MIX + (b - a).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * _MIX
            out[i:j] = h ^ (h >> np.uint64(32))
            i = j
        return out

    @classmethod
    def _prepare(cls, n: int) -> None:
        """Powers of each base and of its inverse modulo 2**64, for n words."""
        if cls._powers and len(cls._powers[0]) > n:
            return
        size = max(4096, 2 * n)
        cls._powers = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for base in _BASES for b in (base, pow(base, -1, 1 << 64))]

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for k in range(2):
            h = (self.sums[k][start + length] - self.sums[k][start]) * self._powers[2 * k + 1][start]
            h = (h ^ (h >> np.uint64(32))) * _MIX
            out.append((h ^ (h >> np.uint64(29))).view(np.int64))
        return out[0], out[1]

    def pieces(self, min_words: int, line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First windows, numbers of windows, fingerprints of the pieces, and how often a piece holds its fingerprint."""
        width = min_words - line + 1
        windows = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b - min_words + 1) for a, b in zip(self.first, self.last, strict=True) if b - a >= min_words)])
        if not len(windows):
            return (np.empty(0, np.int64),) * 4
        lines = self.hashes(np.arange(self.n - line + 1), line)[0]
        least = _sliding_min(lines, width)[windows]
        at = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(windows) > 1)]))
        # One place of a fingerprint stands for at most `width` windows; more are several places, next to each other.
        parts = -(-np.diff(np.append(at, len(windows))) // width)
        at = np.repeat(at, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * width
        start, n, mark = windows[at], np.diff(np.append(at, len(windows))), least[at]
        places = np.zeros(len(at), np.int64)
        for k in range(2 * width - 1):
            places += (k < n + width - 1) & (lines[np.minimum(start + k, len(lines) - 1)] == mark)
        return start, n, mark, places

    def written(self, line_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of words of the written lines of at least line_words words."""
        ends = np.searchsorted(self.begin, np.flatnonzero(self.data == 10))
        length = np.diff(np.concatenate([[0], ends]))
        return (ends - length)[length >= line_words], length[length >= line_words]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by running minima of blocks from both ends."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def text_digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _marks(df: DataFrame, min_words: int, line: int, line_words: int) -> DataFrame:
    """id, digest, mark, start, n, low, high, places: pieces (n windows; low and high their hash) and written lines (n words, negative)."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "digest", "mark", "start", "n", "low", "high", "places")])

    def marks(ids: list[int], texts: list[bytes]) -> list[np.ndarray]:
        passages = Passages(texts)
        start, n, mark, places = passages.pieces(min_words, line)
        low, high = passages.hashes(start, n + min_words - 1)
        if line_words:
            begin, length = passages.written(line_words)
            whole, other = passages.hashes(begin, length)
            start, n, mark = np.append(start, begin), np.append(n, -length), np.append(mark, whole)
            low, high, places = np.append(low, whole), np.append(high, other), np.append(places, np.ones(len(whole), np.int64))
        text = np.searchsorted(passages.last, start, "right")
        digests = np.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], np.int64)
        return [np.array(ids, np.int64)[text], digests[text], mark, start - passages.first[text], n, low, high, places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in schema]
            ids, texts, held = [], [], 0
            for i, text in zip([*batch.column(0).to_pylist(), None], [*batch.column(1), None], strict=True):
                if text is not None:
                    ids.append(i)
                    texts.append(text.as_py().encode("utf-8", "surrogatepass"))
                    held += len(texts[-1])
                if texts and (text is None or held >= CHUNK_BYTES):
                    for column, values in zip(columns, marks(ids, texts), strict=True):
                        column.append(values)
                    ids, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], schema=schema)

    return df.mapInArrow(run, "id long, digest long, mark long, start long, n long, low long, high long, places long")


def _windows(docs: DataFrame, ranges: DataFrame, min_words: int) -> DataFrame:
    """id, start, digest, low, high: the windows of the ranges (id, ranges: digest, start, n), each once."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "start", "digest", "low", "high")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in schema]
            for i, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                digest = text_digest(text)
                starts = [np.arange(r["start"], r["start"] + r["n"]) for r in wanted if r["digest"] == digest]
                if starts:
                    at = np.unique(np.concatenate(starts))
                    low, high = Passages([text.encode("utf-8", "surrogatepass")]).hashes(at, min_words)
                    for column, values in zip(columns, (np.full(len(at), i), at, np.full(len(at), digest), low, high), strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], schema=schema)

    texts = likely(docs, F.col("id"), ranges, F.col("id")).join(ranges, "id").select("id", "text", "ranges").dropDuplicates(["id", "text"])
    return texts.mapInArrow(run, "id long, start long, digest long, low long, high long")


def repeated_runs(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    line: int = LINE,
    line_words: int = LINE_WORDS,
    line_places: int | None = LINE_PLACES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """id, runs (array of digest, start, words): where a document repeats what came before."""
    scratch = scratch or Scratch(session_of(df), "lines")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    marks = scratch.keep(_marks(docs, min_words, min(line, min_words), line_words if line_places else 0), "marks")
    place = F.struct("id", "start", "digest")
    counted = marks.groupBy("mark", (F.col("n") < 0).alias("written")).agg(F.sum("places").alias("places"))
    often = counted.filter(F.col("places") >= F.when(F.col("written"), F.lit(line_places)).otherwise(2)).select("mark", "written")
    held = scratch.keep(marks.join(often, (marks["mark"] == often["mark"]) & ((marks["n"] < 0) == often["written"]), "left_semi"), "held")
    scratch.drop(marks)
    pieces = held.groupBy("mark", "n", "low", "high").agg(F.min(place).alias("first"), F.max("places").alias("places"))
    pieces = scratch.keep(pieces, "pieces")
    later = held.join(pieces, ["mark", "n", "low", "high"]).filter(place > F.col("first"))
    later = later.select("id", "digest", "start", F.when(F.col("n") < 0, -F.col("n")).otherwise(F.col("n") + (min_words - 1)).alias("words"))

    several = pieces.filter("n > 0").groupBy("mark").agg(F.sum("places").alias("kinds")).filter("kinds > 1").select("mark")
    borders = pieces.filter("n > 0").join(several, "mark", "left_semi").select("first.id", F.struct("first.digest", "first.start", "n").alias("r"))
    ranges = scratch.keep(borders.groupBy("id").agg(F.collect_set("r").alias("ranges")), "ranges")
    windows = scratch.keep(_windows(docs, ranges, min_words), "windows")
    first = windows.groupBy("low", "high").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1").select("low", "high", "first")
    exact = windows.join(first, ["low", "high"]).filter(place > F.col("first")).select("id", "digest", "start", F.lit(min_words).cast("long").alias("words"))
    return later.union(exact).groupBy("id").agg(F.collect_set(F.struct("digest", "start", "words")).alias("runs"))


def without_runs(text: str, runs: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the words of the runs (first word, words), the merged runs as (first word, past the last), and the words left."""
    data = text.encode("utf-8", "surrogatepass")
    at = word_edges(np.frombuffer(data, np.uint8))[0]
    merged: list[list[int]] = []
    for start, n in sorted(runs):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + n)
        else:
            merged.append([start, start + n])
    left, done = [], 0
    for start, end in merged:
        left.append(data[done : at[start]])
        done = at[end] if end < len(at) else len(data)
    words = len(at) - sum(b - a for a, b in merged)
    return (b"".join([*left, data[done:]]).decode("utf-8", "surrogatepass") if words else ""), [(a, b) for a, b in merged], words


def drop_repeated_lines(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    line_words: int = LINE_WORDS,
    line_places: int | None = LINE_PLACES,
    keep_emptied: bool = True,
) -> DataFrame:
    """df with repeated runs deleted from text_col, and n_words (before), n_removed (words) and removed ("from-to" of words, counted from 0, the end excluded).

    With keep_emptied false, documents that had words and lost all of them go.
    """
    scratch = Scratch(session_of(df), "lines")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in NEW or c in (id_col, text_col)])
    runs = repeated_runs(df, id_col=id_col, text_col=text_col, min_words=min_words, line_words=line_words, line_places=line_places, scratch=scratch)
    id_name, runs_name = fresh(df, "id", "runs")
    runs = scratch.keep(runs, "runs").select(F.col("id").alias(id_name), F.col("runs").alias(runs_name))
    key = F.col(f"`{id_col}`").cast("long")
    changed = likely(df, key, runs, F.col(id_name)).join(runs, key == F.col(id_name), "left").drop(id_name)
    same = unlikely(df, key, runs, F.col(id_name)).withColumn(runs_name, F.lit(None).cast(runs.schema[runs_name].dataType))
    at, fields = df.columns.index(text_col), list(df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = word_counts(batch.column(at))
            removed, spans, texts = np.zeros(len(counts), np.int64), [""] * len(counts), None
            held = batch.column(len(fields))
            for k in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)):
                text = batch.column(at)[k].as_py()
                digest = text_digest(text) if text is not None else None
                found = [(r["start"], r["words"]) for r in held[k].as_py() if r["digest"] == digest]
                if found:
                    texts = texts or batch.column(at).to_pylist()
                    texts[k], merged, _ = without_runs(text, found)
                    removed[k] = sum(b - a for a, b in merged)
                    spans[k] = ",".join(f"{a}-{b}" for a, b in merged)
            keep = (removed == 0) | (removed < counts)
            columns = [*batch.columns[: len(fields)], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.string())]
            if texts:
                columns[at] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *NEW])
            yield out if keep_emptied else out.filter(pa.array(keep, pa.bool_()))

    schema = df.schema.add("n_words", "long").add("n_removed", "long").add("removed", "string")
    return changed.unionByName(same).mapInArrow(run, schema)
