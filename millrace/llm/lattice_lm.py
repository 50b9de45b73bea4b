"""Language model scores: marginal probability of a text over all its segmentations.

A text is its words in lower case (A-Z only) and one end. Each word, with the space
before it, is a lattice whose edges are the pieces of an existing subword vocabulary;
no piece crosses a word, so the probability of the text is the product of its words',
and that of a word is the sum over all ways to cut it into pieces, by the forward
recursion in log space. Single characters can also be spelt in byte pieces, so that
every text has a probability.

Piece weights start from the vocabulary's scores: probabilities where they are log
probabilities, and where they only rank the pieces (score = -rank, as in the vocabulary
on hand) a Zipf prior. Worth PRIOR pieces, they are joined by the pieces of the training
documents' words. With learn=False the vocabulary's scores alone give the score.

The words of the training documents, and the end, are further edges, over whole words. A
word with c of N training tokens, of V kinds, has the edge weight c / (N + V), and all
other ways through its lattice share V / (N + V), the rate of new words so far (Witten
and Bell). So the marginal probability of a word is their sum; a word never seen is
spelt from pieces.

Word counts come from all training documents: summed per task, then by word; each
distinct word's lattice is worked out once. Scoring needs each word's numbers again. Words
at or above a count that at most HEAD words reach are sent to the tasks, a table of
bounded size; the rest are joined by word, where no word is frequent any more. Nothing
else is sent, and nothing is capped.

Definitions for odd input: a null text counts as empty, which is one end token; rows
are scored one by one, so repeated rows and rows sharing an id each get their score; a
null id counts as empty text for the split; without training rows every word has count
0 and the pieces their prior; texts and words of any length are scored whole; an empty
table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, crc_mod, session_of

HEAD, PRIOR, FLUSH = 1 << 18, 50_000.0, 300_000
SPACE = "▁"


class Vocabulary:
    """Pieces and byte pieces of a vocabulary file, with the prior that its scores give."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.ids = [i for i in ids if not (self.model.is_control(i) or self.model.is_unknown(i))]
        self.size = self.model.get_piece_size()
        scores = {i: self.model.get_score(i) for i in self.ids}
        self.prior = np.zeros(self.size)
        if all(x == int(x) for x in scores.values()):  # ranks
            for rank, i in enumerate(sorted(self.ids, key=lambda i: (-scores[i], i))):
                self.prior[i] = 1 / (rank + 10)
        else:
            self.prior[self.ids] = np.exp([scores[i] for i in self.ids])
            self.prior[self.prior == 0] = self.prior[self.prior > 0].min()
        self.prior[self.model.eos_id()] = 1 / 100
        self.prior *= PRIOR / self.prior.sum()

    def count(self, words: list[str], times: list[int]) -> np.ndarray:
        """How often each piece stands in the words as the vocabulary's own tokenizer cuts them."""
        ids = self.model.encode(words, num_threads=1)
        flat = np.fromiter((i for x in ids for i in x), np.int64)
        weight = np.repeat(np.array(times, float), [len(x) for x in ids])
        return np.bincount(flat, weight, self.size) if len(flat) else np.zeros(self.size)


class Lattice:
    """Forward recursion over the pieces with the given log probabilities (natural), for many words at once.

    Pieces are looked up by a rolling hash of 64 bits; a word's row of the tables has one
    column for each character, so words are taken in order of length.
    """

    BASE, LONG, ROWS = np.uint64(0x9E3779B97F4A7C15), 64, 4096

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        logs = np.log(weights / weights.sum(), where=weights > 0, out=np.full(len(weights), -np.inf))
        self.end = float(logs[vocabulary.model.eos_id()])
        self.bytes = [0.0] * 256
        pieces = []
        for i in vocabulary.ids:
            piece = vocabulary.model.id_to_piece(i)
            if vocabulary.model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = float(logs[i])
            else:
                pieces.append((piece, float(logs[i])))
        self.longest = max(len(p) for p, _ in pieces)
        self.known = dict(pieces)
        self.powers = np.cumprod(np.full(self.longest, self.BASE))
        keys = self._hashes(self._codes([p for p, _ in pieces], self.longest))[np.arange(len(pieces)), [len(p) for p, _ in pieces]]
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], np.array([x for _, x in pieces])[order]
        self.spelt = np.full(0x110000, np.nan)

    @staticmethod
    def _codes(texts: list[str], width: int) -> np.ndarray:
        return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of the first 0, 1, ... characters of each row."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * self.BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        return out

    def _spelling(self, c: str) -> float:
        """The log probability of a character in byte pieces."""
        if math.isnan(self.spelt[ord(c)]):
            self.spelt[ord(c)] = sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
        return float(self.spelt[ord(c)])

    def words(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word, with the space before it."""
        texts = [SPACE + w.decode("utf-8", "replace") for w in words]
        out = np.empty(len(texts))
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        start = 0
        while start < len(order) and len(texts[order[start]]) <= self.LONG:
            end = start + 1
            while end < min(len(order), start + self.ROWS) and len(texts[order[end]]) <= self.LONG:
                end += 1
            rows = order[start:end]
            out[rows] = self._block([texts[i] for i in rows])
            start = end
        for i in order[start:]:
            out[i] = self._long(texts[i])
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        width = len(texts[-1])
        codes = self._codes(texts, width)
        hashes = self._hashes(codes)
        spelt = self.spelt[codes]
        if np.isnan(spelt).any():
            for c in np.unique(codes[np.isnan(spelt)]):
                self._spelling(chr(c))
            spelt = self.spelt[codes]
        length = np.array([len(t) for t in texts])
        forward = np.full((len(texts), width + 1), -np.inf)
        forward[:, 0] = 0.0
        for j in range(1, width + 1):
            first = int(np.searchsorted(length, j))  # rows are in order of length; shorter ones have ended
            far = min(j, self.longest)
            ways = np.empty((far + 1, len(texts) - first))
            ways[0] = forward[first:, j - 1] + spelt[first:, j - 1]
            for n in range(1, far + 1):
                key = hashes[first:, j] - hashes[first:, j - n] * self.powers[n - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ways[n] = np.where(self.keys[at] == key, self.logs[at], -np.inf) + forward[first:, j - n]
            top = ways.max(0)
            forward[first:, j] = top + np.log(np.exp(ways - top).sum(0))
        return forward[np.arange(len(texts)), length]

    def _long(self, text: str) -> float:
        """The same recursion for a text of any length, keeping as many places as the longest piece has characters."""
        near = [0.0]
        for j in range(1, len(text) + 1):
            ways = [near[-1] + self._spelling(text[j - 1])]
            for n in range(1, min(j, self.longest) + 1):
                log = self.known.get(text[j - n : j])
                if log is not None:
                    ways.append(near[-n] + log)
            top = max(ways)
            near = [*near[-self.longest + 1 :], top + math.log(sum(math.exp(w - top) for w in ways))]
        return near[-1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n: for every word of docs (text, held_out) its count over texts not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            for w in other:
                held.setdefault(w, 0)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        other: set[bytes] = set()
        for batch in batches:
            for text, out_of_it in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (other if out_of_it else held).update(words_of(text.as_py()))
                if len(held) + len(other) >= FLUSH:
                    yield out()
                    held.clear()
                    other.clear()
        yield out()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_words(log: np.ndarray, count: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """The log probabilities of lattices to which an edge for the whole word is added, which stands count times in the training tokens."""
    if not tokens:
        return log
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(count), math.log(kinds) + log) - math.log(tokens + kinds)


def word_scores(counts: DataFrame, vocabulary_path: str, weights: np.ndarray, tokens: int, kinds: int) -> DataFrame:
    """word, n, log: the log probability (natural) of each word, worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(Vocabulary(vocabulary_path), weights)
            log = with_words(lattice.words(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype(float), tokens, kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log, pa.float64())], names=["word", "n", "log"])

    return counts.select("word", "n").mapInArrow(run, "word binary, n long, log double")


def piece_weights(counts: DataFrame, vocabulary_path: str, ends: int) -> np.ndarray:
    """Prior plus counted pieces: a number for each piece of the vocabulary, gathered as partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = None, None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(vocabulary_path)
            total = np.zeros(vocabulary.size) if total is None else total
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            total += vocabulary.count(words, batch.column(1).to_pylist())
        at = np.flatnonzero(total) if total is not None else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at] if len(at) else [], pa.float64())], names=["piece", "n"])

    vocabulary = Vocabulary(vocabulary_path)
    weights = vocabulary.prior.copy()
    for piece, n in counts.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
        weights[piece] += n
    weights[vocabulary.model.eos_id()] += ends
    return weights


def _head(scores: DataFrame, bound: int) -> tuple[dict[bytes, tuple[float, float]], int]:
    """log10(n + 1) and log of the words with at least a count that at most `bound` words reach, and that count."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(scores.filter("n > 0").groupBy(level.alias("level")).agg(F.count("*"), F.min("n")).collect(), reverse=True)
    held, least = 0, 1 << 62
    for _, words, smallest in levels:
        if held + words > bound:
            break
        held, least = held + words, smallest
    return {bytes(w): (math.log10(n + 1), log) for w, n, log in scores.filter(F.col("n") >= least).collect()}, least


def lattice_scores(
    df: DataFrame,
    vocabulary_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    head: int = HEAD,
    learn: bool = True,
) -> DataFrame:
    """Per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one words), score (lattice); log10."""
    spark = session_of(df)
    scratch = Scratch(spark, "lm")
    held_out = crc_mod(F.col(id_col), folds) == held_fold
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    counts = scratch.keep(word_counts(docs), "counts")
    ends = docs.filter("not held_out").count()
    distinct, running = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = running + ends, distinct + (ends > 0)
    base_log = math.log10(n + v + 1)
    weights = piece_weights(counts.filter("n > 0"), vocabulary_path, ends) if learn else Vocabulary(vocabulary_path).prior
    learnt = (int(n), int(v)) if learn else (0, 0)
    words = scratch.keep(word_scores(counts, vocabulary_path, weights, *learnt), "words")
    scratch.drop(counts)
    frequent, least = _head(words, head)
    end_log = float(with_words(np.array([Lattice(Vocabulary(vocabulary_path), weights).end]), np.array([float(ends)]), *learnt)[0])
    sent = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            uid = np.frombuffer(os.urandom(8 * batch.num_rows), np.int64)
            tokens, inside, base, score, tails = [], [], [], [], []
            for text in batch.column(1):
                every = words_of(text.as_py())
                total, marginal, n_in, tail = math.log10(ends + 1), end_log, int(ends > 0), []
                for w, times in Counter(every).items():
                    logs = known.get(w)
                    if logs is None:
                        tail.append((w, times))
                    else:
                        total += times * logs[0]
                        marginal += times * logs[1]
                        n_in += times
                tokens.append(len(every) + 1)
                inside.append(n_in)
                base.append(total)
                score.append(marginal)
                tails.append(tail)
            pairs = [p for t in tails for p in t]
            ends_at = np.cumsum([0, *map(len, tails)]).astype(np.int32)
            pair = pa.StructArray.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([t for _, t in pairs], pa.int32())], names=["word", "times"])
            columns = [batch.column(0), batch.column(2), pa.array(uid), pa.array(tokens, pa.int64()), pa.array(inside, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            columns.append(pa.ListArray.from_arrays(pa.array(ends_at), pair))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "uid", "n_tokens", "inside", "base", "log", "tail"])

    schema = f"id {dict(docs.dtypes)['id']}, held_out boolean, uid long, n_tokens long, inside long, base double, log double, tail array<struct<word:binary,times:int>>"
    scored = scratch.keep(docs.mapInArrow(run, schema), "scored")
    tails = scored.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.times")
    hit = tails.join(words.filter(F.col("n") < least), "word")
    known_times = F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0))).cast("long")
    more = hit.groupBy("uid").agg(known_times.alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_base"), F.sum(F.col("times") * F.col("log")).alias("more_log"))
    out = scored.drop("tail").join(more, "uid", "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("inside") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * base_log).alias("base_score"),
        ((F.col("log") + F.coalesce("more_log", F.lit(0.0))) / math.log(10)).alias("score"),
    )
