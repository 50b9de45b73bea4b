"""Secret scan: candidates by form, false positives removed by a random forest.

A candidate is a run of characters of an identifier or base-64 alphabet, of 8 or more if
it has a digit and of 20 or more if not. Its statistics are length, kinds of characters,
how usual its character transitions are, how much of it dictionary words cover, and what
the labelled findings say of its first characters, of the words next to it (on its line,
within AROUND characters) and of those of its path (the source): the log odds of a secret
where each stands, learnt from the words that at least LEAST_SEEN findings have. No word
is known beforehand. A forest trained on the findings gives the share of trees that call
it a secret.

The dictionary, and with it the table of transitions, is the word list of an existing
vocabulary file, a parameter. Labelled findings are a table (candidate, before, after,
path, label); at most MAX_TRAIN of them, by hash, are used, on the driver.
`labelled_examples` makes a set of findings of known kinds where none are at hand.

Definitions for odd input: null and empty texts have no candidates; a null source is
an empty path; equal candidates in equal surroundings get equal scores; with no
labelled findings, or of one label only, all scores are that label's share (0.5 for
none); candidates of any length are taken whole; an empty table gives an empty result;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN, TREES, DEPTH, LEAST_LEAF, SEED = 20_000, 40, 9, 4, 5
AROUND, LEAST_SEEN = 64, 8
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|[A-Za-z+/_-]{20})[A-Za-z0-9+/_-]{8,}+={0,2}+")
NAMES = re.compile(r"[A-Za-z]{2,}")
FEATURES = ("length", "digits", "upper", "lower", "signs", "hex", "entropy", "transitions", "coverage", "begins", "before", "after", "path", "assigned", "quoted", "uuid")


class Words:
    """Dictionary words and the character transitions within them."""

    def __init__(self, words: list[str]):
        self.words = {w for w in words if len(w) >= 4}
        self.longest = max(map(len, self.words), default=0)
        counts = np.ones((128, 128))
        for w in words:
            for a, b in zip(w, w[1:], strict=False):
                counts[ord(a), ord(b)] += 1
        self.logs = np.log(counts / counts.sum(1, keepdims=True))

    @staticmethod
    def load(path: str) -> Words:
        """The words of a vocabulary file of the tokenizers library, without marks of word ends."""
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        return Words(sorted({w for t in vocabulary if (w := t.removesuffix("</w>").lower()).isascii() and w.isalpha()}))

    def transitions(self, text: str) -> float:
        codes = np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8)
        return float(self.logs[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def coverage(self, text: str) -> float:
        low, i, covered = text.lower(), 0, 0
        while i < len(low):
            step = next((n for n in range(min(self.longest, len(low) - i), 3, -1) if low[i : i + n] in self.words), 0)
            covered += step
            i += step or 1
        return covered / max(1, len(low))


class Neighbours:
    """Log odds of a secret for words around a candidate, by the kind of place they stand in."""

    def __init__(self, odds: dict[tuple[str, str], float]):
        self.odds = odds

    @staticmethod
    def marks(candidate: str, before: str, after: str, path: str) -> dict[str, list[str]]:
        words = lambda text: NAMES.findall(text.lower())
        return {"begins": [candidate[:4]], "before": words(before)[-3:], "after": words(after)[:3], "path": words(path)}

    @staticmethod
    def fit(rows: list[tuple], least: int = LEAST_SEEN) -> Neighbours:
        """rows: candidate, before, after, path, label."""
        seen: dict[tuple[str, str], list[float]] = {}
        for *row, label in rows:
            for key in {(place, w) for place, found in Neighbours.marks(*row).items() for w in found}:
                seen.setdefault(key, [1.0, 1.0])[int(label)] += 1
        return Neighbours({k: math.log(yes / no) for k, (no, yes) in seen.items() if yes + no - 2 >= least})

    def values(self, *row: str) -> dict[str, float]:
        """The sum of the log odds of the words at each kind of place."""
        return {place: sum(self.odds.get((place, w), 0.0) for w in found) for place, found in self.marks(*row).items()}


def features(words: Words, neighbours: Neighbours, candidate: str, before: str, after: str, path: str) -> list[float]:
    n = len(candidate)
    share = lambda f: sum(map(f, candidate)) / n
    near = neighbours.values(candidate, before, after, path)
    counts = np.unique(np.frombuffer(candidate.encode("ascii", "replace"), np.uint8), return_counts=True)[1] / n
    return [
        math.log(n),
        share(str.isdigit),
        share(str.isupper),
        share(str.islower),
        sum(c in "+/_-=" for c in candidate) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        float(-(counts * np.log2(counts)).sum()),
        words.transitions(candidate),
        words.coverage(candidate),
        near["begins"],
        near["before"],
        near["after"],
        near["path"],
        float(before.rstrip(" \"'")[-1:] in ("=", ":") if before else 0),
        float(before[-1:] in ('"', "'") and after[:1] in ('"', "'")),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate))),
    ]


class Forest:
    """Binary classification trees on bootstrap samples, with a random choice of features at each split."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], share: float):
        self.trees, self.share = trees, share

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or not 0 < share < 1:
            return Forest([], share)
        draw = np.random.default_rng(seed)
        return Forest([_tree(x, y, draw.integers(0, len(y), len(y)), depth, draw) for _ in range(trees)], share)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean over trees of the share of label 1 in the leaf."""
        if not self.trees or not len(x):
            return np.full(len(x), self.share)
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
            total += value[at]
        return total / len(self.trees)


def _tree(x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == 0 or len(rows) < 2 * LEAST_LEAF or nodes[at][4] in (0.0, 1.0):
            return at
        best = None
        for f in draw.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            n, ones = np.arange(1, len(v)), np.cumsum(t)[:-1]
            ok = (v[1:] > v[:-1]) & (n >= LEAST_LEAF) & (len(v) - n >= LEAST_LEAF)
            if not ok.any():
                continue
            p, q = ones / n, (t.sum() - ones) / (len(v) - n)
            gini = np.where(ok, n * p * (1 - p) + (len(v) - n) * q * (1 - q), np.inf)
            k = int(np.argmin(gini))
            if best is None or gini[k] < best[0]:
                best = (gini[k], int(f), (v[k] + v[k + 1]) / 2)
        if best is None:
            return at
        _, f, cut = best
        below = x[rows, f] <= cut
        nodes[at][:2] = [f, cut]
        nodes[at][2] = grow(rows[below], depth - 1)
        nodes[at][3] = grow(rows[~below], depth - 1)
        return at

    grow(rows, depth)
    f, cut, left, right, value = zip(*nodes, strict=True)
    return np.array(f, int), np.array(cut), np.array(left, int), np.array(right, int), np.array(value)


def labelled_examples(n: int = 3000, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label): n findings of known kinds, half of them secrets."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: "".join(r.choice(["ka", "to", "the", "in", "er", "on", "st", "re", "an", "sha", "mi"]) for _ in range(r.randint(1, 4)))
    named = ["config", "service", "report", "invoice", "summary", "backup", "release", "version", "archive", "customer", "session", "package"]
    out = []
    for k in range(n):
        path = r.choice(["src/app", "deploy", "conf", "src1", "src7", "web", "news"])
        quote = r.choice(['"', "'", ""])
        if k % 2:
            kind = r.randrange(6)
            if kind == 0:
                out.append((("AKIA" + some(upper + digits, 16)), f"{word()} {r.choice(['', 'key ', 'access_key = '])}", f" {word()}", path, 1))
            elif kind == 1:
                out.append((some("0123456789abcdef", r.choice([16, 18, 20, 32, 40])), f"{word()} {r.choice(['password', 'passwd', 'pwd', 'secret'])}{r.choice(['=', ': ', ' = '])}{quote}", f"{quote} {word()}", path, 1))
            elif kind == 2:
                out.append((some("0123456789abcdef", r.choice([32, 40, 64])), f"{word()} {r.choice(['token', 'auth_token', 'api_key', 'credential'])}{r.choice(['=', ': ', ' = '])}{quote}", f"{quote} {word()}", path, 1))
            elif kind == 3:
                out.append((r.choice(["ghp_", "sk_live_", "xoxb-", "AIza"]) + some(lower + upper + digits, r.randint(24, 40)), f"{word()} ", f" {word()}", path, 1))
            elif kind == 4:
                out.append((r.choice(digits) + some(lower + upper + digits, r.randint(7, 15)), f"{word()} {r.choice(['password', 'passwd', 'pwd'])}{r.choice(['=', ': ', ' = '])}{quote}", f"{quote} {word()}", path, 1))
            else:
                out.append((some(lower + upper + digits + "+/", r.randint(24, 60)), f"{r.choice(['secret', 'access_key', 'token'])} = {quote}", quote, path, 1))
        else:
            kind = r.randrange(9)
            if kind == 0:
                out.append((some("0123456789abcdef", r.choice([32, 40, 64])), f"{word()} {r.choice(['sha256', 'md5', 'commit', 'checksum', 'etag', 'integrity'])}{r.choice([' ', ': ', '='])}{quote}", f"{quote} {word()}", path, 0))
            elif kind == 1:
                h = some("0123456789abcdef", 32)
                out.append((f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{r.choice(['uuid', 'id', 'request'])}{r.choice([' ', '=', ': '])}", f" {word()}", path, 0))
            elif kind == 2:
                out.append(("/".join(r.choice(named) for _ in range(r.randint(2, 4))) + f"/{r.randint(1, 2030)}", f"{word()} ", f" {word()}", path, 0))
            elif kind == 3:
                out.append(("_".join(r.choice(named) for _ in range(r.randint(2, 4))) + f"_{r.randint(1, 2030)}", f"{word()} ", f" {word()}", path, 0))
            elif kind == 4:
                out.append((some(digits, r.randint(16, 22)), f"{word()} {r.choice(['', 'no ', 'order '])}", f" {word()}", path, 0))
            elif kind == 5:
                out.append(("".join(r.choice(["th", "on", "er", "ke", "mi", "tion", "ing", "ent", "aux"]) for _ in range(r.randint(8, 12))), f"{word()} ", f" {word()}", path, 0))
            elif kind == 6:
                out.append((f"{some(digits, 3)}-{some(digits, 4)}", f"{word()} +{r.randint(1, 99)} ({some(digits, 3)}) ", f" {word()}", path, 0))
            elif kind == 7:
                out.append((f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{word()} {r.choice(['', 'on ', 'date: '])}", f" {word()}", path, 0))
            else:
                out.append((some(lower + upper + digits, r.randint(20, 40)), f"{r.choice(['example token: ', 'dummy secret = ', 'sample key ', 'https://host/'])}", f" {word()}", r.choice(["tests", "docs", "fixtures"]), 0))
    return out


def train(findings: DataFrame, words: Words, max_train: int = MAX_TRAIN) -> tuple[Forest, Neighbours]:
    """findings: candidate, before, after, path, label."""
    picked = findings.filter("candidate is not null and candidate <> '' and label is not null").select("candidate", *(F.coalesce(c, F.lit("")) for c in ("before", "after", "path")), F.col("label").cast("int"))
    share = min(1.0, max_train / max(1, picked.count()))
    rows = sorted(map(tuple, picked.filter(F.pmod(F.xxhash64(*picked.columns), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).collect()))
    neighbours = Neighbours.fit(rows)
    x = np.array([features(words, neighbours, *r[:4]) for r in rows]) if rows else np.zeros((0, len(FEATURES)))
    return Forest.fit(x, np.array([r[4] for r in rows], float)), neighbours


def scan(
    df: DataFrame,
    findings: DataFrame,
    dictionary_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    threshold: float = 0.5,
    with_candidate: bool = False,
) -> DataFrame:
    """One row per candidate: id, start, end (code points, end exclusive), score, is_secret, and with_candidate the text itself."""
    forest, neighbours = train(findings, Words.load(dictionary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or Words.load(dictionary_path)
            ids, starts, ends, found, x = [], [], [], [], []
            for i, text, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                for m in CANDIDATE.finditer(text):
                    ids.append(i)
                    starts.append(m.start())
                    ends.append(m.end())
                    found.append(m.group())
                    x.append(features(words, neighbours, m.group(), text[max(0, m.start() - AROUND) : m.start()].rpartition("\n")[2], text[m.end() : m.end() + AROUND].partition("\n")[0], path or ""))
            score = forest.score(np.array(x).reshape(-1, len(FEATURES)))
            columns = [pa.array(ids, batch.column(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_())]
            names = [id_col, "start", "end", "score", "is_secret"]
            if with_candidate:
                columns.append(pa.array(found, pa.string()))
                names.append("candidate")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, start long, end long, score double, is_secret boolean" + (", candidate string" if with_candidate else "")
    picked = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    return picked.mapInArrow(run, schema)
