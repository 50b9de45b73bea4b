"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

The statistics of every text are computed once and written as a narrow table. A
Gaussian kernel over the standardised statistics is approximated by random Fourier
features; each partition sums its part of the normal equations, the parts are added,
and one small linear system gives the scores. Part of the training rows, kept out of
the fit, calibrates them: pooling adjacent violators, rows of equal scores first,
gives rising shares of label 1, between whose places scores are read by straight lines.

Training rows are a bounded sample of the labelled rows (MAX_TRAIN, by hash of the
id); scores cover all rows.

Null texts count as empty and are scored like empty texts; repeated rows and equal
texts get equal scores; a row without label, or with a null label, takes no part in
the fit; ids with several labels take their rounded mean, and of several rows of a
labelled id the one with the least statistics is learnt from. Without any usable label
all scores are 0.5. Texts of any length are counted whole; an empty table gives an empty
result. Further columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, crc_mod, session_of
from millrace.llm.docstats import counts, quality_vector

N_STATS = 15
#: Most rows that the fit and the calibration together take.
MAX_TRAIN = 60_000
FEATURES, RIDGE, SEED, FIT_PARTITIONS = 192, 1.0, 20_24, 8


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, steps: tuple[np.ndarray, np.ndarray] | None):
        self.mean, self.scale, self.weights, self.steps = mean, scale, weights, steps

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(w z + b), with w normal: inner products approximate exp(-|z - z'|^2 / (2 width^2))."""
        draw = np.random.default_rng(SEED)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        w = draw.normal(size=(x.shape[1], FEATURES)) / math.sqrt(x.shape[1])
        b = draw.uniform(0, 2 * math.pi, FEATURES)
        return np.hstack([np.cos(z @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.steps is None:
            return np.full(len(x), 0.5)
        at, value = self.steps
        return np.interp(self.raw(x), at, value)


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: centres of the pools and their rising values, kept within 0.001 and 0.999. Rows of one raw score are one pool."""
    distinct, place = np.unique(np.round(raw, 9), return_inverse=True)  # copies' scores may differ in the last bits
    rows, ones = np.bincount(place).astype(float), np.bincount(place, label)
    pools: list[list[float]] = []  # sum of labels, rows, sum of raw
    for r, n, y in zip(distinct, rows, ones, strict=True):
        pools.append([y, n, n * r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y2, n2, r2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2] + r2]
    at = np.array([p[2] / p[1] for p in pools])
    return at, np.clip([p[0] / p[1] for p in pools], 0.001, 0.999)


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, stats: the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [quality_vector(counts(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=[id_col, "stats"])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, stats array<double>")


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and scale of each statistic, summed by Spark."""
    sums = [f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]
    got = rows.agg(F.count("*"), *sums).first()
    if not got[0]:
        return np.zeros(N_STATS), np.ones(N_STATS), 0
    mean, scale = np.array(got[1::2], float), np.array(got[2::2], float)
    return mean, np.where(scale > 0.02, scale, 0.02), got[0]


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y: a sum per partition, of which there are FIT_PARTITIONS, added on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                x = model.features(np.array(batch.column(0).to_pylist()))
                total += x.T @ np.hstack([x, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("stats", F.col("label").cast("double")).coalesce(FIT_PARTITIONS).mapInArrow(run, "part binary").collect()
    total = sum(np.frombuffer(p[0]).reshape(FEATURES + 1, FEATURES + 2) for p in sorted(parts))
    return total[:, :-1], total[:, -1]


def fit(train: DataFrame) -> Model:
    """train: stats, label (0 or 1), part ("fit" or "calibrate"); of bounded size."""
    rows = train.filter("part = 'fit'")
    mean, scale, n = _moments(rows)
    model = Model(mean, scale, None, None)
    if not n:
        return model
    xx, xy = _normal_equations(rows, model)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(xx + penalty, xy)
    held = train.filter("part = 'calibrate'").select("stats", "label").collect() or rows.select("stats", "label").collect()
    held.sort(key=lambda r: (tuple(r[0]), r[1]))
    model.steps = isotonic(model.raw(np.array([r[0] for r in held])), np.array([float(r[1]) for r in held]))
    return model


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch, *, id_col: str, label_col: str, folds: int, held_fold: int, max_train: int) -> Model:
    """The model fitted on the labelled rows of stats outside the held fold; a quarter of them, one fold, calibrates it."""
    fold = crc_mod(F.col(id_col), folds)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = known.filter(fold != held_fold)
    order = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    share = min(1.0, max_train / max(1, known.count()))
    known = known.filter(order < int(share * (1 << 30)))
    calibrate = fold == (held_fold + folds - 1) % folds
    once = stats.join(known, id_col).groupBy(id_col).agg(F.min("stats").alias("stats"), F.first("label").alias("label"))  # rows sharing an id: the least statistics
    train = once.select("stats", "label", F.when(calibrate, "calibrate").otherwise("fit").alias("part"))
    return fit(scratch.keep(train.coalesce(FIT_PARTITIONS), "train"))


def classify(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """Per row of df: id, held_out, score (0 to 1, label 1 likelier), predicted (score >= threshold).

    Rows whose crc32(id as text) mod folds is held_fold are never learnt from.
    """
    scratch = Scratch(session_of(df), "quality")
    stats = scratch.keep(statistics(df, id_col, text_col), "stats")
    model = learn(stats, labels, scratch, id_col=id_col, label_col=label_col, folds=folds, held_fold=held_fold, max_train=max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else [], pa.float64())], names=[id_col, "score"])

    scored = stats.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, score double")
    held_out = crc_mod(F.col(id_col), folds) == held_fold
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """The rows of df that classify() predicts 1 for, with all their columns; each text is scored where it is, so none is shuffled."""
    scratch = Scratch(session_of(df), "quality")
    stats = scratch.keep(statistics(df, id_col, text_col), "stats")
    model = learn(stats, labels, scratch, id_col=id_col, label_col=label_col, folds=folds, held_fold=held_fold, max_train=max_train)
    scratch.drop(stats)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([quality_vector(counts(t.as_py())) for t in batch.column(at)]).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return df.mapInArrow(run, df.schema)
