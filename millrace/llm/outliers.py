"""Quality rules and robust multivariate outliers.

Rules first: too few words, or too many words in repeated three-word windows. Rows
that pass them are grouped by language and source, and each group gets a
minimum-covariance-determinant estimate of its transformed statistics: from two
starts (medians with quartile widths, and spatial signs), concentration steps take
mean and covariance of the h share of rows with the least Mahalanobis distance, until
the last step; the start with the smaller determinant wins and is reweighted. Rows
farther than a chi-square quantile are rejected.

A step is one aggregation: rows are binned by distance (64 bins for a factor e) and
each bin keeps its count, sums and cross-products, so that a group of any size
arrives as some hundred rows. Groups with fewer than MIN_GROUP rows, too few for a
covariance of their own, are judged by the estimate of all rows of their language, or
where these are fewer too, of all rows. To each variance the square of a least standard
deviation is added, so that copies and constant statistics can't make a covariance
singular. Medians and quartiles are read from counts on a grid of 1/GRID, so that they
don't depend on the order of rows.

Definitions for odd input: a null text counts as empty (no words, base_failed); null
language or source is a group like any other; ties and repeated rows share a
distance and so a verdict; texts of any length are counted whole; an empty table gives an
empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, session_of
from millrace.llm.docstats import counts

COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics and the least standard deviation each is given.
FEATURES = {"words": 0.5, "word_length": 0.06, "symbols": 0.06, "dup_lines": 0.12, "repeats": 0.12, "upper": 0.05}
P = len(FEATURES)
SHARE, STEPS, MIN_GROUP, TAIL = 0.75, 3, 200, 1e-12
PER_E, GRID = 64, 512


def chi2_quantile(p: int, upper_tail: float) -> float:
    """Wilson-Hilferty approximation."""
    from statistics import NormalDist

    z = -NormalDist().inv_cdf(upper_tail)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def chi2_cdf(p: int, x: float) -> float:
    """For even p, in closed form."""
    term, total = 1.0, 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def transformed(c: dict[str, float]) -> list[float]:
    words = max(1, c["n_words"])
    return [
        math.log1p(c["n_words"]),
        math.log1p(c["word_chars"] / words),
        math.sqrt(c["n_symbols"] / words),
        math.sqrt(c["n_dup_lines"] / max(1, c["n_lines"])),
        math.sqrt(c["n_repeat_words"] / words),
        math.sqrt(c["n_upper"] / max(1, c["n_chars"])),
    ]


def statistics(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [counts(t.as_py()) for t in batch.column(3)]
            columns = [*batch.columns[:3], *(pa.array([c[k] for c in every], pa.int64()) for k in COUNTERS), pa.array([transformed(c) for c in every], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", "source", *COUNTERS, "x"])

    kind = dict(df.dtypes)[id_col]
    picked = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTERS) + ", x array<double>")


def _grouped(stats: DataFrame, min_group: int) -> tuple[DataFrame, DataFrame]:
    """lang, source, gid: the group whose estimate holds for the pair; and lang, source, gid: each group in whose estimate the pair's rows count."""
    sizes = stats.filter("not base_failed").groupBy("lang", "source").count()
    own = F.concat(F.lit("source "), F.to_json(F.struct("lang", "source")))
    lang = F.concat(F.lit("lang "), F.to_json(F.struct("lang")))
    pooled = sizes.groupBy(lang.alias("lang_gid")).agg(F.sum("count").alias("pooled"))
    named = sizes.withColumn("lang_gid", lang).join(pooled, "lang_gid")
    gid = F.when(F.col("count") >= min_group, own).when(F.col("pooled") >= min_group, F.col("lang_gid")).otherwise("all")
    judged = named.select("lang", "source", "lang_gid", gid.alias("gid"))
    used = judged.select("gid").distinct()
    counted = named.select("lang", "source", F.explode(F.array(own, "lang_gid", F.lit("all"))).alias("gid")).join(used, "gid", "left_semi")
    return judged.select("lang", "source", "gid"), counted.select("lang", "source", "gid")


def _distance(x: Column, mean: Column, precision: Column) -> Column:
    z = [x[i] - mean[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        total = total + precision[i * P + i] * z[i] * z[i]
        for j in range(i):
            total = total + 2 * precision[i * P + j] * z[i] * z[j]
    return F.greatest(total, F.lit(0.0))


def _bins(rows: DataFrame, params: DataFrame) -> DataFrame:
    """gid, start, bin, count, sums, products, all: the rows of each group by their distance from its estimate."""
    far = rows.join(params.select("gid", "start", "mean", "precision"), "gid").withColumn("bin", F.floor(F.log1p(_distance(F.col("x"), F.col("mean"), F.col("precision"))) * PER_E).cast("int"))
    sums = [F.sum(F.col("x")[i]) for i in range(P)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(P) for j in range(i + 1)]
    return far.groupBy("gid", "start", "bin").agg(F.count("*").alias("count"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))


PARAMS = "gid string, start int, mean array<double>, precision array<double>, logdet double"


def _params(gid: str, start: int, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    cov = cov + np.diag(np.square(list(FEATURES.values())))
    return pd.DataFrame([{"gid": gid, "start": start, "mean": mean.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(), "logdet": float(np.linalg.slogdet(cov)[1])}])


def _estimate(bins: pd.DataFrame, below: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and share of the nearest bins: those that hold SHARE of the rows, or those nearer than below."""
    bins = bins.sort_values("bin")
    so_far = bins["count"].cumsum().to_numpy()
    total = so_far[-1]
    last = int(np.searchsorted(so_far, math.ceil(SHARE * total))) if below is None else int(np.searchsorted(bins["bin"].to_numpy(), math.floor(math.log1p(below) * PER_E), "right")) - 1
    near = bins.iloc[: max(last, int(np.searchsorted(so_far, math.ceil(total / 2)))) + 1]
    n = near["count"].sum()
    mean = np.stack(near["sums"].to_list()).sum(0) / n
    lower = np.stack(near["products"].to_list()).sum(0) / n
    second = np.zeros((P, P))
    second[np.tril_indices(P)] = lower
    second = second + np.tril(second, -1).T
    return mean, second - np.outer(mean, mean), n / total


def _consistent(cov: np.ndarray, share: float) -> np.ndarray:
    """Scaled as if the rows left out were the tail of a normal distribution."""
    if share > 0.999:
        return cov
    return cov * (share / max(chi2_cdf(P + 2, chi2_quantile(P, 1 - share)), 1e-3))


def _step(bins: pd.DataFrame) -> pd.DataFrame:
    mean, cov, share = _estimate(bins, None)
    return _params(bins["gid"].iloc[0], int(bins["start"].iloc[0]), mean, _consistent(cov, share))


def _reweight(bins: pd.DataFrame) -> pd.DataFrame:
    mean, cov, share = _estimate(bins, chi2_quantile(P, 0.025))
    return _params(bins["gid"].iloc[0], int(bins["start"].iloc[0]), mean, _consistent(cov, max(share, 0.975)))


def _starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Start 0: medians and quartile widths; start 1: the same with the correlation of the spatial signs."""
    cells = rows.select("gid", F.posexplode("x").alias("i", "v")).groupBy("gid", "i", F.floor(F.col("v") * GRID).alias("cell")).agg(F.count("*").alias("held"))
    by = Window.partitionBy("gid", "i")
    ranked = cells.withColumn("upto", F.sum("held").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("every", F.sum("held").over(by))
    at = lambda share: ((F.min(F.when(F.col("upto") >= F.col("every") * share, F.col("cell"))) + 0.5) / GRID).alias(f"q{int(100 * share)}")
    quartiles = ranked.groupBy("gid", "i").agg(at(0.25), at(0.5), at(0.75))
    floors = F.array(*map(F.lit, FEATURES.values()))
    scale = F.greatest((F.col("q75") - F.col("q25")) / 1.349, F.get(floors, F.col("i")))
    each = quartiles.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("i", F.col("q50").alias("mid"), scale.alias("scale")))).alias("each"))
    wide = scratch.keep(each.select("gid", F.col("each.mid").alias("mid"), F.col("each.scale").alias("scale")), "quartiles")
    z = [(F.col("x")[i] - F.col("mid")[i]) / F.col("scale")[i] for i in range(P)]
    length = F.greatest(F.sqrt(sum((v * v for v in z), F.lit(0.0))), F.lit(1e-9))
    signs = rows.join(wide, "gid").select("gid", "mid", "scale", F.array(*[v / length for v in z]).alias("u"))
    products = [F.sum(F.col("u")[i] * F.col("u")[j]) for i in range(P) for j in range(i + 1)]
    summed = signs.groupBy("gid").agg(F.first("mid").alias("mid"), F.first("scale").alias("scale"), F.array(*products).alias("products"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        mid, scale = np.array(row["mid"]), np.array(row["scale"])
        s = np.zeros((P, P))
        s[np.tril_indices(P)] = row["products"]
        s = s + np.tril(s, -1).T
        d = np.sqrt(np.maximum(np.diag(s), 1e-9))
        correlation = s / np.outer(d, d)
        return pd.concat([_params(row["gid"], 0, mid, np.diag(scale**2)), _params(row["gid"], 1, mid, correlation * np.outer(scale, scale))])

    return summed.groupBy("gid").applyInPandas(run, PARAMS)


def robust_outliers(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    steps: int = STEPS,
    min_group: int = MIN_GROUP,
    tail: float = TAIL,
) -> DataFrame:
    """Per row of df: id, the counters, base_failed, kept and distance (squared; null if base_failed)."""
    scratch = Scratch(session_of(df), "mcd")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    stats = scratch.keep(statistics(df, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed), "stats")
    groups, counted = (scratch.keep(g, "groups") for g in _grouped(stats, min_group))
    named = stats.alias("s").join(groups.alias("g"), F.expr("s.lang <=> g.lang and s.source <=> g.source"), "left").select("s.*", "g.gid")
    named = scratch.keep(named, "named")
    scratch.drop(stats)
    rows = named.filter("not base_failed").alias("s").join(counted.alias("g"), F.expr("s.lang <=> g.lang and s.source <=> g.source")).select("g.gid", "s.x")
    params = scratch.keep(_starts(rows, scratch), "start")
    for _ in range(steps):
        params = scratch.keep(_bins(rows, params).groupBy("gid", "start").applyInPandas(_step, PARAMS), "step")
    best = params.groupBy("gid").agg(F.min(F.struct("logdet", "start", "mean", "precision")).alias("b")).select("gid", "b.start", "b.mean", "b.precision")
    best = scratch.keep(best, "best")
    final = scratch.keep(_bins(rows, best).groupBy("gid", "start").applyInPandas(_reweight, PARAMS), "final")
    far = F.when(~F.col("base_failed"), _distance(F.col("x"), F.col("mean"), F.col("precision")))
    judged = named.join(final.select("gid", "mean", "precision"), "gid", "left").withColumn("distance", far)
    inside = F.coalesce(F.col("distance") <= chi2_quantile(P, tail), F.lit(False))
    return judged.select(F.col("id").alias(id_col), *COUNTERS, "base_failed", inside.alias("kept"), "distance")
