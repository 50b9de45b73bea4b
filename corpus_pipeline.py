"""From documents to token ids: quality, repeated lines, near duplicates, mixing, byte-level BPE.

Each stage takes all rows that the one before it kept. All but the last return the
columns of documents; the line stage sets n_chars to the new length of the texts that
it changes, and documents that consist of repeated runs alone go. The mixing stage
takes the least budget with which every document is used at least once, so it repeats
documents of small sources and drops none.

Odd input: a null text counts as empty in every stage and is classified as such; rows with
a null id go through lines and near duplicates unchanged; rows sharing an id are one
document to the near duplicates; empty tables give empty tables; columns beyond those of
documents are kept by all stages but the last, whatever their names (n_words, n_removed and
removed excepted, which the line stage would replace).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe_tree import encode_decode
from millrace.llm.common import Scratch, documents, table
from millrace.llm.hamming_join import drop_near_duplicates
from millrace.llm.line_winnow import drop_repeated_lines
from millrace.llm.mixing import mixed
from millrace.llm.rff_quality import accepted

#: Stage 2, 3 and 4: shortest repeated passage, similarity in per cent over shingles of five words, most uses of a document.
MIN_WORDS, PERCENT, SHINGLE, MAX_REPEATS, TARGET_ENTROPY = 50, 80, 5, 2.0, 0.98


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier ones, and lines of many places, are deleted."""
    done = drop_repeated_lines(docs, min_words=MIN_WORDS, keep_emptied=False)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs, n=SHINGLE, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources uses them."""
    return mixed(docs, target_entropy=TARGET_ENTROPY, max_repeats=MAX_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near", near),
    ("mix", mix),
    ("tokens", tokens),
]

#: No SQL: the classifier, the signatures and the tokenizer have no expression in it; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
