"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import documents, table


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.outliers import robust_outliers

    return robust_outliers(documents(spark, sf_dir))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mixture

    return mixture(documents(spark, sf_dir))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.secret_forest import labelled_examples, scan

    findings = spark.createDataFrame(labelled_examples(), "candidate string, before string, after string, path string, label int")
    return scan(documents(spark, sf_dir), findings, public_tokenizers.path("word_bpe_49k.json"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.bpe_tree import encode_decode

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.line_winnow import drop_repeated_lines

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_repeated_lines(docs)


def op6_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.media_archive import media_columns

    return media_columns(documents(spark, sf_dir))


def op7_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.hamming_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir), n=2)


def op8_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.lattice_lm import lattice_scores

    return lattice_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.rff_quality import classify

    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.disclosure import sanitise

    return sanitise(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_robust_outliers, op2_temperature_mixing, op3_secret_forest, op4_bpe_tree, op5_line_winnowing, op6_media_archives, op7_hamming_near_duplicates, op8_lattice_likelihood, op9_quality_classifier, op10_disclosure_sanitisation)}


#: All pairs that share a shingle, and what is reachable over the links.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1
), s AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id
), x AS (
  SELECT doc_id, n, g FROM g JOIN s USING (doc_id)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
), e AS (
  SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON r.other = both_ways.a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


#: All windows of 50 words and all lines of 5 words at 20 places, without fingerprints; the first place of each stays.
LINES_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS p FROM documents WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), n AS (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)
), l AS (
  SELECT doc_id, k, regexp_extract_all(ls[k], '[^\x20\x09-\x0D]+') AS w FROM n
), placed AS (
  SELECT doc_id, k, len(w) AS c, array_to_string(w, ' ') AS s, (1 + sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) - len(w))::BIGINT AS i FROM l
), f AS (
  SELECT doc_id, i, 50 AS c, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place, 2 AS places FROM win
  UNION ALL
  SELECT doc_id, i, c, row_number() OVER (PARTITION BY s ORDER BY doc_id, i), if(count(*) OVER (PARTITION BY s) >= 20, 2, 1) FROM placed WHERE c >= 5
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + c)) AS k FROM f WHERE place > 1 AND places > 1
), runs AS (
  SELECT doc_id, min(k) - 1 AS a, max(k) AS b FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM gone) GROUP BY doc_id, run
), removed AS (
  SELECT doc_id, string_agg(a::BIGINT || '-' || b::BIGINT, ',' ORDER BY a) AS removed, sum(b - a)::BIGINT AS n_removed FROM runs GROUP BY doc_id
), kept AS (
  SELECT u.doc_id, string_agg(p, '' ORDER BY u.k) AS text FROM (SELECT doc_id, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS k FROM d) u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.k = gone.k GROUP BY u.doc_id
)
SELECT x.doc_id, CASE WHEN n_removed IS NULL THEN x.text WHEN kept.text IS NULL THEN '' ELSE regexp_extract(x.text, '^[\x20\x09-\x0D]*') || kept.text END AS text,
  coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents x LEFT JOIN d ON x.doc_id = d.doc_id LEFT JOIN removed ON x.doc_id = removed.doc_id LEFT JOIN kept ON x.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_winnowing": LINES_SQL, "op7_hamming_near_duplicates": NEAR_SQL}
