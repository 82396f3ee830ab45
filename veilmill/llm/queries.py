"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmill.llm import (
    ann, bpe, divergence, langid, licenses, merkle, mixing, passages, quality, rules, sigtrees, simhash,
    surrogates,
)
from veilmill.llm.common import table

SEED = "mixture-1"
KEY = b"a key for the test tables only"  #: a real run takes a secret one


def vocabulary() -> str:
    """The vocabulary file that op8 is asked for."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(table(spark, sf_dir, "documents"), KEY)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), SEED)


def op6_linechunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shortened(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.memberships(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), now={"text": merkle.lowered()})


def op12_sigtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtrees.memberships(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann, op2_langid, op3_quality, op4_surrogates, op5_mixing, op6_linechunks, op7_simhash, op8_bpe,
        op9_licenses, op10_rules, op11_merkle, op12_sigtrees, op13_divergence,
    )
}

RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 7)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, text, words, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(text, '[^!]', '', 'g')) AS bangs,
         len(list_distinct(words)) AS different,
         len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS echoes
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * n_symbols > 5 * word_chars
       AND NOT (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines)
       AND NOT 100 * caps > 40 * word_chars AND NOT 100 * bangs > 5 * word_chars
       AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND NOT 10 * echoes > 3 * n_words AND NOT 20 * different < n_words AS kept
FROM base
"""

ORACLES: dict[str, str] = {
    "op5_mixing": mixing.mixture_sql(SEED),
    "op10_rules": RULES_SQL,
    "op11_merkle": merkle.MANIFEST_SQL,
    "op13_divergence": divergence.AUDIT_SQL,
}
