"""A bigram language model held in tables, and perplexity against it.

Log probabilities are stored as whole billionths, so that sums do not depend on the order in
which Spark adds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.functions.runs import START, chunks, counted_bigrams
from veilmill.session import cut_lineage, temporary

LIGHT_MODEL = 1 << 21  #: bigrams of a model that is sent to all tasks, about 80 MB
NANO = 1_000_000_000


class NgramModel(NamedTuple):
    """``bigrams(prev, word, n, n_prev, logp)`` and ``histories(prev, n_prev, logp_unseen)``."""

    bigrams: DataFrame
    histories: DataFrame
    vocabulary: int
    k: float


def _nano(probability: Column) -> Column:
    return F.round(F.ln(probability) * F.lit(float(NANO))).cast("bigint")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in chunks(batch):
            _, prev, word, n = counted_bigrams(some["text"], by_text=False)
            yield pa.RecordBatch.from_arrays([prev, word, pa.array(n)], names=["prev", "word", "n"])


def bigram_counts(docs: DataFrame) -> DataFrame:
    """``(prev, word, n)``: counted in chunks of texts, then exchanged, so that no task holds the bigrams of all its texts."""
    pairs = docs.select("text").mapInArrow(_counted, "prev string, word string, n bigint")
    return pairs.repartition("prev", "word").groupBy("prev", "word").agg(F.sum("n").alias("n"))


def train_ngram_lm(docs: DataFrame, k: float = 0.1) -> NgramModel:
    """Count bigrams over whole texts and smooth with ``k``."""
    with temporary(bigram_counts(docs), "bigrams") as counts:
        vocabulary = counts.select("word").distinct().count()
        histories = counts.groupBy("prev").agg(F.sum("n").alias("n_prev"))
        total = F.col("n_prev") + F.lit(k * vocabulary)
        bigrams = counts.join(histories, "prev").select(
            "prev", "word", "n", "n_prev", _nano((F.col("n") + F.lit(k)) / total).alias("logp")
        )
        histories = histories.select("prev", "n_prev", _nano(F.lit(k) / total).alias("logp_unseen"))
        return NgramModel(cut_lineage(bigrams, "lm"), cut_lineage(histories, "lm-histories"), vocabulary, k)


def perplexity(
    texts: DataFrame, lm: NgramModel, ids: list[str], max_tokens: int | None = None
) -> DataFrame:
    """``(*ids, n_words, ppl)`` = exp of the mean negative log likelihood.

    Texts without a word have no row; callers that need them join left and get null.
    """
    kinds = [(c, texts.schema[c].dataType.simpleString()) for c in ids]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch):
                row, prev, word, n = counted_bigrams(some["text"], by_text=True, most=max_tokens)
                kept = [some[c].take(pa.array(row)) for c in ids]
                yield pa.RecordBatch.from_arrays([*kept, prev, word, pa.array(n)], names=[*ids, "prev", "word", "n"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds), "prev string, word string, n bigint"])
    pairs = texts.select(*ids, "text").mapInArrow(counted, schema)
    # The bigrams of a text are counted in its task and meet the model by 64-bit hashes.
    probes = pairs.select(*ids, F.xxhash64("prev", "word").alias("pair"), F.xxhash64("prev").alias("before"), "n")
    known = lm.bigrams.select(F.xxhash64("prev", "word").alias("pair"), "logp")
    histories = lm.histories.select(F.xxhash64("prev").alias("before"), "logp_unseen")
    floor = F.lit(-round(math.log(lm.vocabulary) * NANO) if lm.vocabulary else 0)
    if known.count() <= LIGHT_MODEL:
        found = probes.join(F.broadcast(known), "pair", "left").join(F.broadcast(histories), "before", "left")
        scored = found.select(*ids, (F.coalesce("logp", "logp_unseen", floor) * F.col("n")).alias("total"), "n")
    else:
        # Known bigrams are summed at once; only unknown ones keep their first word and meet its history.
        met = probes.join(known, "pair", "left").withColumn("before", F.when(F.col("logp").isNull(), F.col("before")))
        summed = met.groupBy(*ids, "before").agg(F.sum(F.col("logp") * F.col("n")).alias("total"), F.sum("n").alias("n"))
        summed = cut_lineage(summed, "probes")
        unseen = summed.where("before is not null").drop("total").join(histories, "before", "left")
        scored = summed.where("before is null").select(*ids, "total", "n").unionByName(
            unseen.select(*ids, (F.coalesce("logp_unseen", floor) * F.col("n")).alias("total"), "n")
        )
    return scored.groupBy(*ids).agg(
        F.sum("n").alias("n_words"),
        F.exp(-F.sum("total") / F.sum("n") / F.lit(float(NANO))).alias("ppl"),
    )


def mean_perplexity(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("ppl").alias("mean_ppl"))
