"""Streaming ingestion of a public corpus into the triple store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilmill.sources.corpus import cap_by_id, corpus_filter
from veilmill.sources.store import read_store, upsert_triples, with_key

CORPUS_SCHEMA = "doc_id bigint, text string, lang string"


def stream_corpus(
    spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA, files_per_trigger: int = 16
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def stream_ingest(
    corpus: DataFrame,
    embedded: Callable[[DataFrame], DataFrame],
    store_path: str,
    accepted_path: str,
    checkpoint: str,
    max_chars: int = 10_000,
    lang: str | None = "en",
    max_docs: int | None = None,
) -> StreamingQuery:
    """Filter each micro-batch, turn it into embedded triples and upsert them.

    ``embedded`` maps documents to rows with ``triple`` and ``vec``.  The ids of accepted
    documents go to ``accepted_path``, one sub-folder per batch; they carry the global cap and
    the totals.  Both writes can be repeated, so a batch replayed after a failure leaves the
    same tables.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = corpus_filter(batch, max_chars, lang)
        if max_docs is not None:
            kept = cap_by_id(kept, max(0, max_docs - _accepted_before(spark, accepted_path, batch_id)))
        kept.select("doc_id").write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        upsert_triples(with_key(embedded(kept)), store_path)

    return (
        corpus.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _accepted_before(spark: SparkSession, path: str, batch_id: int) -> int:
    if batch_id == 0:
        return 0
    accepted = spark.read.schema("doc_id bigint, batch bigint").parquet(path)
    return accepted.filter(accepted.batch < batch_id).count()


def ingest_stats(spark: SparkSession, store_path: str, accepted_path: str) -> DataFrame:
    """One row: documents accepted and triples stored so far."""
    docs = spark.read.schema("doc_id bigint, batch bigint").parquet(accepted_path)
    triples = read_store(spark, store_path)
    marks = docs.select(F.lit(1).alias("d"), F.lit(0).alias("t")).unionAll(
        triples.select(F.lit(0).alias("d"), F.lit(1).alias("t"))
    )
    return marks.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("triples"),
    )
