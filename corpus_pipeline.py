"""Documents to token counts in five stages: quality, repeated passages, near-duplicates, mixing, tokens.

Each stage takes the rows that its predecessor kept, written as Parquet in between under the shared folder
that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmill.llm import bpe, mixing, passages, quality, simhash
from veilmill.llm.common import table
from veilmill.llm.queries import SEED, vocabulary
from veilmill.session import cut_lineage, ship_package


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  #: texts that go to Python at once, where the session leaves Spark's own number


def stage(function: Stage) -> Stage:
    """A stage that sends texts to Python in batches of bounded size."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH) == "10000":
            spark.conf.set(_BATCH, BATCH_ROWS)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of the texts; ``n_chars`` follows."""
    cut = passages.deduplicated(docs)
    chars = F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*docs.columns)


@stage
def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose SimHash fingerprints are linked."""
    return simhash.keep_first(docs)


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to the target weights of their sources, in shuffled order."""
    return mixing.mix(docs, SEED)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode; one row of digests per copy."""
    return bpe.digests(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("line_dedup", without_passages),
    ("near_dedup", different_documents),
    ("mixing", mixed_sources),
    ("bpe", tokens),
]

#: The classifier, the similarity and the tokens have no SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name)
    return docs
