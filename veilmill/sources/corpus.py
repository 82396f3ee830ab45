"""Reading corpora and private datasets, and the corpus filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmill.functions.rng import hash_pair
from veilmill.session import cut_lineage

CUT_BUCKETS = 4096


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset keeps its text, and the columns a later evaluation needs."""

    name: str
    text_col: str = "text"
    id_col: str | None = None
    utility_col: str | None = None
    label_col: str | None = None


# The private datasets and their column names.
DATASETS = {
    spec.name: spec
    for spec in (
        DatasetSpec("reuters", label_col="author"),
        DatasetSpec("spookyauthor", label_col="author"),
        DatasetSpec("trustpilot", utility_col="sentiment", label_col="gender"),
        DatasetSpec("yelp", text_col="review", utility_col="sentiment", label_col="user_id"),
        DatasetSpec("reddit-mental-health", label_col="author_id"),
        DatasetSpec("imdb10k"),
        DatasetSpec("docnli", text_col="premise"),
    )
}


def content_digest(values: list[Column]) -> Column:
    """md5 of values with their lengths, so that no two rows of different values share a text."""
    def part(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.md5(F.concat(*[part(v) for v in values]))


def normalize_dataset(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """``(dataset, doc_id, text)`` followed by the remaining columns.

    Without an id column rows get 63 bits of md5 of their content and their number among equal
    rows, the same in any packing of the files and on any number of cores.
    """
    rest = [c for c in df.columns if c not in (spec.text_col, spec.id_col)]
    if spec.id_col:
        row_id = F.col(spec.id_col)
    else:
        df = df.withColumn("_content", content_digest([F.col(c) for c in (spec.text_col, *rest)]))
        df = df.withColumn("_occurrence", F.row_number().over(Window.partitionBy("_content").orderBy("_content")))
        digest = F.concat_ws("/", "_content", "_occurrence")
        row_id = F.shiftrightunsigned(hash_pair(digest)[0], 1)
    return df.select(
        F.lit(spec.name).alias("dataset"),
        row_id.cast("bigint").alias("doc_id"),
        F.col(spec.text_col).alias("text"),
        *rest,
    )


def read_dataset(
    spark: SparkSession,
    path: str,
    spec: DatasetSpec | str,
    fmt: str = "parquet",
    schema=None,
    multiline: bool = True,
) -> DataFrame:
    """Read one private dataset from Parquet or CSV.

    CSV fields may hold line breaks, for which a file is one task; where none do,
    ``multiline=False`` lets Spark split large files.
    """
    spec = DATASETS[spec] if isinstance(spec, str) else spec
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multiline, quote='"', escape='"')
    return normalize_dataset(reader.load(path), spec)


def corpus_filter(
    docs: DataFrame,
    max_chars: int = 10_000,
    lang: str | None = "en",
    max_docs: int | None = None,
) -> DataFrame:
    """Keep short documents of one language, and at most ``max_docs`` of those accepted."""
    kept = docs.filter(F.length("text") <= max_chars)
    if lang is not None:
        kept = kept.filter(F.col("lang") == lang)
    return kept if max_docs is None else cap_by_id(kept, max_docs)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rebalance an input that arrives in fewer partitions than there are cores.

    Meant for few or unsplittable files ahead of costly narrow steps; a large table already has
    more splits than cores and passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cap_by_id(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` rows with the smallest ids, as a plain filter on a threshold id.

    A sort-and-limit would pass ``n`` rows through one task.  Here the n-th smallest id is
    located by counting ids per equal-width bucket and descending into the bucket that holds
    it; the driver sees at most CUT_BUCKETS counts per descent.  Ids must be unique.
    """
    ids = cut_lineage(df.select(F.col(id_col).cast("bigint").alias("id")), "ids")
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if total <= n:
        return df
    if n <= 0:
        return df.filter(F.lit(False))
    missing = n
    while low < high:
        width = (high - low) // CUT_BUCKETS + 1
        counts = (
            ids.filter(F.col("id").between(low, high))
            .groupBy(F.expr(f"(id - {low}L) div {width}L").alias("bucket"))
            .count()
            .orderBy("bucket")
            .collect()
        )
        for bucket, count in counts:
            if missing <= count:
                low = low + bucket * width
                high = min(low + width - 1, high)
                break
            missing -= count
    return df.filter(F.col(id_col) <= low)
