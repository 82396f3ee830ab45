"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and n rows is repeated w * target_rows / n times on average.  Each
row draws its own count: a keyed hash of its id gives a uniform number, and the count is the point where
the distribution function of the Poisson distribution with that mean passes it.  A mean above
``LARGEST_MEAN`` is the sum of equal smaller ones with a draw each.  The row is exploded by its count, and copies are ordered by a keyed hash of id and copy number: a global shuffle.

Every draw depends on the seed and the row alone, so a task that runs again gives the same rows.  No row
of a large source meets another: the only exchange of texts is the shuffle that is asked for.

Defined results: a null source is a source of its own, null ids count as the empty text.  Rows with equal
ids get equal counts.  Sources without a weight get none, weights for absent sources are left out and
the rest scaled up.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.session import cut_lineage

TEMPERATURE = 0.5  #: default target: shares in proportion to this power of the row counts
LARGEST_MEAN = 500.0  #: bounds the table of the distribution function; larger means are drawn in parts


def uniform(seed: str, *parts: Column) -> Column:
    """52 bits of an md5 of seed and parts, as a number from 0 up to 1."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def distribution(mean: Column) -> Column:
    """P(X <= k) of the Poisson distribution for k = 0, 1, ... far into the tail."""
    last = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["all"])


def rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, target_rows: Column | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, n_rows, mean``: how often a row of each source is wanted.

    ``weights`` has columns ``source, weight``; without it they are row counts to the power
    ``temperature``.  ``target_rows`` is an expression over ``n_all``, the rows of the corpus by default.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(w, counts.source.eqNullSafe(w._source)).drop("_source").where("weight > 0")
    total = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("n_all"))
    rows = F.col("n_all") if target_rows is None else target_rows
    mean = F.col("weight") / F.col("all_weight") * rows / F.col("n_rows")
    # One row of totals, known to be one, is added to each source.
    return counts.crossJoin(F.broadcast(total)).select("source", "n_rows", mean.cast("double").alias("mean"))


def replicate(docs: DataFrame, wanted: DataFrame, seed: str, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Each row as often as it drew: all columns, and ``_copy`` (from 1), ``_n_copies``, ``_mean``."""
    # Written first: with the size known Spark broadcasts it while it is small, and else joins by source.
    parts = F.greatest(F.ceil(F.col("mean") / LARGEST_MEAN), F.lit(1)).cast("int")
    table = cut_lineage(
        wanted.select(
            F.col("source").alias("_source"), F.col("mean").alias("_mean"), parts.alias("_parts"),
            distribution(F.col("mean") / parts).alias("_below"),
        ), "rates"
    )
    drawn = docs.join(table, docs[source].eqNullSafe(F.col("_source"))).withColumn("_u", uniform(seed, F.col(doc_id)))
    first = F.size(F.filter("_below", lambda x: x <= F.col("_u")))

    def add(acc: Column, part: Column) -> Column:
        u = uniform(f"{seed}/part", F.col(doc_id), part)
        return acc + F.size(F.filter("_below", lambda x: x <= u))

    others = F.aggregate(F.sequence(F.lit(2), F.col("_parts")), first, add)
    counted = drawn.withColumn("_n_copies", F.when(F.col("_parts") > 1, others).otherwise(first))
    kept = counted.where("_n_copies > 0").drop("_below", "_u", "_source", "_parts")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n_copies"))))


def shuffled(copies: DataFrame, seed: str, doc_id: str = "doc_id") -> DataFrame:
    """All copies in the order of a keyed hash."""
    return copies.withColumn("_at", uniform(f"{seed}/order", F.col(doc_id), F.col("_copy"))).orderBy("_at", F.col(doc_id), "_copy")


def mix(docs: DataFrame, seed: str, weights: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The mixed corpus, in shuffled order, with the columns of ``docs``."""
    wanted = rates(docs, weights=weights, temperature=temperature)
    return shuffled(replicate(docs, wanted, seed), seed).select(*docs.columns)


def mixture(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id, source, copy, n_copies, mean, text`` of the mixed corpus."""
    rows = docs.select("doc_id", "source", "text")
    return shuffled(replicate(rows, rates(rows), seed), seed).select(
        "doc_id", "source", F.col("_copy").alias("copy"), F.col("_n_copies").alias("n_copies"),
        F.round("_mean", 6).alias("mean"), "text",
    )


def mixture_sql(seed: str, temperature: float = TEMPERATURE, documents: str = "documents") -> str:
    """DuckDB's rows of ``mixture``: the distribution is summed up in logarithms term by term."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n_rows FROM {documents} GROUP BY source),
means AS (
  SELECT source, power(n_rows::DOUBLE, {temperature}) / sum(power(n_rows::DOUBLE, {temperature})) OVER ()
         * sum(n_rows) OVER () / n_rows AS mean
  FROM counts),
steps AS (
  SELECT source, mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p
  FROM means, range(0, 700) AS r(k) WHERE k <= ceil(mean + 10 * sqrt(mean) + 30)),
below AS (SELECT source, mean, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM steps),
drawn AS (
  SELECT doc_id, source, text,
         ('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM {documents}),
counted AS (
  SELECT d.*, (SELECT count(*) FROM below b WHERE b.source IS NOT DISTINCT FROM d.source AND b.f <= d.u) AS n_copies,
         m.mean
  FROM drawn d JOIN means m ON m.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, c.copy::INTEGER AS copy, n_copies::INTEGER AS n_copies, round(mean, 6) AS mean, text
FROM counted, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy) AS c
"""
