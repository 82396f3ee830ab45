"""How far the sources of a language differ in their words, exact and in whole numbers.

Identical texts (same SHA-256) are collapsed within each language to one row with its multiplicity in every
source; a text is tokenized once, and its counts and document frequencies are added weighted by those
multiplicities.  Sums are taken before each exchange, so a source or a text that holds a third of all rows
is no hot spot.

Pairs of sources are evaluated sparsely.  With ``z`` the probability of a word that a group lacks, the sum over
all kept terms is

    sum f(p, z') over the words of one  +  sum f(z, p') over those of the other
    +  sum [f(p, p') - f(p, z') - f(z, p')] over the words of both  +  f(z, z') times the number of the rest.

The first two sums need only a histogram of counts for each group; the third joins on words that two sources
share and is added up within each task before it leaves.

Defined results: null text, lang and source count as ''.  A group without any kept term has ``z`` for every word.
A language without kept terms gives pairs of value 0 and no terms.  Repeated rows count as often as they occur.
Sums stay within 64 bits for up to a thousand million kept terms of a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmill.session import cut_lineage

HELD = 1 << 19  #: counts that a task holds before it passes them on
FEW_REPEATED = 1 << 22  #: 64-bit hashes of repeated texts that are broadcast, 32 MB
LEAST_DOCUMENTS = 3
TOP = 200
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_UNIT = "cast(1000000000 as decimal(10,0))"


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: letters A-Z, lower-cased, and all that isn't ASCII."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, documents`` of rows ``lang, source, n, digest, text``, added up as far as memory is given.

    The rows of one text, one for each of its sources, follow each other, and are tokenized once.
    """
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            within, size = documents[lang, source], len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, size), pa.repeat(source, size), pa.array(list(found), pa.string()),
                 pa.array(list(found.values()), pa.int64()), pa.array([within[t] for t in found], pa.int64())],
                names=["lang", "source", "term", "n", "documents"],
            )
        counts.clear()
        documents.clear()

    before, words, different = None, [], set()
    for batch in batches:
        for lang, source, times, digest, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (lang, digest) != before:
                before, words = (lang, digest), terms(text)
                different = set(words)
            if times == 1:
                counts[lang, source].update(words)
                documents[lang, source].update(different)
                continue
            all_, within = counts[lang, source], documents[lang, source]
            for term, n in Counter(words).items():
                all_[term] += n * times
                within[term] += times
        if sum(map(len, counts.values())) > HELD:
            yield from flushed()
    yield from flushed()


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, source, n, digest, text``: each text of a language once for every source, and all ``lang, source``.

    While the hashes of repeated texts are few enough to be sent to all tasks, only texts with such a hash are
    exchanged, and the others stay where they are; beyond that all texts are exchanged once.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    counts = cut_lineage(rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")), "multiplicity")
    mark = F.xxhash64("lang", "digest").alias("mark")
    again = counts.groupBy("lang", "digest").agg(F.sum("n").alias("n")).where("n > 1").select(mark).distinct()
    again = cut_lineage(again, "repeated")
    columns = ["lang", "source", "n", "digest", "text"]
    full = rows.where("text <> ''").select("*", mark)

    def together(some: DataFrame) -> DataFrame:
        texts = some.groupBy("lang", "digest").agg(F.first("text").alias("text"))
        return texts.join(counts, ["lang", "digest"]).select(*columns)

    if again.count() <= FEW_REPEATED:
        again = F.broadcast(again)
        once = full.join(again, "mark", "left_anti").withColumn("n", F.lit(1).cast("bigint")).select(*columns)
        rows = once.unionByName(together(full.join(again, "mark", "left_semi")))
    else:
        rows = together(full)
    return rows, counts.select("lang", "source").distinct()


def _probability(count: str) -> Column:
    """One more than the share of a count in ``total`` and ``v`` in thousand-millionths."""
    return F.expr(f"cast(1 + ({_UNIT} * ({count} + 1)) div nullif(total + v, 0) as bigint)")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def counted(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept terms, groups and counts.

    ``lang, term, q``; ``lang, source, v, total, z``; ``lang, source, term, n, p`` of the terms that occur in a group.
    """
    rows, occurring = collapsed(docs)
    parts = rows.mapInArrow(_term_counts, "lang string, source string, term string, n bigint, documents bigint")
    found = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    found = cut_lineage(found, "counts")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    kept = cut_lineage(kept.where(F.col("documents") >= least).select("lang", "term", "n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    q = kept.join(sizes, "lang").select("lang", "term", _probability("n").alias("q"))
    found = found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    groups = (
        occurring
        .join(totals, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "total", "present")))
        .withColumn("z", _probability("0"))
    )
    groups = cut_lineage(groups, "groups")
    found = found.join(groups.drop("present"), ["lang", "source"]).select(
        "lang", "source", "term", "n", _probability("n").alias("p"), "z"
    )
    return q, groups, cut_lineage(found, "probabilities")


def pair_values(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language."""
    def side(mark: str) -> DataFrame:
        return groups.select("lang", *(F.col(c).alias(c + mark) for c in ("source", "z", "present")))

    keys = ["lang", "source_1", "source_2"]
    pairs = groups.select("lang", "v").distinct().join(side("_1"), "lang").join(side("_2"), "lang")
    pairs = pairs.where("source_1 <> source_2")
    counts = found.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    of_first = counts.withColumnRenamed("source", "source_1").join(side("_2"), "lang").select(
        *keys, (F.col("m") * _distance("p", "z_2")).alias("value"), F.lit(0).cast("bigint").alias("both")
    )
    of_second = counts.withColumnRenamed("source", "source_2").join(side("_1"), "lang").select(
        *keys, (F.col("m") * _distance("z_1", "p")).alias("value"), F.lit(0).cast("bigint").alias("both")
    )
    a, b = (
        found.select("lang", "term", *(F.col(c).alias(c + mark) for c in ("source", "p", "z"))) for mark in ("_1", "_2")
    )
    shared = a.join(b, ["lang", "term"]).where("source_1 <> source_2").select(
        *keys, (_distance("p_1", "p_2") - _distance("p_1", "z_2") - _distance("z_1", "p_2")).alias("value"),
        F.lit(1).cast("bigint").alias("both"),
    )
    # Each part is added up before they meet, so that what is joined on words leaves its task as sums.
    parts = [
        x.groupBy(*keys).agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
        for x in (of_first, of_second, shared)
    ]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("source_1 <> source_2").groupBy(*keys).agg(
        F.sum("value").alias("value"), F.sum("both").alias("both")
    )
    rest = F.col("v") - F.col("present_1") - F.col("present_2") + F.coalesce("both", F.lit(0))
    nowhere = F.when(F.col("v") > 0, rest * _distance("z_1", "z_2")).otherwise(0)
    return pairs.join(sums, keys, "left").select(
        "lang", F.col("source_1").alias("source"), F.col("source_2").alias("item"),
        (F.coalesce("value", F.lit(0)) + nowhere).cast("bigint").alias("value"),
    )


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the telling words of each."""
    q, groups, found = counted(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    pairs = pair_values(groups, found).withColumn("rank", ranked)
    telling = found.join(q, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value")
    )
    telling = telling.withColumn("rank", ranked).where(F.col("rank") <= top)
    parts = [
        x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        for part, x in (("pair", pairs), ("term", telling))
    ]
    return parts[0].unionByName(parts[1])


AUDIT_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT lang, source, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM d),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM w)
  GROUP BY lang, term HAVING count(*) >= 3),
c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n
  FROM (SELECT lang, source, unnest(words) AS term FROM w) JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0) + v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
l AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 1)) // (any_value(l.total)::HUGEINT + any_value(v.v)) AS q
  FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
telling AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM telling)
WHERE rank <= 200
"""
