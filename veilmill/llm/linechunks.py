"""Removal of repeated passages by content-defined chunks of lines.

A text is cut behind each line where a rolling hash over the last two line hashes is a multiple of
``SPACING``, so a passage is cut alike wherever it stands and whatever precedes it.  A line of
``LONG_WORDS`` words or more is a chunk of its own.  Chunks of several lines with words, and long lines,
count as passages.  Hashes that occur once are done with; the texts of the others are compared byte by byte, and of
equal ones only the first (smallest id, then text hash and place) stays.

Only hashes are exchanged for all chunks.  Texts of chunks are exchanged where the hash repeats, first
with a filter by the repeated hashes; counts are added up before the exchange, and the first of each text is
found by a minimum, so a passage in a third of all documents meets in no task.

Defined results: null texts stay null, empty texts and single short lines stay as they are.  A text may
become empty; its row stays.  Rows with equal id and text are one document with one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmill.session import cut_lineage

SPACING = 4  #: lines of a chunk on average
LONG_WORDS = 50  #: words that make a single line a passage
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunks(text: str | None) -> tuple[list[str], list[tuple[int, int, bool]]]:
    """The lines of a text, and begin, end and whether it is a passage, of each chunk of lines."""
    if not text:
        return [], []
    lines = text.split("\n")
    cut, begin, full, previous = [], 0, 0, 0
    for i, line in enumerate(lines):
        words = len(line.split())
        if words >= LONG_WORDS:
            if begin < i:
                cut.append((begin, i, full > 1))
            cut.append((i, i + 1, True))
            begin, full = i + 1, 0
            previous = 0
            continue
        here = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))
        full += words > 0
        if ((previous * _FACTOR + here) & _MASK) % SPACING == 0:
            cut.append((begin, i + 1, full > 1))
            begin, full = i + 1, 0
        previous = here
    if begin < len(lines):
        cut.append((begin, len(lines), full > 1))
    return lines, cut


def without(text: str | None, places: list[int] | None) -> str | None:
    """The text less the chunks at ``places``."""
    if text is None or places is None or not len(places):
        return text
    lines, cut = chunks(text)
    gone = set(places)
    return "\n".join(line for k, (b, e, _) in enumerate(cut) if k not in gone for line in lines[b:e])


def passages(docs: DataFrame, with_text: bool, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``at`` (struct of id, text hash and place, in the order of precedence), ``hash`` and perhaps ``chunk``."""

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for value in batch:
                lines, cut = chunks(value)
                found = []
                for k, (b, e, passage) in enumerate(cut):
                    if passage:
                        chunk = "\n".join(lines[b:e])
                        value_hash = xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "replace"))
                        row = {"place": k, "hash": value_hash - (value_hash >> 63 << 64)}
                        found.append(row | {"chunk": chunk} if with_text else row)
                out.append(found)
            yield pd.Series(out, dtype=object)

    kind = "array<struct<place:int,hash:bigint" + ",chunk:string" * with_text + ">>"
    found = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.explode(F.pandas_udf(rows, kind)(F.col(text))).alias("c")
    )
    at = F.struct(F.col("id").isNull().alias("last"), "id", "version", F.col("c.place").alias("place"))
    return found.select(at.alias("at"), F.col("c.hash").alias("hash"), *([F.col("c.chunk").alias("chunk")] if with_text else []))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, version`` (hash of the text) and ``places`` of the chunks of each document that go."""
    hashes = passages(docs, False, text, doc_id)
    more = hashes.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("other")).where("first < other").select("hash")
    members = cut_lineage(passages(docs, True, text, doc_id).join(more, "hash", "left_semi"), "passages")
    firsts = members.groupBy("hash", "chunk").agg(F.min("at").alias("first"), F.max("at").alias("other")).where("first < other")
    gone = members.join(firsts.drop("other"), ["hash", "chunk"]).where("at > first")
    return gone.groupBy(F.col("at.id").alias("id"), F.col("at.version").alias("version")).agg(
        F.sort_array(F.collect_set("at.place")).alias("places")
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows with all columns, ``text`` less its repeated passages, and ``_n_removed``."""
    gone = repeated(docs, text, doc_id).select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("places").alias("_places"))

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in batches:
            yield pd.Series([without(t, p) for t, p in zip(texts, places, strict=True)], dtype=object)

    joined = docs.join(gone, docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_version")), "left")
    shorter = F.when(F.col("_places").isNotNull(), F.pandas_udf(cut, "string")(F.col(text), F.col("_places"))).otherwise(F.col(text))
    return joined.withColumn(text, shorter).withColumn(
        "_n_removed", F.coalesce(F.size("_places"), F.lit(0))
    ).drop("_id", "_version", "_places")


def shortened(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, text`` of every row."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", F.col("_n_removed").alias("n_removed"), "text")
