"""Removal of every repeated run of lines of ``LONG_WORDS`` words or more, wherever it stands.

The chunks of ``linechunks`` are cut by content and meet a repeated run only where both of its ends agree.
Here two kinds of windows of lines are added for each line with words: the shortest that begins there and the
shortest that ends there with ``LONG_WORDS`` words or more.  A run that occurs twice holds equal windows over
all its lines: from a line with enough words behind it in the run the one that begins there, for the others
the one that ends at the run's last line.  Equal windows and chunks are found by hash, then compared byte by
byte; lines of all but the first (smallest id, then text hash and line) go.

Hashes are exchanged for all windows; texts only of documents with one whose hash repeats (told by their keys,
broadcast while there are at most ``LIGHT_KEYS``; all texts beyond), and counts before minima, so a
passage in a third of all documents meets in no task.  A window that overlaps the first one of its text keeps
the lines of that first one.

Defined results: null texts stay null, empty texts and single short lines stay as they are.  A text may
become empty; its row stays.  Rows with equal id and text are one document with one result.
``n_removed`` counts runs of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.llm.linechunks import LONG_WORDS, chunks
from veilmill.session import cut_lineage

LIGHT_KEYS = 1 << 22  #: documents whose keys are sent to all tasks


def windows(text: str | None, least: int = LONG_WORDS) -> tuple[list[str], list[tuple[int, int]]]:
    """The lines of a text, and begin and end of its chunks and windows."""
    lines, cut = chunks(text)
    found = {(b, e) for b, e, passage in cut if passage}
    full = [(i, n) for i, line in enumerate(lines) if (n := len(line.split()))]
    upto = [0, *accumulate(n for _, n in full)]
    end = begin = 0
    for k in range(len(full)):
        while end < len(full) and upto[end] - upto[k] < least:
            end += 1
        if upto[end] - upto[k] >= least:
            found.add((full[k][0], full[end - 1][0] + 1))
        while upto[k + 1] - upto[begin + 1] >= least:
            begin += 1
        if upto[k + 1] - upto[begin] >= least:
            found.add((full[begin][0], full[k][0] + 1))
    return lines, sorted(found)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, version, b, e, hash`` of each window of ``id, version, text``."""
    for batch in batches:
        of, begins, ends, hashes = [], [], [], []
        for row, value in enumerate(batch.column(2).to_pylist()):
            if not value:
                continue
            lines, found = windows(value)
            if not found:
                continue
            raw = [x.encode("utf-8", "replace") for x in lines]
            whole = memoryview(b"\n".join(raw))
            at = [0, *accumulate(len(x) + 1 for x in raw)]
            hashes += [xxhash.xxh3_64_intdigest(whole[at[b] : at[e] - 1]) for b, e in found]
            begins += [b for b, _ in found]
            ends += [e for _, e in found]
            of += [row] * len(found)
        rows = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()),
             pa.array(np.array(hashes, np.uint64).view(np.int64))],
            names=["id", "version", "b", "e", "hash"],
        )


def _chunks(texts: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for value, some in zip(texts, places, strict=True):
        lines = value.split("\n")
        out.append([{"b": x["b"], "e": x["e"], "hash": x["hash"], "chunk": "\n".join(lines[x["b"] : x["e"]])} for x in some])
    return pd.Series(out, dtype=object)


def _parted(rows: DataFrame, key: Column, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows that can meet ``found(_id, _version)``, and the others, or all rows and None if too many are found.

    Rows are told by a hash of id and version before any text is exchanged; a join by both follows.
    """
    if found.count() > LIGHT_KEYS:
        return rows, None
    keys = F.broadcast(found.select(F.xxhash64("_id", "_version").alias("_key")).distinct())
    keyed = rows.withColumn("_key", key)
    return tuple(keyed.join(keys, "_key", how).drop("_key") for how in ("left_semi", "left_anti"))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, version`` (hash of the text) and ``places`` (begin and end) of the lines of each document that go."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    hashes = cut_lineage(rows.mapInArrow(_hashes, f"id {kind}, version long, b int, e int, hash long"), "windows")
    at = F.struct(F.col("id").isNull().alias("last"), "id", "version", "b", "e").alias("at")
    ends = [F.min("at").alias("first"), F.max("at").alias("other")]
    more = hashes.groupBy("hash").count().where("count > 1").select("hash")
    hits = hashes.join(more, "hash", "left_semi").groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.collect_set(F.struct("b", "e", "hash")).alias("places")
    )
    hits = cut_lineage(hits, "hits")
    # Equal rows give equal windows, which change neither minima nor what goes.
    cut = F.pandas_udf(_chunks, "array<struct<b:int,e:int,hash:bigint,chunk:string>>")
    some, _ = _parted(rows, F.xxhash64("id", "version"), hits)
    met = some.join(hits, rows["id"].eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    members = met.select("id", "version", F.explode(cut("text", "places")).alias("c")).select("id", "version", "c.*")
    members = cut_lineage(members.select(at, "hash", "chunk"), "passages")
    firsts = members.groupBy("hash", "chunk").agg(*ends).where("first < other").drop("other")
    own = F.col("at.id").eqNullSafe(F.col("first.id")) & (F.col("at.version") == F.col("first.version"))
    begin = F.when(own, F.greatest("at.b", "first.e")).otherwise(F.col("at.b"))
    gone = members.join(firsts, ["hash", "chunk"]).where("at > first").select(
        F.col("at.id").alias("id"), F.col("at.version").alias("version"), begin.alias("b"), F.col("at.e").alias("e")
    )
    return gone.where("b < e").groupBy("id", "version").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("places"))


def without(text: str | None, places: list | None) -> tuple[str | None, int]:
    """The text less the lines at ``places`` (begin and end, sorted), and the number of runs that went."""
    if text is None or places is None or not len(places):
        return text, 0
    lines, kept, at, runs = text.split("\n"), [], 0, 0
    for b, e in places:
        if b > at or not runs:
            kept += lines[at:b]
            runs += 1
        at = max(at, e)
    return "\n".join(kept + lines[at:]), runs


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows with all columns, ``text`` less its repeated passages, and ``_n_removed``."""
    gone = repeated(docs, text, doc_id).select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("places").alias("_places"))
    gone = cut_lineage(gone, "gone")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            pairs = ([(x["b"], x["e"]) for x in p] if p is not None else None for p in places)
            made = [without(t, p) for t, p in zip(texts, pairs, strict=True)]
            yield pd.DataFrame({"text": pd.Series([x for x, _ in made], dtype=object), "n": pd.Series([n for _, n in made], dtype="int32")})

    some, rest = _parted(docs, F.xxhash64(F.col(doc_id), F.xxhash64(text)), gone)
    joined = some.join(gone, some[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(some[text]) == F.col("_version")), "left")
    made = joined.withColumn("_cut", F.pandas_udf(cut, "text string, n int")(F.col(text), F.col("_places")))
    made = made.withColumn(text, F.col("_cut.text")).withColumn("_n_removed", F.col("_cut.n")).drop("_id", "_version", "_places", "_cut")
    return made if rest is None else made.unionByName(rest.withColumn("_n_removed", F.lit(0)))


def shortened(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, text`` of every row."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", F.col("_n_removed").alias("n_removed"), "text")
