"""Near-duplicates by SimHash fingerprints in BK-trees.

A fingerprint bit is set if it is set in more than half of the XXH64 hashes of a text's word shingles.
Different fingerprints (exact copies have one between them) are dealt to shards that any two within
``radius`` bits share: the bits are cut into ``radius + 2`` blocks, of which two at least agree, and
each pair of blocks names a shard.  Every shard gets a BK-tree, children keyed by their distance to the
parent, and is searched with its own members along edges within the radius.  A shard above ``SHARD``
members is split; the tree of each part is then sent to every other part of that shard, never further.

Trees are built and searched for many shards at once, level by level.  A shard gives a spanning forest of
its links, not all pairs, which is all that components need, so copies in thousands make no squares of
rows.  Components are found by distributed star steps.

Defined results: a null text or one without words has fingerprint zero, linked like any other.  The
component id is the smallest id, null ids left out.  Repeated rows get the same component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmill.llm.common import text_udf
from veilmill.llm.graph import components
from veilmill.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
SHARD = 2048  #: members of a tree
_QUERIES = 4096  #: searched at once
_ROWS = 200_000  #: rows of whole shards held at once


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = max(0, len(words) - shingle)
    of = xxhash.xxh64_intdigest
    hashes = [of(joined[s : e - 1], seed) for s, e in zip(starts[: last + 1], ends[min(shingle, len(words)) - 1 :], strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    share = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(share, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    return docs.withColumn(into, text_udf(lambda: lambda x: fingerprint(x, shingle), "long")(F.col(text)))


class Forest:
    """BK-trees of several shards: ``prints`` by shard, each shard's first member the root."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints
        n = len(prints)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.root_of = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        item = np.flatnonzero(~first)
        at = self.root_of[item]
        keys, nodes = [], []
        while len(item):
            key = at * 65 + np.bitwise_count(prints[item] ^ prints[at])
            order = np.argsort(key, kind="stable")
            item, key = item[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            keys.append(key[new])
            nodes.append(item[new])
            at = item[new][np.cumsum(new) - 1][~new]
            item = item[~new]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within ``radius``; each query starts at its root."""
        query, node = np.arange(len(queries)), roots
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            query = np.repeat(query, count)
            offset = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            node = self.nodes[np.repeat(low, count) + offset]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a`` and ``b`` pairwise; every set points at its smallest member."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def shard_links(prints: np.ndarray, shard: np.ndarray, asks: np.ndarray, answers: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between members of each shard that ask and those in its tree.

    ``shard`` is sorted; ``answers`` marks the members of the tree, ``asks`` those that search it.
    """
    tree = np.flatnonzero(answers)
    forest = Forest(prints[tree], shard[tree])
    askers = np.flatnonzero(asks)
    at = np.searchsorted(shard[tree], shard[askers])
    there = at < len(tree)
    there[there] = shard[tree][at[there]] == shard[askers][there]
    askers, at = askers[there], at[there]
    parent = np.arange(len(prints))
    for k in range(0, len(askers), _QUERIES):
        some = askers[k : k + _QUERIES]
        for query, node in forest.search(prints[some], at[k : k + _QUERIES], radius):
            _join(parent, some[query], tree[node])
    child = np.flatnonzero(parent != np.arange(len(prints)))
    return prints[child], prints[parent[child]]


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Shift and width of each block of bits."""
    n = radius + 2
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return list(zip([0, *accumulate(widths)][:-1], widths, strict=True))


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, fp: str = "fp") -> DataFrame:
    """``a, b``: links between different fingerprints within ``radius`` that connect all that are linked."""
    block = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _blocks(radius)]
    names = [
        F.shiftleft(F.lit(k).cast("long"), 40).bitwiseOR(F.shiftleft(block[i], 20)).bitwiseOR(block[j])
        for k, (i, j) in enumerate(combinations(range(len(block)), 2))
    ]
    members = prints.select(F.col(fp).alias("fp"), F.explode(F.array(*names)).alias("name"))
    large = members.groupBy("name").count().where(F.col("count") > shard).select(
        "name", F.ceil(F.col("count") / shard).cast("int").alias("parts")
    )
    large = cut_lineage(large, "large_shards")
    dealt = members.join(large, "name", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.lit(0))
    )
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("other")
    met = dealt.select("fp", "name", "part", other).select(
        "fp", "name", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        def found(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            fps, name, low, high, part = columns
            begins = np.ones(len(fps), bool)
            begins[1:] = (name[1:] != name[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            number = np.cumsum(begins) - 1
            several = np.bincount(number)[number] > 1
            fps, number, low, high, part = (x[several] for x in (fps, number, low, high, part))
            a, b = shard_links(fps.view(np.uint64), number, part == high, part == low, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
            if sum(len(x[0]) for x in held) >= _ROWS:
                columns = joined()
                _, name, low, high, _ = columns
                last = (name == name[-1]) & (low == low[-1]) & (high == high[-1])
                cut = len(name) - int(last.sum())
                if cut:
                    yield found(tuple(x[:cut] for x in columns))
                held = [tuple(x[cut:] for x in columns)]
        if held:
            yield found(joined())

    grouped = met.repartition("name", "low", "high").sortWithinPartitions("name", "low", "high")
    return grouped.select("fp", "name", "low", "high", "part").mapInArrow(search, "a long, b long").distinct()


def clusters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, version`` (hash of the text)``, fp, component_id`` of every row."""
    marked = cut_lineage(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle)
        .select("doc_id", F.xxhash64("text").alias("version"), "fp"), "prints",
    )
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "different_prints")
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", "version", "fp", "component_id")


def memberships(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **settings: object) -> DataFrame:
    """One row of each component, that with the smallest id (a null id only if there is no other)."""
    members = clusters(docs, **settings)
    first = members.groupBy("fp", "component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")).alias("one")
    )
    # Components without any id have none; their fingerprints stand for them.
    of = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    first = first.groupBy(of.alias("of")).agg(F.min("one").alias("one")).select(
        F.col("one.doc_id").alias("_first"), F.col("one.version").alias("_version")
    ).distinct()
    own = docs.withColumn("_own", F.xxhash64("text"))
    kept = own.join(first, own["doc_id"].eqNullSafe(F.col("_first")) & (F.col("_own") == F.col("_version")), "left_semi")
    copies = Window.partitionBy("doc_id", "_own").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(copies)).where("_n = 1").drop("_n", "_own")
