"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Nearness is the inner product.  Each vector gets one more component that gives all of them one norm, after which
the largest inner product is the smallest Euclidean distance.  Vectors are dealt to lists by the nearest
of a few centres.  Within each probed list they are rotated at random and kept in column blocks; after each
block a test holds the partial distance, scaled to all dimensions, against the current bound, and candidates that
fail are abandoned.  Those left at the end are scored exactly on the vectors as given, in double precision.

The number of probes is calibrated on the fitting sample for ``RECALL``.  That sample, of bounded size,
also gives each query its first bound: the k-th best of the sample can't be better than the k-th best of all.

Equal vectors are searched once.  Of their ids the k + 1 smallest are kept, all that any answer can name,
since ties go to the smaller id; a vector in a third of all rows is thus one candidate.  Lists and the
queries that probe them are dealt in blocks of bounded size.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate;
nor do those whose length isn't the most frequent one.  Rows with equal ids and vectors count once.
With k candidates or fewer all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmill.session import cut_lineage

SAMPLE = 8192  #: vectors that centres, bounds and the number of probes come from
MOST_LISTS = 1024
RECALL = 0.97  #: aim of the calibration
COLUMNS = 16  #: dimensions of a column block
EPSILON = 2.1  #: larger: fewer candidates abandoned by mistake
BLOCK = 4096  #: vectors of a list scanned together
ASKED = 1024  #: queries that scan them together
_CHUNK = 1024  #: vectors between two updates of the bound


@dataclass
class Index:
    norm: float  # of all extended vectors
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    sample: np.ndarray

    def extend(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm**2 - np.square(vectors).sum(axis=1), 0.0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([vectors, np.zeros((len(vectors), 1))])

    def ordered_lists(self, extended: np.ndarray) -> np.ndarray:
        """List numbers by distance of their centres."""
        distance = np.square(self.centres).sum(axis=1) - 2 * extended @ self.centres.T
        return np.argsort(distance, axis=1, kind="stable")


def _usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    fits = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double"))
    ) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(fits & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    )
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (usual[0].n if usual else 0)).distinct()


def fit(distinct: DataFrame, k: int, seed: int = 7) -> Index | None:
    """An index of different vectors (column ``vec``), or None without any."""
    n, norm = distinct.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return None
    drawn = distinct.select("vec", F.xxhash64("vec").alias("at")).orderBy("at").limit(SAMPLE).select("vec").collect()
    sample = np.array([r.vec for r in drawn])
    random = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    rotation = np.linalg.qr(random.standard_normal((size, size)))[0]
    index = Index(float(norm), rotation, np.zeros((1, size)), 1, sample)
    points = index.extend(sample)
    lists = int(min(max(1, np.sqrt(n) / 2), MOST_LISTS, len(points)))
    centres = points[random.choice(len(points), lists, replace=False)]
    for _ in range(12):
        index.centres = centres
        nearest = index.ordered_lists(points)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        counts = np.bincount(nearest, minlength=lists)
        centres = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], centres)
    index.centres = centres
    asked = sample[random.choice(len(sample), min(256, len(sample)), replace=False)]
    best = np.argsort(-(asked @ sample.T), axis=1)[:, : k + 1]
    order = index.ordered_lists(index.asked(asked))
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, index.ordered_lists(points)[:, 0][best], axis=1).ravel())
    index.probes = int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1
    return index


def scan(index: Index, vectors: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of the k best vectors and their exact scores; worse than its floor don't count."""
    rotated = index.extend(vectors) @ index.rotation
    asked = index.asked(queries) @ index.rotation
    size = rotated.shape[1]
    edges = [*range(0, size, COLUMNS), size]
    chunks = [
        (at, [np.ascontiguousarray(rotated[at : at + _CHUNK, a:b]) for a, b in zip(edges, edges[1:], strict=False)])
        for at in range(0, len(vectors), _CHUNK)
    ]
    found = []
    for query, turned, floor in zip(queries, asked, floors, strict=True):
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        base = np.square(query).sum() + index.norm**2
        for at, blocks in chunks:
            bound = base - 2 * floor
            alive = np.arange(len(blocks[0]))
            partial = np.zeros(len(alive))
            for columns, a, b in zip(blocks, edges, edges[1:], strict=False):
                part = columns if len(alive) == len(columns) else columns[alive]
                partial += np.square(part - turned[a:b]).sum(axis=1)
                if b < size:
                    stays = partial * (size / b) <= bound * (1 + EPSILON / np.sqrt(b)) ** 2 + 1e-9
                    alive, partial = alive[stays], partial[stays]
                if not len(alive):
                    break
            exact = np.einsum("ij,j->i", vectors[at + alive], query)
            rows, scores = np.concatenate([rows, at + alive]), np.concatenate([scores, exact])
            if len(rows) > k:
                limit = np.partition(scores, len(scores) - k)[len(scores) - k]
                stays = scores >= limit  # ties stay, the smaller id is taken later
                rows, scores, floor = rows[stays], scores[stays], max(floor, limit)
        found.append((rows, scores))
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows of ``vectors`` to each row of ``queries``, itself left out."""
    spark = vectors.sparkSession
    most = k + 1
    usable = cut_lineage(_usable(vectors, vector, vec_id), "vectors")
    ranked = usable.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= most)
    points = ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = cut_lineage(points, "points")
    asking = usable.join(queries.select(F.col(vec_id).cast("long").alias("id")).distinct(), "id", "left_semi")
    index = fit(points.select("vec"), k)
    empty = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(index)

    def nearest_list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy())
                yield b.assign(list=shared.value.ordered_lists(shared.value.extend(x))[:, 0].astype(np.int32))

    def probed_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            index, x = shared.value, np.stack(b["vec"].to_numpy())
            lists = index.ordered_lists(index.asked(x)).astype(np.int32)
            known = x @ index.sample.T
            enough = known.shape[1] >= most
            floor = np.partition(known, -most, axis=1)[:, -most] - 1e-9 if enough else np.full(len(x), -np.inf)
            yield b.assign(lists=list(lists), floor=floor)

    dealt = cut_lineage(points.mapInPandas(nearest_list, "vec array<double>, ids array<long>, list int"), "dealt")
    asked = asking.groupBy("vec").agg(F.min("id").alias("query"))
    asking_all = cut_lineage(
        asked.mapInPandas(probed_lists, "vec array<double>, query long, lists array<int>, floor double"), "probing"
    )
    sizes = dealt.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    sizes = cut_lineage(sizes, "list_sizes")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "score": [], "ids": []})
        vecs, ids = np.stack(left["vec"].to_numpy()), left["ids"].to_numpy()
        found = scan(shared.value, vecs, np.stack(right["asked"].to_numpy()), right["floor"].to_numpy(), most)
        return pd.DataFrame({
            "query": np.repeat(right["query"].to_numpy(), [len(r) for r, _ in found]),
            "score": np.concatenate([s for _, s in found]),
            "ids": ids[np.concatenate([r for r, _ in found])],
        })

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def probed(open_: DataFrame, first: int, last: int) -> DataFrame:
        """The best found in the lists at places ``first`` to ``last`` of each query's order."""
        probing = open_.select(
            "query", F.col("vec").alias("asked"), "floor", F.explode(F.slice("lists", first + 1, last - first)).alias("list")
        )
        crowds = probing.groupBy("list").count().select("list", F.ceil(F.col("count") / ASKED).cast("int").alias("groups"))
        plan = F.broadcast(cut_lineage(sizes.join(crowds, "list"), "plan"))  # one row a list, MOST_LISTS at most
        blocks = dealt.join(plan, "list").select(
            "list", F.pmod(F.xxhash64("vec"), "parts").cast("int").alias("part"), "vec", "ids",
            F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
        )
        meeting = probing.join(plan, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "asked", "floor",
            F.pmod(F.xxhash64("query"), "groups").cast("int").alias("group"),
        )
        keys = ["list", "part", "group"]
        hits = blocks.groupBy(*keys).cogroup(meeting.groupBy(*keys)).applyInPandas(meet, "query long, score double, ids array<long>")
        found = hits.select("query", "score", F.explode("ids").alias("vec_id"))
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)

    # A query whose neighbours lie in other lists goes on until it has its answers or no list is left.
    first, last, lists = 0, index.probes, len(index.centres)
    found = cut_lineage(probed(asking_all, first, last).drop("n"), "found")
    while last < lists:
        full = found.groupBy("query").count().where(F.col("count") >= most)
        open_ = cut_lineage(asking_all.join(full, "query", "left_anti"), "open")
        if open_.isEmpty():
            break
        first, last = last, min(lists, 2 * last)
        found = cut_lineage(found.unionByName(probed(open_, first, last).drop("n")), "found")
    near = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    answers = near.groupBy("query").agg(F.collect_list(F.struct("n", "vec_id", "score")).alias("near"))
    answers = asked.join(answers, "query").select("vec", "near")
    rows = asking.join(answers, "vec").select(F.col("id").alias("query_id"), F.sort_array("near").alias("near"))
    rest = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(rest)).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", "col.score"
    )


def neighbours(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return search(embeddings, embeddings.where("vec_id % 20 = 0"))
