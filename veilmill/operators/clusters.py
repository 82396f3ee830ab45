"""Centroids: fitting, nearest-centroid lookup, labels and counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmill.functions.vectors import as_double, mean_vector
from veilmill.operators.order import positions
from veilmill.session import cut_lineage

# Granularity names, their column in the store, cluster number and passes.
GRANULARITIES = {
    "50k": ("fiftyk", 50_000, 5),
    "100k": ("hundredk", 100_000, 10),
    "200k": ("twohundredk", 200_000, 10),
}
BROADCAST_BYTES = 64 * 1024 * 1024
MOST_CENTROID_BYTES = 256 * 1024 * 1024  #: k-means keeps all centroids in one matrix
MOST_RANGES = 16  #: of centroids with a lower bound each
PLACES = 12  #: decimals of a cosine, so that ties are ties whatever the order of the sums
CHUNK_CELLS = 4_000_000


def granularity_column(mode: str) -> str:
    if mode not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}, not {mode!r}")
    return GRANULARITIES[mode][0]


def _matrix_blocks(centroids: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Centroids in id order, as matrices of at most BROADCAST_BYTES each."""
    rows = max(1, BROADCAST_BYTES // (8 * dim))
    low, high = centroids.agg(F.min("cluster_id"), F.max("cluster_id")).first()
    if low is None:
        return
    for start in range(low, high + 1, rows):
        part = (
            centroids.filter(F.col("cluster_id").between(start, start + rows - 1))
            .select("cluster_id", as_double(F.col("centroid")).alias("centroid"))
            .orderBy("cluster_id")
            .toPandas()
        )
        if len(part):
            yield part["cluster_id"].to_numpy(np.int64), np.stack(part["centroid"].to_numpy())


def _closeness(vectors: np.ndarray, matrix: np.ndarray, metric: str) -> np.ndarray:
    """Larger is closer: cosine similarity, or negative squared distance."""
    if metric == "cosine":
        a = vectors / np.where((n := np.linalg.norm(vectors, axis=1)) == 0, 1.0, n)[:, None]
        b = matrix / np.where((n := np.linalg.norm(matrix, axis=1)) == 0, 1.0, n)[:, None]
        return np.round(a @ b.T, PLACES)
    return 2.0 * vectors @ matrix.T - (vectors**2).sum(1)[:, None] - (matrix**2).sum(1)


def _closest_of(shared, metric: str):
    """Batch function: the best score and centroid id within one broadcast matrix."""

    @F.pandas_udf("score double, id bigint")
    def closest(batch: pd.Series) -> pd.DataFrame:
        ids, matrix = shared.value
        rows = max(1, CHUNK_CELLS // len(ids))
        scores, winners = [np.zeros(0)], [np.zeros(0, np.int64)]
        for start in range(0, len(batch), rows):
            part = np.stack(batch.iloc[start : start + rows].to_numpy()).astype(np.float64)
            close = _closeness(part, matrix, metric)
            at = close.argmax(axis=1)
            scores.append(close[np.arange(len(at)), at])
            winners.append(ids[at])
        return pd.DataFrame({"score": np.concatenate(scores), "id": np.concatenate(winners)})

    return closest


def nearest_centroid(
    vecs: DataFrame,
    centroids: DataFrame,
    metric: str = "cosine",
    vec_col: str = "vec",
    out: str = "cluster_id",
) -> DataFrame:
    """Add the id of the closest centroid, the lowest id on a tie.

    Exact and narrow: centroid matrices of checked size are broadcast and compared in NumPy.
    A centroid table beyond that size is compared one block after the other; the better of two
    candidates is written after each, so one block is alive at a time.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    context = vecs.sparkSession.sparkContext
    first = centroids.select(F.size("centroid")).first()
    if first is None:
        return vecs.withColumn(out, F.lit(None).cast("int"))
    shared = None
    for ids, matrix in _matrix_blocks(centroids, first[0]):
        if shared is not None:
            vecs = cut_lineage(vecs, "nearest")
            shared.destroy()
        shared = context.broadcast((ids, matrix))
        close = _closest_of(shared, metric)(as_double(F.col(vec_col)))
        if "_best" in vecs.columns:
            vecs = vecs.withColumn("_other", close)
            better = F.col("_other.score") > F.col("_best.score")
            vecs = vecs.withColumn("_best", F.when(better, F.col("_other")).otherwise(F.col("_best"))).drop("_other")
        else:
            vecs = vecs.withColumn("_best", close)
    return vecs.withColumn(out, F.col("_best.id").cast("int")).drop("_best")


def label_triples(store: DataFrame, centroids: dict[str, DataFrame], metric="cosine") -> DataFrame:
    """One label column per granularity name in ``centroids``."""
    for mode, table in centroids.items():
        store = nearest_centroid(store, table, metric, out=granularity_column(mode))
    return store


def cluster_counts(labels: DataFrame, centroids: DataFrame, label: str = "cluster_id") -> DataFrame:
    """``(cluster_id, n)`` for every centroid, 0 for those without members."""
    counts = labels.groupBy(F.col(label).alias("cluster_id")).agg(F.count("*").alias("n"))
    return (
        centroids.select("cluster_id")
        .join(counts, "cluster_id", "left")
        .select("cluster_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def sign_cells(vec: Column, bits: int) -> Column:
    """Cell number from the signs of the leading ``bits`` components."""
    signs = [F.when(vec[i] > 0, 2**i).otherwise(0) for i in range(bits)]
    return sum(signs[1:], signs[0]).cast("int")


def sign_centroids(vecs: DataFrame, dim: int, bits: int) -> DataFrame:
    """Means of the sign cells: a seedless start for refinement, or a coarse partition."""
    return mean_centroids(vecs.withColumn("_cell", sign_cells(F.col("vec"), bits)), "_cell", dim)


def mean_centroids(vecs: DataFrame, label: str, dim: int) -> DataFrame:
    """``(cluster_id, centroid)``: the mean vector of every label."""
    return vecs.groupBy(F.col(label).alias("cluster_id")).agg(
        mean_vector(F.col("vec"), dim).alias("centroid")
    )


def spread_starts(vecs: DataFrame, k: int, key: str = "key") -> DataFrame:
    """``(cluster_id, centroid)``: every n/k-th of the n vectors, in the order of their signs.

    Vectors with the same signs lie together, so the starts are spread over the cells that the
    signs make in proportion to what they hold, without a random number.
    """
    signs = F.array_join(F.transform("vec", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    rows = vecs.select(F.col(key).alias("_key"), "vec", signs.alias("_signs"))
    placed = cut_lineage(positions(rows, ["_signs", "_key"]).select("position", "vec"), "placed")
    n = placed.count()
    k = min(k, n)
    at = F.expr(f"(position * {k}L + {max(n - 1, 0)}L) div {max(n, 1)}L")
    chosen = placed.withColumn("cluster_id", at.cast("int")).where(f"cluster_id < {k} and (cluster_id * {n}L) div {max(k, 1)}L = position")
    return chosen.select("cluster_id", as_double(F.col("vec")).alias("centroid"))


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and centroids in id order, on the driver.

    Their size is that of two parameters, the number of clusters and the dimension, and checked.
    """
    size = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if 8 * size[0] * (size[1] or 0) > MOST_CENTROID_BYTES:
        raise ValueError(f"{size[0]} centroids of {size[1]} components take more than {MOST_CENTROID_BYTES} bytes")
    rows = centroids.select("cluster_id", as_double(F.col("centroid")).alias("centroid")).orderBy("cluster_id").toPandas()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return rows["cluster_id"].to_numpy(np.int64), np.stack(rows["centroid"].to_numpy())


class Bounds:
    """Assignment of vectors to the nearest of moving centroids, pruned by the triangle inequality.

    Centroids are cut into ranges.  A vector keeps an upper bound of the distance to its centroid
    and, for each range, a lower bound of the distance to any other centroid there.  When
    centroids have moved, bounds give way by the ways moved; a range is compared again only if
    its lower bound is not above the upper one.
    """

    SLACK = 1e-6  #: for the rounding of distances

    def __init__(self, matrix: np.ndarray, before: np.ndarray | None = None):
        self.matrix = matrix
        self.squares = (matrix * matrix).sum(axis=1)
        k = len(matrix)
        ranges = max(1, min(MOST_RANGES, k // 8))
        self.edges = [k * i // ranges for i in range(ranges + 1)]
        self.of = np.repeat(np.arange(ranges), np.diff(self.edges))
        moved = np.zeros(k) if before is None else np.sqrt(((matrix - before) ** 2).sum(axis=1))
        self.moved = moved
        self.most_moved = np.maximum.reduceat(moved, self.edges[:-1])

    def _distances(self, x: np.ndarray, low: int, high: int) -> np.ndarray:
        squares = (x * x).sum(axis=1)[:, None] - 2.0 * x @ self.matrix[low:high].T + self.squares[low:high]
        return np.sqrt(np.maximum(squares, 0.0))

    def _compare(self, x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray, rows: np.ndarray, g: int) -> None:
        """Compare some vectors with a range of centroids; label and bounds are changed in place."""
        low, high = self.edges[g], self.edges[g + 1]
        step = max(1, CHUNK_CELLS // (high - low))
        for k in range(0, len(rows), step):
            at = rows[k : k + step]
            far = self._distances(x[at], low, high)
            own = np.flatnonzero((label[at] >= low) & (label[at] < high))
            far[own, label[at[own]] - low] = np.inf
            here = np.arange(len(at))
            best = far.argmin(axis=1)
            nearest = far[here, best]
            far[here, best] = np.inf
            second = far.min(axis=1)
            best = best + low
            better = (nearest < upper[at]) | ((nearest == upper[at]) & (best < label[at]))
            lower[at, g] = np.where(better, second, nearest)
            won = at[better]
            old = label[won]
            known = old >= 0
            of = self.of[old[known]]
            lower[won[known], of] = np.minimum(lower[won[known], of], upper[won[known]])
            label[won], upper[won] = best[better], nearest[better]

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, upper and lower bounds by comparison with all centroids."""
        label, upper = np.full(len(x), -1), np.full(len(x), np.inf)
        lower = np.full((len(x), len(self.edges) - 1), np.inf)
        for g in range(len(self.edges) - 1):
            self._compare(x, label, upper, lower, np.arange(len(x)), g)
        return label, upper, lower

    def again(self, x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Move labels and bounds in place; gives the number of distances worked out."""
        upper += self.moved[label]
        lower -= self.most_moved
        worked = 0
        rows = np.flatnonzero(lower.min(axis=1) <= upper + self.SLACK)
        for k in range(0, len(rows), 1 << 16):
            at = rows[k : k + (1 << 16)]
            upper[at] = np.sqrt(((x[at] - self.matrix[label[at]]) ** 2).sum(axis=1))
            worked += len(at)
        for g in range(len(self.edges) - 1):
            at = rows[lower[rows, g] <= upper[rows] + self.SLACK]
            if len(at):
                self._compare(x, label, upper, lower, at, g)
                worked += len(at) * (self.edges[g + 1] - self.edges[g])
        return worked


_STATE = "vec array<double>, label int, upper double, lower array<double>"


def _assigned(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """The next state of ``vec`` alone, or of a state."""
    shared = rows.sparkSession.sparkContext.broadcast(bounds)
    again = "label" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["vec"].flatten().to_numpy().reshape(batch.num_rows, -1)
            if again:
                label, upper = batch["label"].to_numpy().astype(np.int64), batch["upper"].to_numpy().copy()
                lower = batch["lower"].flatten().to_numpy().reshape(batch.num_rows, -1).copy()
                shared.value.again(x, label, upper, lower)
            else:
                label, upper, lower = shared.value.first(x)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lower.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch["vec"], pa.array(label, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))],
                names=["vec", "label", "upper", "lower"],
            )

    return rows.mapInArrow(assign, _STATE)


def refine_centroids(
    vecs: DataFrame, centroids: DataFrame, dim: int, passes: int, metric: str = "euclidean"
) -> DataFrame:
    """Lloyd passes from given centroids; a centroid that loses all members keeps its place.

    The means are partial sums, so a pass shuffles one row per cluster and task.  By Euclidean
    distance the labels are pruned by ``Bounds``, kept beside each vector from pass to pass.
    """
    state = None
    for step in range(passes):
        if metric == "euclidean":
            ids, matrix = centroid_matrix(centroids)
            if not len(ids):
                return centroids
            if state is None:
                state = vecs.select(as_double(F.col("vec")).alias("vec"))
                bounds = Bounds(matrix)
            else:
                bounds = Bounds(matrix, before)
            state, before = cut_lineage(_assigned(state, bounds), "labels"), matrix
            number = vecs.sparkSession.createDataFrame(
                pd.DataFrame({"label": np.arange(len(ids)), "_id": ids}), "label int, _id int"
            )
            labelled = state.join(number, "label").select("vec", F.col("_id").alias("cluster_id"))
        else:
            labelled = nearest_centroid(vecs, centroids, metric)
        means = mean_centroids(labelled, "cluster_id", dim)
        moved = centroids.select("cluster_id", F.col("centroid").alias("old")).join(
            means, "cluster_id", "left"
        )
        centroids = cut_lineage(
            moved.select("cluster_id", F.coalesce("centroid", as_double(F.col("old"))).alias("centroid")),
            "centroids",
        )
    return centroids


def fit_clusters(vecs: DataFrame, k: int, dim: int, max_iter: int = 10, key: str = "key") -> DataFrame:
    """``(cluster_id, centroid)`` by k-means, the same way for every ``k``.

    Starts are spread by ``spread_starts``, then Lloyd passes follow; nothing is random.
    """
    return refine_centroids(vecs, cut_lineage(spread_starts(vecs, k, key), "start"), dim, max_iter)


def fit_granularities(
    store: DataFrame, dim: int, sizes: dict[str, tuple[int, int]] | None = None, key: str = "key"
) -> dict[str, DataFrame]:
    """Centroids by granularity name; ``sizes`` gives other numbers of clusters and passes."""
    sizes = sizes or {mode: (k, passes) for mode, (_, k, passes) in GRANULARITIES.items()}
    return {mode: fit_clusters(store, k, dim, passes, key) for mode, (k, passes) in sizes.items()}
