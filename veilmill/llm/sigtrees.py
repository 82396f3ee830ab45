"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, by signature trees.

A document's set is the hashes of its different five-word shingles.  A signature is a bitmap with a bit for each
hash; a tree's node holds the signatures of its members combined by OR, the range of their sizes, the most bits
that a member lost to collisions, and the most shingles that two members can still share.  Two trees, or a tree and
itself, are walked together from their roots: a pair of nodes goes on to its children only if the largest overlap
that any pair below can have is enough for the smallest sizes below, and only if they aren't in one component already.
Pairs of members that are left are compared shingle by shingle.

Which sets meet in a tree: shingles have one order, the same for all (those frequent in a sample last, else by hash),
and a set with a link shares one of its first ``n - ceil(0.8 n) + 1`` shingles with the other set.  Each such
shingle that at least two different sets hold among their first names a shard.  As all that two sets share lies
behind the first shingle that they share, a member's place in the order bounds its overlap, too.  The order
decides cost only; no link is lost by it.

Three steps keep groups of copies linear.  Equal sets are one member.  Then every set goes to the shard of its first
shared shingle alone, which links most near copies; large shards are cut into parts whose components send one
member each to another turn.  At last all shards are searched in which more than one component is left; large ones
are cut into parts, and pairs of parts are searched.  Signatures of one width travel first; shingles only for the
members that have a possible partner left, and for a pair that meets in several shards to one of them.  A shard
gives links that connect what is linked, not all pairs.

Defined results: texts without words, or null, have no set, are linked with nothing, and are their own component.
The component id is the smallest id, null ids left out; rows of one text get the same.  Sets are told apart, and
shingles are, by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmill.llm.common import drawn, light, text_udf
from veilmill.llm.graph import components
from veilmill.session import cut_lineage

SHINGLE = 5
SHARE = (80, 100)  #: least intersection over union, as a fraction
FAN = 8  #: children of a node
BITS = 1024  #: of a node's signature
WIDEST = 1 << 16  #: bits of a member's signature
PART = 1024  #: members of a tree
DENSE = 4  #: possible pairs for each member above which a shard is compared whole
DENSE_WIDE = 64  #: the same for members whose signature is wider than a node's, and can rule out more
WEIGHT = 1 << 20  #: shingles of a tree's members
SAMPLE = 4096  #: rows in which frequent shingles are looked for
FREQUENT = 1 << 16  #: shingles ordered last at most, of those in FEW texts of the sample
FEW = 4
_PAIRS = 1 << 14  #: compared at once
_ROWS = 1 << 14  #: rows of whole shards held at once
_PIECE = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


# ---- sets ---------------------------------------------------------------------------------


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The hashes of the different shingles, ascending."""
    joined = _SPACE.sub(b" ", (text or "").encode("utf-8", "replace").lower()).strip(b" ")
    if not joined:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(joined)]])
    width = min(width, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    view, of, pieces = memoryview(joined), xxhash.xxh3_64_intdigest, []
    for k in range(0, len(starts), _PIECE):
        spans = zip(starts[k : k + _PIECE].tolist(), ends[k : k + _PIECE].tolist(), strict=True)
        pieces.append(np.unique(np.array([of(view[b:e]) for b, e in spans], np.uint64)))
    return pieces[0] if len(pieces) == 1 else np.unique(np.concatenate(pieces))


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of at least two bits a shingle, as far as ``WIDEST`` allows."""
    width = min(WIDEST, max(BITS, 1 << (2 * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> bytes:
    """A bitmap cut to ``size`` bytes by OR."""
    if len(bitmap) == size:
        return bitmap
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size), axis=0).tobytes()


def enough(x: bytes, m: int, y: bytes, n: int, share: tuple[int, int]) -> bool:
    """Whether sets of sizes ``m`` and ``n`` with these signatures can share enough."""
    size = min(len(x), len(y))
    a, b = (int.from_bytes(_folded(s, size), "little") for s in (x, y))
    most = min(m - (a & ~b).bit_count(), n - (b & ~a).bit_count())
    return most * (share[0] + share[1]) >= share[0] * (m + n)


def least_shared(size: int, share: tuple[int, int]) -> int:
    return -(-size * share[0] // share[1])


def described(text: str | None, frequent: np.ndarray, width: int, share: tuple[int, int]) -> tuple:
    """``n, id, sig, fold, rare, keys`` of a set: size, hash, signature (whole, and of a node's width), and the first
    shingles in the common order, of which ``rare`` aren't among the frequent ones."""
    hashes = shingle_set(text, width)
    n = len(hashes)
    if not n:
        return 0, None, None, None, None, None
    at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
    last = frequent[at] == hashes if len(frequent) else np.zeros(n, bool)
    first = np.concatenate([hashes[~last], hashes[last]])[: n - least_shared(n, share) + 1]
    of = xxhash.xxh64_intdigest(hashes.tobytes())
    sig = signature(hashes)
    rare = min(len(first), n - int(last.sum()))
    return n, of - (of >> 63 << 64), sig, _folded(sig, BITS // 8), rare, first.view(np.int64)


# ---- trees --------------------------------------------------------------------------------


class Forest:
    """Signature trees of several shards; members are sorted by tree, then by size."""

    def __init__(self, tree: np.ndarray, n: np.ndarray, rest: np.ndarray, bits: np.ndarray, comp: np.ndarray, share: tuple[int, int]):
        self.share = share
        lost = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        level = {"low": n, "high": n, "rest": rest, "lost": lost, "bits": bits, "first": comp, "last": comp}
        self.levels, self.first_child, self.children = [level], [], []
        while True:
            begins = np.ones(len(tree), bool)
            begins[1:] = tree[1:] != tree[:-1]
            place = np.arange(len(tree)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            if len(self.levels) > 1 and begins.all():
                break
            at = np.flatnonzero(place % FAN == 0)
            self.first_child.append(at)
            self.children.append(np.diff(np.append(at, len(tree))))
            tree = tree[at]
            self.levels.append({
                "low": np.minimum.reduceat(level["low"], at), "high": np.maximum.reduceat(level["high"], at),
                "rest": np.maximum.reduceat(level["rest"], at), "lost": np.maximum.reduceat(level["lost"], at),
                "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0),
                "first": np.minimum.reduceat(level["first"], at), "last": np.maximum.reduceat(level["last"], at),
            })
            level = self.levels[-1]

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some pair below two nodes can share enough, and isn't known to be connected."""
        x, (part, whole) = self.levels[level], self.share
        out = np.zeros(len(a), bool)
        apart = (x["first"][a] != x["last"][b]) | (x["last"][a] != x["first"][b])
        fits = (part * x["low"][a] <= whole * x["high"][b]) & (part * x["low"][b] <= whole * x["high"][a])
        need = -(-part * (x["low"][a] + x["low"][b]) // (part + whole))
        some = np.flatnonzero(apart & fits & (np.minimum(x["rest"][a], x["rest"][b]) >= need))
        for k in range(0, len(some), _PAIRS):
            at = some[k : k + _PAIRS]
            common = np.bitwise_count(x["bits"][a[at]] & x["bits"][b[at]]).sum(axis=1, dtype=np.int64)
            out[at] = common + np.minimum(x["lost"][a[at]], x["lost"][b[at]]) >= need[at]
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members below pairs of roots, as far as they are possible."""
        stack = [(len(self.levels) - 1, a, b)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > _PAIRS:
                stack += [(level, a[_PAIRS:], b[_PAIRS:])]
                a, b = a[:_PAIRS], b[:_PAIRS]
            alive = self._possible(level, a, b)
            a, b = a[alive], b[alive]
            if level == 0:
                yield a, b
                continue
            if not len(a):
                continue
            level -= 1
            starts, counts = self.first_child[level], self.children[level]
            each = counts[a] * counts[b]
            pair = np.repeat(np.arange(len(a)), each)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            width = counts[b][pair]
            left, right = starts[a][pair] + at // width, starts[b][pair] + at % width
            own = a[pair] == b[pair]
            once = ~own | ((left < right) if level == 0 else (left <= right))
            stack.append((level, left[once], right[once]))


class Members:
    """The members of whole shards, ready for the walk: columns sorted by shard and part."""

    FIELDS = ("key", "low", "high", "part", "id", "comp", "n", "rest", "sig")

    def __init__(self, columns: dict[str, np.ndarray], share: tuple[int, int]):
        order = np.lexsort((columns["id"], columns["n"], columns["part"], columns["high"], columns["low"], columns["key"]))
        self.of = {name: column[order] for name, column in columns.items()}
        self.share = share
        key, low, high, part = (self.of[c] for c in ("key", "low", "high", "part"))
        tree = self._numbers(key, low, high, part)
        bits = np.frombuffer(b"".join(_folded(s, BITS // 8) for s in self.of["sig"]), np.uint64).reshape(len(key), -1)
        self.forest = Forest(tree, self.of["n"], self.of["rest"], bits, self.of["comp"], share)
        # Roots are numbered as trees are.  A shard of one part meets itself; else its two parts meet.
        first = np.flatnonzero(np.diff(tree, prepend=-1))
        shard = self._numbers(key, low, high)[first]
        alone = low[first] == high[first]
        self.a = np.flatnonzero(alone | np.append(shard[1:] == shard[:-1], False))
        self.b = np.where(alone[self.a], self.a, self.a + 1)

    @staticmethod
    def _numbers(*columns: np.ndarray) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of members that may be linked."""
        sig = self.of["sig"]
        for a, b in self.forest.pairs(self.a, self.b):
            wide = np.array([len(s) * 8 > BITS for s in sig], bool) if len(a) else np.zeros(0, bool)
            keep = np.ones(len(a), bool)
            for k in np.flatnonzero(wide[a] & wide[b]) if len(a) else ():
                keep[k] = self._enough(int(a[k]), int(b[k]))
            yield a[keep], b[keep]

    def _enough(self, i: int, j: int) -> bool:
        """The same bound on signatures of full width."""
        sig, n = self.of["sig"], self.of["n"]
        return enough(sig[i], int(n[i]), sig[j], int(n[j]), self.share)

    def partnered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of members that may be linked, and the ids of the pairs they are in.

        A pair gives both of its members.  Of a dense shard each such member is given once, with its own id
        twice: it asks for the whole shard.
        """
        shard = self.shard_of_member()
        members = np.bincount(shard)
        most = np.bincount(shard, weights=np.where(2 * self.of["n"] > BITS, DENSE_WIDE, DENSE))
        count, marked, held = np.zeros(len(members), np.int64), np.zeros(len(shard), bool), []
        for a, b in self.pairs():
            count += np.bincount(shard[a], minlength=len(members))
            marked[a] = marked[b] = True
            sparse = (count <= most)[shard[a]]
            held.append((a[sparse], b[sparse]))
        a, b = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        sparse = (count <= most)[shard[a]]
        a, b = a[sparse], b[sparse]
        dense = np.flatnonzero(marked & (count > most)[shard])
        ids = self.of["id"]
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        return np.concatenate([a, b, dense]), np.concatenate([low, low, ids[dense]]), np.concatenate([high, high, ids[dense]])

    def links(self, bodies: np.ndarray) -> tuple[list[int], list[int]]:
        """Links that connect what is linked, found by comparing shingles (``bodies`` as given, before sorting)."""
        ids = self.of["id"]
        _, parent = np.unique(np.stack([self.shard_of_member(), self.of["comp"]]), axis=1, return_inverse=True)
        # Members of one component in a shard start as one set, named by its first member.
        name: dict[int, int] = {}
        parent = [name.setdefault(int(c), i) for i, c in enumerate(parent.ravel())]

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        part, whole = self.share
        left, right = [], []
        for a, b in self.pairs():
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                p, q = top(i), top(j)
                if p == q:
                    continue
                x, y = bodies[i], bodies[j]
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if whole * common >= part * (len(x) + len(y) - common):
                    parent[max(p, q)] = min(p, q)
                    left.append(int(ids[i]))
                    right.append(int(ids[j]))
        return left, right

    def shard_of_member(self) -> np.ndarray:
        return self._numbers(*(self.of[c] for c in ("key", "low", "high")))


def _whole_shards(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole shards from rows sorted by shard."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {f: np.concatenate([h[f] for h in held]) for f in fields}

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        values = batch.column(name)
        if pa.types.is_binary(values.type):
            out = np.empty(len(values), object)
            out[:] = values.to_pylist()
            return out
        return values.to_numpy(zero_copy_only=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({f: column(batch, f) for f in fields})
        if sum(len(h["key"]) for h in held) >= _ROWS:
            rows = joined()
            last = np.ones(len(rows["key"]), bool)
            for c in ("key", "low", "high"):
                last &= rows[c] == rows[c][-1]
            cut = len(last) - int(last.sum())
            if cut:
                yield {f: v[:cut] for f, v in rows.items()}
            held = [{f: v[cut:] for f, v in rows.items()}]
    if held:
        yield joined()


def _dealt(rows: DataFrame, sizes: DataFrame, both: bool, salt: int) -> DataFrame:
    """Rows of shards with their part, once for each pair of parts to be searched, or for their own part alone."""
    parts = F.greatest(F.ceil(F.col("members") / PART), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    rows = rows.join(sizes.select("key", parts.alias("parts")), "key")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("parts")).cast("int"))
    if both:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        rows = rows.withColumn("other", F.col("part"))
    return rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other")


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _partnered(rows: DataFrame, wide: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows of members that have a possible partner by their signatures, each pair in one shard.

    ``wide`` has ``id, n, sig`` of the sets with a signature wider than a node's; pairs of them, each once, are
    held against these.
    """
    fields = list(Members.FIELDS)
    kept = fields[:-1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_shards(batches, fields):
            members = Members(columns, share)
            at, a, b = members.partnered()
            yield pa.RecordBatch.from_arrays([pa.array(members.of[c][at]) for c in kept] + [pa.array(a), pa.array(b)], names=[*kept, "a", "b"])

    kinds = "key long, low int, high int, part int, id long, comp long, n int, rest int, a long, b long"
    found = cut_lineage(_met(rows).select(*fields).mapInArrow(search, kinds), "possible")

    @F.pandas_udf("boolean")
    def fits(x: pd.Series, m: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        rows = zip(x, m, y, n, strict=True)
        return pd.Series([enough(a, int(i), b, int(j), share) for a, i, b, j in rows], dtype=bool)

    pairs = found.where("a < b").select("a", "b").distinct()
    sides = [wide.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    never = cut_lineage(both.where(~fits("sig_a", "n_a", "sig_b", "n_b")).select("a", "b"), "impossible")
    one = found.where("a < b").join(never, ["a", "b"], "left_anti").groupBy("a", "b", "id").agg(F.min(F.struct(*(c for c in kept if c != "id"))).alias("one"))
    return one.select("id", "one.*").select(*kept).unionByName(found.where("a = b").select(*kept)).distinct()


def _linked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``a, b``: links between members of the shards that connect all that are linked there."""
    fields = [*Members.FIELDS, "body"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_shards(batches, fields):
            members = Members(columns, share)
            bodies = [np.frombuffer(x, np.uint64) for x in members.of["body"]]
            a, b = members.links(bodies)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _met(rows).select(*fields).mapInArrow(search, "a long, b long").distinct()


# ---- the join -----------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame, width: int = SHINGLE, sample: int = SAMPLE, most: int = FREQUENT, few: int = FEW) -> np.ndarray:
    """Shingles found in several different texts of a bounded sample; they only decide an order."""
    rows = docs.where("text is not null").select("text")
    key = F.xxhash64("text")
    some = rows.where(drawn(key, sample, rows.count())).groupBy(key.alias("version")).agg(F.first("text").alias("text"))
    hashes = text_udf(lambda: lambda text: shingle_set(text, width).view(np.int64), "array<long>")
    counts = some.select(F.explode(hashes("text")).alias("hash")).groupBy("hash").count().where(F.col("count") >= few)
    found = counts.orderBy(F.desc("count"), "hash").limit(most).select("hash").collect()
    return np.sort(np.array([r.hash for r in found], np.int64).view(np.uint64))


def _shared(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``key, id, n, rest``: the first shingles of the sets that another set of fitting size may hold.

    Rare shingles are exchanged once and met by key; of the sets that hold one, in the order of
    their sizes, some partner is near enough in size only if a neighbour is.  Frequent ones, of
    which there are ``FREQUENT`` at most, could be hot, and are taken to be shared.
    """
    held = sets.select("id", "n", "rare", F.posexplode("keys").alias("pos", "key")).select(
        "key", "id", "n", (F.col("n") - F.col("pos")).alias("rest"), (F.col("pos") < F.col("rare")).alias("_rare")
    )
    frequent = held.where("not _rare").drop("_rare").distinct()
    alone = held.where("_rare").drop("_rare").repartition("key").dropDuplicates(["key", "id"])
    order = Window.partitionBy("key").orderBy("n", "id")
    part, whole = share
    alone = alone.select("*", F.lag("n").over(order).alias("_less"), F.lead("n").over(order).alias("_more"))
    fits = (F.col("_less") * whole >= F.col("n") * part) | (F.col("n") * whole >= F.col("_more") * part)
    return alone.where(fits).drop("_less", "_more").unionByName(frequent)


def _sizes(members: DataFrame, several: Column) -> DataFrame:
    return members.groupBy("key").agg(
        F.count("*").alias("members"), F.sum("n").alias("weight"), F.min("comp").alias("_1"), F.max("comp").alias("_2")
    ).where(several).drop("_1", "_2")


class Corpus(NamedTuple):
    """The texts, and ``id, n, sig, fold, version`` of the different sets that share a shingle with another."""

    docs: DataFrame
    known: DataFrame
    width: int
    share: tuple[int, int]

    def links(self, rows: DataFrame) -> DataFrame:
        """Links in the shards of ``rows``: by signatures first, then by the shingles of what is left."""
        folds = self.known.select("id", F.col("fold").alias("sig"))
        wide = self.known.where(F.octet_length("sig") > BITS // 8).select("id", "n", "sig")
        left = cut_lineage(_partnered(rows.join(folds, "id"), wide, self.share), "partnered")
        of = self.known.join(left.select("id").distinct(), "id", "left_semi").select("id", "sig", "version")
        of = cut_lineage(of, "compared")
        width = self.width
        body = text_udf(lambda: lambda text: shingle_set(text, width).tobytes(), "binary")
        texts = self.docs.withColumn("version", F.xxhash64("text")).join(light(of.select("version")), "version", "left_semi")
        texts = texts.groupBy("version").agg(F.first("text").alias("text"))
        bodies = cut_lineage(of.join(texts, "version").select("id", "sig", body("text").alias("body")), "bodies")
        return cut_lineage(_linked(left.join(bodies, "id"), self.share), "links")


def _first_turns(first: DataFrame, corpus: Corpus) -> DataFrame:
    """Links found where every set meets others in one shard only."""
    links, reps, turn = None, cut_lineage(first.withColumn("comp", F.col("id")), "first"), 0
    while True:
        sizes = cut_lineage(_sizes(reps, F.col("_1") < F.col("_2")), "sizes")
        found = corpus.links(_dealt(reps, sizes, False, turn))
        links = found if links is None else cut_lineage(links.unionByName(found), "links")
        large = sizes.where((F.col("members") > PART) | (F.col("weight") > WEIGHT)).select("key")
        if large.isEmpty():
            return links
        before = reps.count()
        first = cut_lineage(first.join(large, "key", "left_semi"), "first")
        placed = first.join(_roots(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        one = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("_of"), *first.columns)).alias("one")
        reps = cut_lineage(placed.groupBy("key", "comp").agg(one).select("one.*", "comp").select(*first.columns, "comp"), "first")
        turn += 1
        if 2 * reps.count() > before:
            return links


def _roots(links: DataFrame) -> DataFrame:
    return components(links).withColumnRenamed("node", "id").withColumnRenamed("root", "comp")


def classes(docs: DataFrame, width: int = SHINGLE, share: tuple[int, int] = SHARE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, id, n`` of every row, and ``id, comp`` of every set that is linked with another."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, width))
    describe = text_udf(
        lambda: lambda text: described(text, shared.value, width, share), "n int, id long, sig binary, fold binary, rare int, keys array<long>"
    )
    marked = docs.select("doc_id", F.xxhash64("text").alias("version"), describe("text").alias("set"))
    marked = cut_lineage(marked.select("doc_id", "version", "set.*"), "sets")
    members = cut_lineage(_shared(marked.where("n > 0"), share), "members")
    met = cut_lineage(members.groupBy("id").agg(F.max(F.struct("rest", "key", "n")).alias("one")).select("id", "one.*"), "met")
    known = marked.join(met.select("id"), "id", "left_semi").groupBy("id").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("fold").alias("fold"), F.min("version").alias("version")
    )
    known = cut_lineage(known, "signatures")
    corpus = Corpus(docs, known, width, share)

    links = _first_turns(met.select("key", "id", "n", "rest"), corpus)
    placed = members.join(_roots(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    placed = cut_lineage(placed, "placed")
    sizes = cut_lineage(_sizes(placed, F.col("_1") < F.col("_2")), "sizes")
    more = corpus.links(_dealt(placed, sizes, True, 0))
    return marked.select("doc_id", "id", "n"), _roots(cut_lineage(links.unionByName(more), "links"))


def memberships(docs: DataFrame, width: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    marked, comps = classes(docs, width, share)
    sets = marked.groupBy("id").agg(F.min("doc_id").alias("least")).where("id is not null")
    sets = sets.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = sets.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = cut_lineage(sets.select("id", "comp").join(least, "comp").select("id", "component_id"), "classes")
    # Texts without a set stay out of the join, where their null ids would meet in one task.
    some = marked.where("id is not null").join(of, "id").select("doc_id", "n", "component_id")
    none = marked.where("id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
