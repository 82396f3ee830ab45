"""Scoring the members of a group and drawing one of them with the exponential mechanism.

A draw for budget e and utility u in [0, 1] picks a member with probability proportional to
``exp(e * u / (2 * sensitivity))``: every member gets the score ``e * u / (2 * sensitivity)`` plus
Gumbel noise, and the largest score wins.  A maximum of maxima is the same maximum, so members and
queries of a group are split by hash into bounded parts, each pair of parts is one NumPy product in
one task, and a query's winners of all blocks meet in an aggregate.  Which member wins depends on
the seed, the run and the two keys alone, not on how a group is cut.

A query may carry several runs, each with its own budget: utilities are worked out once, noise is
drawn for each run.  The noise of a pair is counter-based: 128 bits of md5 of seed, run and query
key, and 64 of md5 of the member's key, mixed in whole arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmill.functions.rng import digest_pair, gumbel, hash_pair, key_text
from veilmill.session import cut_lineage

BLOCK_SIZE = 2048  #: members that a task compares at once
QUERY_PART = 4096  #: queries, likewise
ASKED_PART, LISTED_PART = 1 << 16, 1 << 14  #: queries and members of a group that meet in one task, where members are listed
CALL_ROWS, CALL_PAIRS = 1 << 15, 1 << 28  #: about as many rows and pairs a call, then
MOST_TASKS = 4096
CELLS = 1 << 17  #: scores held at once, so that they stay near a core
PLACES_HELD = 1 << 14  #: places held at once, likewise
WIDE = 1 << 12  #: pairs of a group that is compared on its own
# Multipliers of the published 64-bit finalizer of SplitMix.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Utilities of members (columns) for queries (rows), or one row for all queries alike.
Utility = Callable[[pa.Table, pa.Table], np.ndarray]
#: Log weights from utilities, ``e / (2 * sensitivity)`` as a column, and the members.
Shape = Callable[[np.ndarray, np.ndarray, pa.Table], np.ndarray]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    rows = len(column)
    flat = pc.list_flatten(column).to_numpy()
    return flat.astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(lengths == 0, 1.0, lengths)[:, None]


def linear(utilities: np.ndarray, weights: np.ndarray, members: pa.Table) -> np.ndarray:
    return weights * utilities


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[1])
    return z ^ (z >> np.uint64(31))


def pair_places(high: np.ndarray, low: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """52 bits for each query (rows, by two 64-bit keys) and member (columns, by one)."""
    z = _mixed(_mixed(high.view(np.uint64)[:, None] + mark.view(np.uint64)) ^ low.view(np.uint64)[:, None])
    return z >> np.uint64(12)


def place_gumbel(places: np.ndarray) -> np.ndarray:
    u = (places.astype(np.float64) + 0.5) / 2.0**52
    return -np.log(-np.log(u))


def pair_gumbel(high: np.ndarray, low: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Noise of queries and members."""
    return place_gumbel(pair_places(high, low, mark))


def winners(weighed: np.ndarray, of: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first member with the largest sum of log weight and noise for each row of ``places``, and that sum.

    ``weighed[of]`` are the log weights of the rows.
    """
    return winners_of(weighed.max(axis=1)[of], lambda row, column: weighed[of[row], column], places)


def winners_of(
    most: np.ndarray, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], places: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``winners`` where ``weigh`` gives the log weights of rows and columns, and ``most`` the largest of each row.

    Noise grows with the place, so the member with the largest place gives a sum to beat, and only
    members whose place could beat it, given the largest weight of the row, get a noise.  The slack
    covers the rounding of the logarithms.
    """
    rows = np.arange(len(places))
    at = places.argmax(axis=1)
    beaten = weigh(rows, at) + place_gumbel(places[rows, at])
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.exp(-np.exp(-(beaten - most))) * (1.0 - 1e-9) - 1e-12
    least = np.where(np.isfinite(beaten), least, 0.0)
    able = np.flatnonzero(places >= (np.maximum(least, 0.0) * 2.0**52).astype(np.uint64)[:, None])
    row, column = np.divmod(able, places.shape[1])
    scores = weigh(row, column) + place_gumbel(places[row, column])
    begins = np.searchsorted(row, rows)
    top = np.maximum.reduceat(scores, begins)
    first = np.flatnonzero((scores == top[row]) | (np.isnan(scores) & np.isnan(top[row])))
    return column[first[np.searchsorted(row[first], rows)]], top


def least_place(beaten: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The least place whose noise could raise a weight of at most ``most`` above ``beaten``, with slack for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        least = np.exp(-np.exp(-(beaten - most))) * (1.0 - 1e-9) - 1e-12
    return (np.maximum(np.where(np.isfinite(least), least, 0.0), 0.0) * 2.0**52).astype(np.uint64)


def _half_mixed(z: np.ndarray, held: np.ndarray) -> None:
    """``_mixed`` but for its last step, in place."""
    for shift, factor in ((30, MIX[0]), (27, MIX[1])):
        np.right_shift(z, np.uint64(shift), out=held)
        np.bitwise_xor(z, held, out=z)
        np.multiply(z, np.uint64(factor), out=z)


def _high_places(high: np.ndarray, low: np.ndarray, mark: np.ndarray, least: np.ndarray, z: np.ndarray, held: np.ndarray):
    """Where ``pair_places`` of arrays that fit each other is at least ``least``, and those places; ``z`` and ``held`` are room."""
    np.add(high, mark, out=z)
    _half_mixed(z, held)
    np.right_shift(z, np.uint64(31), out=held)
    np.bitwise_xor(z, held, out=z)
    np.bitwise_xor(z, low, out=z)
    _half_mixed(z, held)
    # The last step leaves the upper 31 bits as they are.
    able = np.flatnonzero(z >= (least << np.uint64(12)) & np.uint64(2**64 - 2**33))
    some = z.ravel()[able]
    return able, (some ^ (some >> np.uint64(31))) >> np.uint64(12)


def winners_above(
    high: np.ndarray, low: np.ndarray, beaten: np.ndarray, most: np.ndarray, begin: np.ndarray, count: np.ndarray,
    mark: np.ndarray, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, member, score)``: the largest sum of log weight and noise of each query, where it can be above ``beaten``.

    Query ``i`` draws among the members from ``begin[i]`` on, ``count[i]`` of them; queries of the same
    members lie together.  ``most`` is at least their largest log weight, ``weigh`` gives that of queries
    and members.  Of two members with one score the first wins.  All pairs are hashed, ``PLACES_HELD`` at
    a time; only those whose place could win get a noise.
    """
    high, low, mark = high.view(np.uint64), low.view(np.uint64), mark.view(np.uint64)
    with np.errstate(invalid="ignore"):
        able = (count > 0) & ~np.isnan(beaten) & ~np.isnan(most)
    least = np.minimum(least_place(beaten, most), np.uint64(2**52 - 1))
    room, held = np.empty(PLACES_HELD, np.uint64), np.empty(PLACES_HELD, np.uint64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(query: np.ndarray, member: np.ndarray, places: np.ndarray) -> None:
        if len(query) > PLACES_HELD // 8:  # many could win: the one with the largest place gives a sum to beat, too
            order = np.lexsort((places, query))
            last = order[np.append(query[order][1:] != query[order][:-1], True)]
            top = weigh(query[last], member[last]) + place_gumbel(places[last])
            raised = np.where(np.isfinite(top), least_place(top, most[query[last]]), np.uint64(0))
            some = places >= raised[np.searchsorted(query[last], query)]
            query, member, places = query[some], member[some], places[some]
        if len(query):
            found.append(_first_best(query, member, weigh(query, member) + place_gumbel(places)))

    edges = np.flatnonzero(np.append(True, (begin[1:] != begin[:-1]) | (count[1:] != count[:-1]))) if len(begin) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edges, len(begin)))
    wide = sizes * count[edges] >= WIDE
    for first, n in zip(edges[wide].tolist(), sizes[wide].tolist(), strict=True):
        rows, start, end = np.arange(first, first + n)[able[first : first + n]], int(begin[first]), int(begin[first] + count[first])
        across = min(end - start, PLACES_HELD)
        down = PLACES_HELD // across
        for left in range(start, end, across):
            marks = mark[left : min(left + across, end)]
            for at in range(0, len(rows), down):
                some = rows[at : at + down]
                size, shape = len(some) * len(marks), (len(some), len(marks))
                cells, places = _high_places(
                    high[some, None], low[some, None], marks, least[some, None], room[:size].reshape(shape), held[:size].reshape(shape)
                )
                if len(cells):
                    row, column = np.divmod(cells, len(marks))
                    keep(some[row], column + left, places)
    # Small groups are laid one behind the other.
    rest = np.flatnonzero(np.repeat(~wide, sizes) & able) if len(begin) else edges
    upto = np.cumsum(count[rest])
    at = 0
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES_HELD, side="right")))
        some = rest[at:stop]
        n = count[some]
        query = np.repeat(some, n)
        member = np.arange(len(query)) + np.repeat(begin[some] - (np.cumsum(n) - n), n)
        cells, places = _high_places(high[query], low[query], mark[member], least[query], room[: len(query)], held[: len(query)])
        if len(cells):
            keep(query[cells], member[cells], places)
        at = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _first_best(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _first_best(query: np.ndarray, member: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest score of each query; of equal ones that of the first member."""
    order = np.lexsort((-member, score, query))
    last = order[np.append(query[order][1:] != query[order][:-1], True)]
    return query[last], member[last], score[last]


def member_blocks(
    members: DataFrame, on: list[str], key: str, attrs: list[str], block_size: int = BLOCK_SIZE
) -> DataFrame:
    """``(*on, block, n_blocks, key, mark, *attrs)``: groups cut by a hash of the key into blocks
    of about ``block_size`` members, so that a hot group is many bounded ones."""
    sizes = members.groupBy(*on).agg(
        F.ceil(F.count("*") / F.lit(block_size)).cast("bigint").alias("n_blocks")
    )
    mark = hash_pair(F.col(key).cast("string"))[0]
    return members.join(sizes, on).select(
        *on, F.pmod(F.shiftright(mark, 8), F.col("n_blocks")).alias("block"), "n_blocks",
        F.col(key).alias("key"), mark.alias("mark"), *attrs,
    )


def _columns(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _met(
    queries: DataFrame, blocks: DataFrame, on: list[str], query_key: list[str],
    search: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: str,
) -> DataFrame:
    """``search`` over each pair of a part of the queries and a set of blocks of the members of a group.

    Small blocks meet the queries in sets of about ``BLOCK_SIZE`` members, so that copies of queries
    don't grow with the number of blocks, and small groups share a call.
    """
    plan = (
        queries.groupBy(*on).agg(F.count("*").alias("n_queries"))
        .join(blocks.groupBy(*on).agg(F.max("n_blocks").alias("n_blocks"), F.count("*").alias("n_members")), on)
    )
    plan = plan.withColumn("n_parts", F.ceil(F.col("n_queries") / F.lit(QUERY_PART)).cast("bigint")).withColumn(
        "n_set", F.greatest(F.floor(F.col("n_blocks") * F.lit(BLOCK_SIZE) / F.col("n_members")), F.lit(1)).cast("bigint")
    ).withColumn("n_sets", F.ceil(F.col("n_blocks") / F.col("n_set")).cast("bigint"))
    plan = cut_lineage(plan, "parts")
    rows = F.col("n_queries") * F.col("n_sets") + F.col("n_members") * F.col("n_parts")
    n_calls = int(plan.agg(F.sum(rows)).first()[0] or 0) // (QUERY_PART + BLOCK_SIZE) + 1
    call = F.pmod(F.xxhash64(*on, "block", "part"), F.lit(n_calls))

    def several(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    asked = queries.join(plan.select(*on, "n_parts", "n_sets"), on)
    asked = asked.withColumn("part", F.pmod(F.xxhash64(*query_key), F.col("n_parts")))
    asked = asked.withColumn("block", several("n_sets")).drop("n_parts", "n_sets")
    asking = blocks.drop("n_blocks").join(plan.select(*on, "n_parts", "n_set"), on)
    asking = asking.withColumn("block", F.floor(F.col("block") / F.col("n_set"))).withColumn("part", several("n_parts"))
    asking = asking.drop("n_parts", "n_set")
    asking = asking.toDF(*asking.columns)  # fresh identities, where queries and members are one table
    keys = [*on, "block", "part"]

    def both(asked_of: pa.Table, members_of: pa.Table) -> pa.Table:
        members_by, made = groups_of(members_of, keys), []
        for key, some in groups_of(asked_of, keys).items():
            if key in members_by:
                members = members_by[key]
                made += search(some, members.take(pc.sort_indices(members["key"])))
        return pa.concat_tables(made) if made else empty

    empty = empty_table(schema)
    return asked.groupBy(call).cogroup(asking.groupBy(call)).applyInArrow(both, schema)


def groups_of(rows: pa.Table, keys: list[str]) -> dict[tuple, pa.Table]:
    """The rows of each combination of keys."""
    if not rows.num_rows:
        return {}
    order = pc.sort_indices(rows, [(k, "ascending") for k in keys]).to_numpy()
    codes = np.stack([rows[k].combine_chunks().dictionary_encode().indices.to_numpy()[order] for k in keys])
    begins = np.append(0, np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1)
    names = zip(*(rows[k].take(pa.array(order[begins])).to_pylist() for k in keys), strict=True)
    cuts = zip(begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True)
    return {name: rows.take(pa.array(order[b:e])) for name, (b, e) in zip(names, cuts, strict=True)}


def empty_table(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def _spread(utilities: np.ndarray, rows: int) -> np.ndarray:
    return np.broadcast_to(np.atleast_2d(utilities), (rows, utilities.shape[-1]))


def with_runs(queries: DataFrame, query_key: list[str], epsilon: str, seed, sensitivity: float = 1.0) -> DataFrame:
    """Add ``_runs``, an array of ``(run, weight, high, low)``: the factor of a utility and the keys of the noise."""
    if queries.schema[epsilon].dataType.simpleString().startswith("array"):
        runs = F.col(epsilon)
    else:
        runs = F.array(F.struct(F.lit("").alias("run"), F.col(epsilon).cast("double").alias("eps")))

    def hashed(r: Column) -> Column:
        digest = F.md5(key_text(seed, r["run"], *[F.col(c) for c in query_key]))
        return F.struct(r["run"].alias("run"), (r["eps"] / F.lit(2.0 * sensitivity)).alias("weight"), digest.alias("digest"))

    def keyed(r: Column) -> Column:
        high, low = digest_pair(r["digest"])
        return F.struct(r["run"].alias("run"), r["weight"].alias("weight"), high.alias("high"), low.alias("low"))

    return queries.withColumn("_runs", F.transform(F.transform(runs, hashed), keyed))


def flat_runs(asked: pa.Table) -> tuple[np.ndarray, pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, run, weight and the two keys of each entry of ``_runs``."""
    flat, of = pc.list_flatten(asked["_runs"]), pc.list_parent_indices(asked["_runs"]).to_numpy()
    run, weight, high, low = (pc.struct_field(flat, i) for i in range(4))
    return of, run, weight.to_numpy(), high.to_numpy(), low.to_numpy()


def draw_one(
    queries: DataFrame,
    blocks: DataFrame,
    on: list[str],
    query_key: list[str],
    utility: Utility,
    epsilon: str,
    seed,
    sensitivity: float = 1.0,
    keep: tuple[str, ...] = (),
    shape: Shape = linear,
) -> DataFrame:
    """``(*query_key, run, score, chosen)``: the winner of each query and run, a struct of ``key`` and ``keep``.

    ``epsilon`` names the column of ``queries`` with the budget, or with an array of
    ``(run, eps)``; a single budget is the run ''.  A query whose group has no members has no row.
    """
    queries = with_runs(queries, query_key, epsilon, seed, sensitivity)
    names = ["key", *keep]

    def search(asked: pa.Table, members: pa.Table) -> Iterator[pa.Table]:
        of, run, weight, high, low = flat_runs(asked)
        mark = members["mark"].to_numpy()
        rows = max(1, CELLS // members.num_rows)
        alike = utility(asked.slice(0, 1), members)
        if alike.ndim == 1:  # one row for all queries: in the order of weights, each is shaped about once
            order = np.argsort(weight, kind="stable")
            of, run, weight, high, low = of[order], run.take(pa.array(order)), weight[order], high[order], low[order]
        for start in range(0, len(of), rows):
            some, w = of[start : start + rows], weight[start : start + rows]
            if alike.ndim == 1:
                w, place = np.unique(w, return_inverse=True)
                weighed = shape(_spread(alike, len(w)), w[:, None], members)
            else:
                first, last = int(some[0]), int(some[-1]) + 1
                known = _spread(utility(asked.slice(first, last - first), members), last - first)
                place, weighed = np.arange(len(some)), shape(known[some - first], w[:, None], members)
            at, top = winners(weighed, place, pair_places(high[start : start + rows], low[start : start + rows], mark))
            made = {c: asked[c].take(pa.array(some)) for c in query_key} | {"run": run.slice(start, len(some))}
            made["score"] = pa.array(top)
            yield pa.table(made | {c: members[c].take(pa.array(at)) for c in names})

    schema = f"{_columns(queries, query_key)}, run string, score double, {_columns(blocks, names)}"
    best = _met(queries, blocks, on, query_key, search, schema)
    top = F.max(F.struct("score", F.struct(*names).alias("chosen"))).alias("best")
    return best.groupBy(*query_key, "run").agg(top).select(*query_key, "run", "best.score", "best.chosen")


def keyed(queries: DataFrame, query_key: list[str], epsilon: str, seed, run: Column) -> DataFrame:
    """Add ``weight``, the factor of a utility, and ``high, low``, the keys of the noise that ``with_runs`` gives the run."""
    text = key_text(seed, run, *[F.col(c) for c in query_key if c != "run"])
    rows = queries.withColumn("weight", F.col(epsilon).cast("double") / F.lit(2.0)).withColumn("_digest", F.md5(text))
    high, low = digest_pair(F.col("_digest"))
    return rows.withColumn("high", high).withColumn("low", low).drop("_digest")


def above(weights: np.ndarray, utilities: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Log of what a member weighs besides its part of the base, above which its utility is by ``more``."""
    with np.errstate(divide="ignore"):
        return weights * utilities + np.log(-np.expm1(-weights * more))


def draw_above(queries: DataFrame, members: DataFrame, on: str, query_key: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """``(*query_key, score, near)``: the winner among the members of each query's group, where it can be above ``beaten``.

    ``queries(*query_key, <on>, weight, high, low, beaten)`` come from ``keyed``, ``members`` has
    ``<on>, candidate, u, u0``.  Large groups are cut into parts of ``ASKED_PART`` queries and
    ``LISTED_PART`` members; ``sizes(<on>, n)`` may say about how many members a group has.
    """
    sizes = (members.groupBy(on).agg(F.count("*").alias("n")) if sizes is None else sizes).where(F.col(on).isNotNull())
    plan = cut_lineage(queries.groupBy(on).agg(F.count("*").alias("_q")).join(sizes.select(on, F.col("n").alias("_m")), on), "parts")
    total = plan.agg(F.sum(F.col("_q") + F.col("_m")), F.sum(F.col("_q").cast("double") * F.col("_m"))).first()
    n_calls = max(int(total[0] or 0) // CALL_ROWS, int((total[1] or 0) // CALL_PAIRS)) + 1
    n_parts, n_sets = F.ceil(F.col("_q") / F.lit(ASKED_PART)), F.ceil(F.col("_m") / F.lit(LISTED_PART))
    # Few groups are cut: a part or a set of each is full.
    hot = F.broadcast(plan.select(on, n_parts.alias("_parts"), n_sets.alias("_sets")).where("_parts > 1 or _sets > 1"))

    def dealt(rows: DataFrame, own: str, n_own: str, other: str, n_other: str, key: list[str]) -> DataFrame:
        one = F.lit(1).cast("bigint")
        rows = rows.join(hot, on, "left").withColumn(own, F.pmod(F.xxhash64(*key), F.coalesce(n_own, one)))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n_other, one) - 1)))
        rows = rows.drop("_parts", "_sets").withColumn("call", F.pmod(F.xxhash64(on, "part", "set"), F.lit(n_calls)))
        rows = rows.toDF(*rows.columns)  # fresh identities, since both sides may come from the same tables
        return rows.repartition(min(2 * n_calls, MOST_TASKS), "call").groupBy("call")

    keys = [on, "part", "set"]

    def search(asked: pa.Table, listed: pa.Table) -> pa.Table:
        if not asked.num_rows or not listed.num_rows:
            return empty
        groups, codes = group_codes(listed, asked, keys)
        listed = listed.append_column("_code", pa.array(groups)).sort_by([("_code", "ascending"), ("candidate", "ascending")])
        order = np.argsort(codes, kind="stable")
        order = order[np.searchsorted(codes[order], 0) :]
        groups, codes, asked = listed["_code"].to_numpy(), codes[order], asked.take(pa.array(order))
        begin, end = (np.searchsorted(groups, codes, side) for side in ("left", "right"))
        weight, high, low, beaten = (asked[c].to_numpy() for c in ("weight", "high", "low", "beaten"))
        u, more, mark = listed["u"].to_numpy(), listed["u"].to_numpy() - listed["u0"].to_numpy(), text_marks(listed["candidate"])
        first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        at = np.searchsorted(first, begin)
        most = above(weight, np.maximum.reduceat(u, first)[at], np.maximum.reduceat(more, first)[at]) if len(at) else weight
        query, member, score = winners_above(
            high, low, beaten, most, begin, end - begin, mark, lambda q, m: above(weight[q], u[m], more[m])
        )
        made = asked.select(query_key).take(pa.array(query))
        return made.append_column("score", pa.array(score)).append_column("near", listed["candidate"].take(pa.array(member)))

    schema = ", ".join([*(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in query_key), "score double, near string"])
    empty = empty_table(schema)
    asked = dealt(queries.select(*query_key, on, "weight", "high", "low", "beaten"), "part", "_parts", "set", "_sets", query_key)
    listed = dealt(members.select(on, "candidate", "u", "u0"), "set", "_sets", "part", "_parts", ["candidate"])
    found = cut_lineage(asked.cogroup(listed).applyInArrow(search, schema), "drawn")
    best = found.groupBy(*query_key).agg(F.max(F.struct("score", "near")).alias("best"))
    return best.select(*query_key, "best.score", "best.near")


def group_codes(left: pa.Table, right: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each combination of keys of ``left``, and those of ``right``: -1 where ``left`` has none."""
    both = [np.zeros(t.num_rows, np.int64) for t in (left, right)]
    missing = np.zeros(right.num_rows, bool)
    for key in keys:
        known = pc.unique(left[key])
        at = [pc.fill_null(pc.index_in(t[key], known), -1).to_numpy().astype(np.int64) for t in (left, right)]
        missing |= at[1] < 0
        both = [np.where(x < 0, 0, b * len(known) + x) for b, x in zip(both, at, strict=True)]
        if len(known) > 1:  # numbers stay below the number of rows
            held, both[0] = np.unique(both[0], return_inverse=True)
            place = np.minimum(np.searchsorted(held, both[1]), len(held) - 1)
            missing |= held[place] != both[1]
            both[1] = place
    return both[0], np.where(missing, -1, both[1])


def text_marks(texts: pa.ChunkedArray) -> np.ndarray:
    """``hash_pair(text)[0]`` of each text."""
    coded = texts.combine_chunks().dictionary_encode()
    halves = b"".join(hashlib.md5(t.encode()).digest()[:8] for t in coded.dictionary.to_pylist())
    return np.frombuffer(halves, ">i8").astype(np.int64)[coded.indices.to_numpy()]


def topk_in_group(
    queries: DataFrame, blocks: DataFrame, on: list[str], query_key: list[str], utility: Utility, k: int
) -> DataFrame:
    """``(*query_key, rank, key, utility)``: the ``k`` best members of each query's group, ties to
    the smaller key.  Every block contributes at most ``k`` rows, of which a rank keeps ``k``."""

    def search(asked: pa.Table, members: pa.Table) -> Iterator[pa.Table]:
        rows = max(1, CELLS // members.num_rows)
        for start in range(0, asked.num_rows, rows):
            some = asked.slice(start, rows)
            known = _spread(utility(some, members), some.num_rows)
            # Members are sorted by key, so a stable sort leaves ties in its order.
            at = np.argsort(-known, axis=1, kind="stable")[:, :k]
            of = pa.array(np.repeat(np.arange(some.num_rows), at.shape[1]))
            made = {c: some[c].take(of) for c in query_key} | {"key": members["key"].take(pa.array(at.ravel()))}
            yield pa.table(made | {"utility": pa.array(np.take_along_axis(known, at, axis=1).ravel())})

    schema = f"{_columns(queries, query_key)}, {_columns(blocks, ['key'])}, utility double"
    rows = _met(queries, blocks, on, query_key, search, schema)
    order = Window.partitionBy(*query_key).orderBy(F.desc("utility"), "key")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        *query_key, "rank", "key", "utility"
    )


def candidate_stats(
    queries: DataFrame, blocks: DataFrame, on: list[str], query_key: list[str], utility: Utility
) -> DataFrame:
    """``(*query_key, n_candidates, max_utility, mean_utility)`` over each query's group."""

    def search(asked: pa.Table, members: pa.Table) -> Iterator[pa.Table]:
        rows = max(1, CELLS // members.num_rows)
        for start in range(0, asked.num_rows, rows):
            some = asked.slice(start, rows)
            known = _spread(utility(some, members), some.num_rows)
            made = {c: some[c] for c in query_key} | {"n": pa.array(np.full(some.num_rows, members.num_rows, np.int64))}
            yield pa.table(made | {"most": pa.array(known.max(axis=1)), "total": pa.array(known.sum(axis=1))})

    schema = f"{_columns(queries, query_key)}, n bigint, most double, total double"
    return _met(queries, blocks, on, query_key, search, schema).groupBy(*query_key).agg(
        F.sum("n").alias("n_candidates"), F.max("most").alias("max_utility"),
        (F.sum("total") / F.sum("n")).alias("mean_utility"),
    )


def exponential_mechanism(
    candidates: DataFrame,
    group: list[str],
    key: str,
    utility: str,
    epsilon: Column,
    seed,
    sensitivity: float = 1.0,
) -> DataFrame:
    """``(*group, chosen)`` from a table that lists the candidates of every group."""
    score = epsilon * F.col(utility) / F.lit(2.0 * sensitivity) + gumbel(
        seed, *[F.col(c) for c in group], F.col(key)
    )
    return candidates.groupBy(*group).agg(F.max_by(key, score).alias("chosen"))


def exponential_probs(
    candidates: DataFrame,
    group: list[str],
    utility: str,
    epsilon: Column,
    sensitivity: float = 1.0,
) -> DataFrame:
    """Add ``prob``, the exact selection probability.

    The maximum and the normalising sum are pre-aggregated and joined back, so a hot group is
    never gathered in one task.
    """
    scored = candidates.withColumn("_s", epsilon * F.col(utility) / F.lit(2.0 * sensitivity))
    tops = scored.groupBy(*group).agg(F.max("_s").alias("_top"))
    shifted = scored.join(tops, group).withColumn("_w", F.exp(F.col("_s") - F.col("_top")))
    totals = shifted.groupBy(*group).agg(F.sum("_w").alias("_z"))
    return (
        shifted.join(totals, group)
        .withColumn("prob", F.col("_w") / F.col("_z"))
        .drop("_s", "_top", "_w", "_z")
    )
