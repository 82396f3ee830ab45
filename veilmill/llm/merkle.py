"""A Merkle manifest of a dataset with a proof for every row, by time-forward processing.

Rows are leaves, ordered by id within their source; runs of ``FAN`` consecutive nodes become one node, level by
level, until a source has one node, its subroot; subroots, ordered by source, become the root likewise.

Nodes are labelled in postorder: (last leaf below, level).  A sweep in the order of labels takes from a priority
queue the digests sent to the next node and sends that node's digest to its parent.  The queue is external: a
sweep covers blocks of ``FAN ** HEIGHT`` consecutive nodes, and a message whose receiver lies beyond its block is
a row of a table, which Spark deals and sorts by receiver for the next sweep.  A source of any size is thus many
blocks, and within a block the queue holds at most ``FAN`` messages a level.  A reversed sweep then sends proofs
down, from the root's block to the leaves: each node passes its own on to its children, with their siblings.

Positions come from one range sort of narrow rows and the counts of its parts, never from a window over a source.

Defined results: null values are ``-`` in a leaf; null ids come first, rows of one id follow their leaf digests
(equal rows are interchangeable); null sources are one source, before all others.  A null id is never tampered with.
An empty table has no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmill.session import cut_lineage

FAN = 16
HEIGHT = 4  #: levels that a sweep climbs
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: ``-`` for a null, else the count of UTF-8 bytes, a colon and the value."""
    def part(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in values]), 256)


class Path(NamedTuple):
    """What a node lacks for the root: its siblings on either side, and its parent's path."""

    left: str
    right: str
    above: Path | None


def _levels(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // FAN), level + 1
    return level


def _parent(index: int, level: int, n: int) -> tuple[int, int]:
    """The label of the parent of node ``index`` at ``level`` over ``n`` leaves."""
    return min((index // FAN + 1) * FAN ** (level + 1), n) - 1, level + 1


def climb(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The node ``levels`` above all ``digests``, and the digests that each inner node took, by label."""
    n, taken = len(digests), {}
    queue: list[tuple[tuple[int, int], int, str]] = []
    if not levels:
        return digests[0], taken

    def deliver(upto: int) -> str:
        made = ""
        while queue and queue[0][0][0] <= upto:
            label = queue[0][0]
            children = taken[label] = []
            while queue and queue[0][0] == label:
                _, index, child = heapq.heappop(queue)
                children.append(child)
            made = digest(*children)
            if label[1] < levels:
                heapq.heappush(queue, (_parent(index // FAN, label[1], n), index // FAN, made))
        return made

    top = ""
    for at, leaf in enumerate(digests):
        heapq.heappush(queue, (_parent(at, 0, n), at, leaf))
        top = deliver(at)
    return top, taken


def descend(n: int, taken: dict[tuple[int, int], list[str]], levels: int, path: Path | None) -> Iterator[tuple[int, Path | None]]:
    """The path of each of ``n`` leaves, last leaf first; ``path`` is that of the node above them all."""
    queue = [((-(n - 1), -levels), 0, path)]
    while queue:
        (end, level), index, path = heapq.heappop(queue)
        if level == 0:
            yield index, path
            continue
        children = taken[-end, -level]
        for k, _ in enumerate(children):
            child = index * FAN + k
            last = min((child + 1) * FAN ** (-level - 1), n) - 1
            beside = Path("".join(children[:k]), "".join(children[k + 1 :]), path)
            heapq.heappush(queue, ((-last, level + 1), child, beside))


def _packed(path: Path | None) -> list[dict[str, str]]:
    out = []
    while path is not None:
        out.append({"left": path.left, "right": path.right})
        path = path.above
    return out


def _unpacked(steps) -> Path | None:
    path = None
    for step in reversed(list(steps)):
        path = Path(step["left"], step["right"], path)
    return path


def fold(leaf: str, path: Path | None) -> str:
    """The root that a leaf and its siblings give."""
    while path is not None:
        leaf, path = digest(path.left, leaf, path.right), path.above
    return leaf


def proof(path: Path | None) -> str:
    parts = []
    while path is not None:
        parts += path.left, path.right
        path = path.above
    return digest(*parts)


# ---- sweeps over tables (tree, at, digest, n) ------------------------------------------------


def _block(at: str = "at") -> Column:
    return F.shiftright(at, 4 * HEIGHT)


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place within their tree, and ``n``, its size."""
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "_row")
    ranged = ranged.sortWithinPartitions(tree, *order, "_row").drop("_row")
    ranged = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    parts = ranged.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    # As many rows a tree as the sort had partitions.
    whole = Window.partitionBy(tree)
    parts = parts.select(
        tree, "_part", "_first", F.sum("_count").over(whole).alias("n"),
        (F.sum("_count").over(whole.orderBy("_part")) - F.col("_count")).alias("_before"),
    )
    return ranged.join(parts, [tree, "_part"]).withColumn("at", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_part", "_first", "_before", "_at"
    )


def _forward(nodes: DataFrame) -> DataFrame:
    """The node above each block."""
    def sweep(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        n = int(block["n"].iloc[0])
        top, _ = climb(block["digest"].tolist(), min(HEIGHT, _levels(n)))
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "digest": [top], "n": [-(-n // FAN**HEIGHT)]})

    return nodes.select("tree", "at", "digest", "n", _block().alias("block")).groupBy("tree", "block").applyInPandas(
        sweep, "tree string, at long, digest string, n long"
    )


def forest(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes, from the leaves up, each the tops of the blocks of the one before; the last has the roots."""
    tables = [leaves]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tables.append(cut_lineage(_forward(tables[-1]), "nodes"))
    return tables


def _reverse(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages to the nodes of a table from those to the tops of its blocks: ``tree, at, subroot, root, path``."""
    def sweep(key: tuple, block: pd.DataFrame, message: pd.DataFrame) -> pd.DataFrame:
        block, message = block.sort_values("at"), message.iloc[0]
        levels = min(HEIGHT, _levels(int(block["n"].iloc[0])))
        _, taken = climb(block["digest"].tolist(), levels)
        first = int(block["at"].iloc[0])
        paths = [(first + k, _packed(p)) for k, p in descend(len(block), taken, levels, _unpacked(message["path"]))]
        return pd.DataFrame(
            {"tree": key[0], "at": [a for a, _ in paths], "subroot": message["subroot"], "root": message["root"],
             "path": [p for _, p in paths]}
        )

    return _cogrouped(nodes, messages).applyInPandas(sweep, f"tree string, at long, subroot string, root string, path {_PROOF}")


def _cogrouped(nodes: DataFrame, messages: DataFrame):
    nodes = nodes.withColumn("block", _block()).groupBy("tree", "block")
    return nodes.cogroup(messages.withColumnRenamed("at", "block").groupBy("tree", "block"))


def _answers(leaves: DataFrame, messages: DataFrame, doc_id: str) -> DataFrame:
    """The last reversed sweep: proofs of the leaves, used at once and not kept."""
    fields = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def sweep(block: pd.DataFrame, message: pd.DataFrame) -> pd.DataFrame:
        block, message = block.sort_values("at"), message.iloc[0]
        levels = min(HEIGHT, _levels(int(block["n"].iloc[0])))
        leaf, seen, ids = (block[c].tolist() for c in ("digest", "seen", "doc_id"))
        _, taken = climb(leaf, levels)
        root, rows = message["root"], []
        for k, path in descend(len(leaf), taken, levels, _unpacked(message["path"])):
            folded = fold(seen[k], path)
            rows.append((ids[k], leaf[k], message["subroot"], root, proof(path), folded, folded == root))
        return pd.DataFrame({f: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(fields)})

    kind = leaves.schema["doc_id"].dataType.simpleString()
    made = _cogrouped(leaves.select("tree", "at", "n", "doc_id", "digest", "seen"), messages).applyInPandas(
        sweep, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return made.withColumnRenamed("doc_id", doc_id)


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "doc_id", source: str = "source",
    now: dict[str, Column] | None = None,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``now`` gives the present values of columns that may have been changed since the manifest was made:
    the root is folded again from them and the untouched siblings.
    """
    now = now or {}
    rows = docs.select(
        F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("tree"),
        F.col(doc_id).alias("doc_id"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        leaf_digest([now.get(c, F.col(c)) for c in columns]).alias("seen"),
    )
    leaves = cut_lineage(placed(cut_lineage(rows, "leaves"), "tree", ["doc_id", "digest"]), "placed")
    tables = forest(leaves)
    subroots = placed(
        tables[-1].select("tree", "digest").withColumnRenamed("tree", "label").withColumn("tree", F.lit("")), "tree", ["label"]
    )
    tops = forest(cut_lineage(subroots, "subroots"))
    none = F.array().cast(_PROOF)
    sent = tops[-1].select("tree", "at", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("path"))
    for table in reversed(tops[:-1]):
        sent = cut_lineage(_reverse(table, sent), "proofs")
    # The message to the top of a source's tree carries its subroot.
    sent = tops[0].join(sent.select("tree", "at", "root", "path"), ["tree", "at"]).select(
        F.col("label").alias("tree"), F.lit(0).cast("bigint").alias("at"), F.col("digest").alias("subroot"), "root", "path"
    )
    for table in reversed(tables[1:-1]):
        sent = cut_lineage(_reverse(table, sent), "proofs")
    return _answers(leaves, sent, doc_id)


def lowered(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The tampering that the manifest is tried with: A-Z lower-cased where 5 divides the id's crc32."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(F.col(text), ascii_uppercase, ascii_lowercase)).otherwise(F.col(text))


def _sql_leaf(text: str) -> str:
    def part(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    return f"sha256({' || '.join(part(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

MANIFEST_SQL = f"""
WITH RECURSIVE
d AS (
  SELECT *, CASE WHEN {_CRC32} % 5 = 0 THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END AS now
  FROM documents),
h AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf('now')} AS seen FROM d),
leaves AS (
  SELECT *, row_number() OVER () AS r, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
up AS (
  SELECT source, 0 AS level, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM up WHERE n > 1 GROUP BY source, level, pos // 16),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, pos // 16),
runs AS (SELECT source, level, pos // 16 AS run, list(digest ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, pos // 16 AS run, list(digest ORDER BY pos) AS nodes FROM top WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT r, source, 0 AS level, pos, seen AS now, '' AS proof FROM leaves
  UNION ALL
  SELECT r, walk.source, walk.level + 1, pos // 16,
         sha256(array_to_string(nodes[:pos % 16], '') || now || array_to_string(nodes[pos % 16 + 2:], '')),
         proof || array_to_string(nodes[:pos % 16], '') || array_to_string(nodes[pos % 16 + 2:], '')
  FROM walk JOIN runs ON walk.source IS NOT DISTINCT FROM runs.source AND walk.level = runs.level AND pos // 16 = run),
arrived AS (SELECT r, max_by(now, level) AS now, max_by(proof, level) AS proof FROM walk GROUP BY r),
climbed AS (
  SELECT r, 0 AS level, subroots.pos, now, proof FROM arrived JOIN leaves USING (r)
  JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source
  UNION ALL
  SELECT r, climbed.level + 1, pos // 16,
         sha256(array_to_string(nodes[:pos % 16], '') || now || array_to_string(nodes[pos % 16 + 2:], '')),
         proof || array_to_string(nodes[:pos % 16], '') || array_to_string(nodes[pos % 16 + 2:], '')
  FROM climbed JOIN top_runs ON climbed.level = top_runs.level AND pos // 16 = run),
ended AS (SELECT r, max_by(now, level) AS now, max_by(proof, level) AS proof FROM climbed GROUP BY r)
SELECT doc_id, leaf, subroot, top.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = top.digest AS verified
FROM leaves JOIN ended USING (r) JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source CROSS JOIN top WHERE top.n = 1
"""
