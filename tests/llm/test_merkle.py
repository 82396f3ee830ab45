"""Manifests and proofs against a plain recursive version."""

import random
import zlib
from hashlib import sha256

import pytest

from veilmill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, tree string, root string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """The top, and for each leaf the siblings to its left and right, level by level."""
    paths, groups = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, joined = [], []
        for k in range(0, len(digests), 16):
            run = digests[k : k + 16]
            for j in range(len(run)):
                for i in groups[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            joined.append([i for g in groups[k : k + 16] for i in g])
        digests, groups = up, joined
    return digests[0], paths


def brute(rows):
    sources = {}
    for r in rows:
        i, text, lang, source, n = r[:5]
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        now = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if hit and text is not None else text
        sources.setdefault(source, []).append((i is not None, i or 0, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, now)), i))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order]
    root, tops = tree([s[0] for s in subs])
    out = []
    for s, (subroot, paths), above in zip(order, subs, tops, strict=True):
        for x, path in zip(sorted(sources[s], key=lambda x: x[:3]), paths, strict=True):
            folded = x[3]
            for left, right in path + above:
                folded = h(left, folded, right)
            out.append(repr((x[4], x[2], subroot, root, h(*(p for step in path + above for p in step)), folded, folded == root)))
    return sorted(out)


def rows_of(sizes, seed=1):
    rnd = random.Random(seed)
    rows = []
    for source, size in sizes.items():
        for _ in range(size):
            text = rnd.choice([None, "", "Some TEXT", "ünï", "lower", "A" * rnd.randrange(40)])
            rows.append((len(rows) * 3, text, rnd.choice([None, "en"]), source, rnd.choice([None, 5]), 1, "x", "y"))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [4, 1])
def test_manifest_matches_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)  # one level a sweep: many blocks, messages through tables
    rows = rows_of({None: 3, "a": 1, "é": 16, "z": 17, "b": 300, "": 33} | ({f"s{k}": 1 for k in range(20)} if height == 1 else {}))
    rows += [rows[0], rows[0], (None, "No ID", "en", "b", 1, 1, "x", "y"), (None, None, None, None, None, 1, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs, now={"text": merkle.lowered()})
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_changes_show(spark):
    docs = spark.createDataFrame(rows_of({"a": 40}), SCHEMA)
    assert {r.verified for r in merkle.manifest(docs).collect()} == {True}
    from pyspark.sql import functions as F

    changed = merkle.manifest(docs, now={"lang": F.when(F.col("doc_id") == 30, "xx").otherwise(F.col("lang"))})
    assert [r.doc_id for r in changed.where("not verified").collect()] == [30]


def test_one_row_and_none(spark):
    one = merkle.manifest(spark.createDataFrame(rows_of({"a": 1}), SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h()
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_queue_climbs_like_levels():
    for n in (1, 2, 16, 17, 256, 257, 700):
        digests = [h(str(i)) for i in range(n)]
        top, paths = tree(digests)
        levels = merkle._levels(n)
        made, taken = merkle.climb(digests, levels)
        assert made == top
        for k, path in merkle.descend(n, taken, levels, None):
            assert [(s["left"], s["right"]) for s in merkle._packed(path)] == paths[k]
            assert merkle.fold(digests[k], path) == top
