"""The signature-tree join against brute force."""

import random
import re

import numpy as np
import pytest

from veilmill.llm import sigtrees

SCHEMA = "doc_id long, text string, id long, comp long, n int, sig string, version int"


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(repr((r[0], len(s), least.get(g))) for r, s, g in zip(rows, sets, group, strict=True))


def edited(rnd, words, share):
    return [rnd.choice("abcdefgh") * 4 if rnd.random() < share else w for w in words]


def varied(seed):
    """Families of near copies about the threshold, a passage that many share, and odd rows."""
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    rows = [None, "", " \n\t", "one", "One", "two words", "TWO\twords", "é è ê ë ì", "x " * 300, "y z " * 200]
    for family in range(6):
        base = [f"f{family}w{rnd.randrange(500)}" for _ in range(rnd.randrange(30, 200))]
        rows += [" ".join(edited(rnd, base, rnd.choice([0.0, 0.01, 0.02, 0.04, 0.08]))) for _ in range(25)]
    rows += [" ".join([f"a{i}b{rnd.randrange(9)}" for _ in range(rnd.randrange(3, 14))] + passage) for i in range(60)]
    long = [f"l{rnd.randrange(4000)}" for _ in range(6000)]
    rows += [" ".join(long), " ".join(edited(rnd, long, 0.015)), " ".join(edited(rnd, long, 0.3))]
    out = [(i, t) for i, t in enumerate(rows)]
    return [*out, out[30], (None, rows[40]), (None, None), (None, "alone with no id at all")]


@pytest.mark.parametrize("small", [False, True])
def test_classes_match_brute_force(spark, monkeypatch, small):
    if small:  # shards cut into parts, several turns, and batches of few rows
        monkeypatch.setattr(sigtrees, "PART", 6)
        monkeypatch.setattr(sigtrees, "_ROWS", 40)
        monkeypatch.setattr(sigtrees, "_PAIRS", 16)
        monkeypatch.setattr(sigtrees, "SAMPLE", 0)
    rows = varied(small)
    docs = spark.createDataFrame([(*r, 1, 1, 1, "s", 1) for r in rows], SCHEMA).repartition(3)
    got = sigtrees.memberships(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_no_rows(spark):
    assert sigtrees.memberships(spark.createDataFrame([], SCHEMA)).count() == 0


def test_walk_loses_no_pair():
    rnd = np.random.default_rng(4)
    base = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
    sets = []
    for _ in range(120):
        keep = base[rnd.random(len(base)) > rnd.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rnd.integers(0, 2**63, rnd.integers(0, 60)).astype(np.uint64)])))
    sig = np.empty(len(sets), object)
    sig[:] = [sigtrees.signature(s) for s in sets]
    size = np.array([len(s) for s in sets])
    ids = np.arange(len(sets))
    same = np.zeros(len(sets), np.int64)
    columns = {"key": same, "low": same, "high": same, "part": same, "id": ids, "comp": ids, "n": size, "rest": size, "sig": sig}
    members = sigtrees.Members(columns, sigtrees.SHARE)
    found = {tuple(sorted((int(members.of["id"][i]), int(members.of["id"][j])))) for a, b in members.pairs() for i, j in zip(a, b, strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                assert (j, i) in found
    assert len(found) < len(sets) * (len(sets) - 1) / 2
