"""draws against a base hash each pair once, slots are split in whole arrays, shuffles end with their query."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmill import session
from veilmill.functions import runs
from veilmill.functions import text as tx
from veilmill.operators import draw
from veilmill.operators import tokens as tk


@pytest.mark.parametrize("beaten, wide, held", [(-np.inf, 50, 64), (3.0, 10**9, 1 << 14), (3.0, 1, 1 << 14), (12.0, 200, 256)])
def test_winners_above_are_those_of_all_pairs(monkeypatch, beaten, wide, held):
    monkeypatch.setattr(draw, "WIDE", wide)
    monkeypatch.setattr(draw, "PLACES_HELD", max(held, 64))
    rng = np.random.default_rng(8)
    high, low = rng.integers(-(2**63), 2**63 - 1, (2, 400))
    mark, u, weight = rng.integers(-(2**63), 2**63 - 1, 300), rng.random(300), rng.random(400) * 9
    weight[7] = np.nan
    begin, count = np.repeat([0, 40, 41, 41, 300], 80), np.repeat([40, 1, 60, 259, 0], 80)
    at = np.minimum(begin, 299)
    least = np.full(400, beaten)
    most = weight * [u[b : b + n].max() if n else 0 for b, n in zip(at, count)]
    query, member, score = draw.winners_above(high, low, least, most, begin, count, mark, lambda q, m: weight[q] * u[m])
    scores = weight[:, None] * u + draw.pair_gumbel(high, low, mark)
    scores[(np.arange(300) < begin[:, None]) | (np.arange(300) >= (begin + count)[:, None])] = -np.inf
    scores[7] = -np.inf
    best = scores.max(axis=1)
    found = dict(zip(query.tolist(), zip(member.tolist(), score.tolist())))
    assert len(found) == len(query) and set(np.flatnonzero(best > beaten).tolist()) <= found.keys()
    assert all(found[i] == (scores[i].argmax(), best[i]) for i in np.flatnonzero(best > beaten).tolist())


def test_tokens_of_whole_arrays():
    every = "".join(map(chr, [*range(1, 400), 0x2028, 0x3000, 0x1F600])) + " a1b2-c3 été"
    texts = ["One, two 3x.", "", None, "...", " \t\x0b", every, every[::-1], "end", "end"]
    tokens, counts, is_word = runs.split_tokens(pa.array(["skipped", *texts])[1:])
    expected = [re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0b\f\r]", t or "") for t in texts]
    assert tokens.to_pylist() == [t for some in expected for t in some] and counts.tolist() == [len(x) for x in expected]
    assert is_word.tolist() == [t not in tx.PUNCTUATION for t in tokens.to_pylist()]


def test_slots_are_those_of_the_expressions(spark):
    rows = [(1, "One, two! ÉÀ 3x."), (1, ", É b"), (None, "a"), (4, ""), (5, None), (6, "x y z, w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (None, 3):
        toks = docs.select("doc_id", tx.truncate_tokens(tx.tokens(F.col("text")), most).alias("t")).collect()
        expected = []
        for r in toks:
            words = [t for t in r.t or [] if t not in tx.PUNCTUATION]
            before = tk.START
            for pos, t in enumerate(r.t or []):
                is_word = t not in tx.PUNCTUATION
                expected.append((r.doc_id, pos, t, before if is_word else None, is_word, 6.0 / len(words) if words else None))
                before = t.lower() if is_word else before
        made = [tuple(x) for x in tk.word_slots(docs, F.lit(6.0), most).collect()]
        assert sorted(made, key=repr) == sorted(expected, key=repr)


def test_large_groups_are_cut(spark, monkeypatch):
    members = spark.createDataFrame([("p", f"c{i}", 0.5 + i / 200, 0.2) for i in range(60)] + [("q", "c1", 0.9, 0.1)], "prev string, candidate string, u double, u0 double")
    base = tk.base_of(spark.createDataFrame([(f"c{i}",) for i in range(70)], "word string"), F.lit(0.1))
    slots = spark.createDataFrame([(i, 0, "w", True, "pq"[i % 9 == 0], 60.0) for i in range(200)], "doc_id long, pos int, token string, is_word boolean, prev string, eps double")
    whole = sorted(map(tuple, tk.redrawn(slots, members, base, "prev", "s").collect()))
    for name in ("ASKED_PART", "LISTED_PART", "CALL_ROWS", "CALL_PAIRS"):
        monkeypatch.setattr(draw, name, 7)
    assert sorted(map(tuple, tk.redrawn(slots, members, base, "prev", "s").collect())) == whole


def test_shuffles_end_with_the_write(spark):
    known = spark.conf.get(session._CLEANUP)
    seen = []
    with session.shuffles_end(spark), session.shuffles_end(spark):
        seen.append(spark.conf.get(session._CLEANUP))
    with pytest.raises(ValueError), session.shuffles_end(spark):
        raise ValueError
    assert seen == ["true"] and spark.conf.get(session._CLEANUP) == known and not session._writing


def test_words_of_a_base_too_large_to_send(spark, monkeypatch):
    """slots are not exchanged by rank where the vocabulary is small, with the same words."""
    docs = spark.createDataFrame([(i, "a b, c d") for i in range(40)], "doc_id long, text string")
    near = spark.createDataFrame([("a", "b", 0.2), ("c", "c", 0.0)], "word string, candidate string, distance double")
    words = spark.createDataFrame([(f"w{i}",) for i in range(90)], "word string")
    made, plans = [], []
    for most in (tk.MOST_WORD_BYTES, -1):
        monkeypatch.setattr(tk, "MOST_WORD_BYTES", most)
        frame = tk.replace_words(docs, near, words, F.lit(40.0), 1.0, "s")
        made.append(sorted(map(tuple, frame.collect())))
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert made[0] == made[1] and plans[0] < plans[1]


def test_a_temporary_table_goes(spark):
    with session.temporary(spark.range(5)) as held:
        path = held.inputFiles()[0]
        assert held.count() == 5
    assert not spark._jvm.java.io.File(path.removeprefix("file:")).getParentFile().exists()
