"""a sweep's texts, draws and word vectors are exchanged and hashed no more than needed."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilmill.functions import rng
from veilmill.functions import text as tx
from veilmill.operators import draw, ngram_lm, wordvecs
from veilmill.operators import sweep as sw
from veilmill.plans import queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_exchanged_by_dataset(spark, monkeypatch):
    rows = [("a", 1, "one two three four"), ("a", 2, None), (None, 3, "x"), ("b", 4, "five, six"), ("b", 4, "five, six")]
    docs = spark.createDataFrame(rows, "dataset string, doc_id long, text string")
    plans, written = [], sw.cut_lineage
    monkeypatch.setattr(sw, "cut_lineage", lambda df, name: plans.append(_plan(df)) or written(df, name))
    made = sw.sweep(docs, sw.epsilon_grid(docs, (0.5, 1.0)), "m", lambda d: d.select("doc_id", F.inline("runs"), "text").drop("eps"))
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
    found = sorted((r.dataset, r.epsilon, r.doc_id) for r in made.collect())
    assert found == sorted([("a", e, i) for e in (2.0, 4.0) for i in (1, 2)] + [("b", e, 4) for e in (1.0, 2.0) for _ in range(4)])


def test_one_hash_for_each_run_of_a_query(spark):
    runs = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(e).alias("eps")) for r, e in (("a", 1.0), ("b", None))))
    asked = spark.range(300).withColumn("runs", runs)
    made = draw.with_runs(asked, ["id"], "runs", "s")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    for row in made.collect():
        for run, weight, high, low in row["_runs"]:
            digest = hashlib.md5(f"s|{run}|{row.id}".encode()).digest()
            assert (high, low) == tuple(int.from_bytes(x, "big", signed=True) for x in (digest[:8], digest[8:]))
            assert weight == {"a": 0.5, "b": None}[run]
    ends = spark.createDataFrame([("0" * 16 + "f" * 16,), ("8" + "0" * 15 + "7" + "f" * 15,)], "digest string")
    pairs = [tuple(r) for r in ends.select(*rng.digest_pair(F.col("digest"))).collect()]
    assert pairs == [(0, -1), (-(2**63), 2**63 - 1)]


def test_sums_by_word_need_no_exchange_of_their_own(spark):
    texts = [(f"w{i % 7} w{i % 5} w{i % 3} the", ) for i in range(60)]
    lm = ngram_lm.train_ngram_lm(spark.createDataFrame(texts, "text string"))
    info = wordvecs.information(lm)
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [_plan(x).count("Exchange hashpartitioning") for x in (info, wordvecs.projected(info))] == [4, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert all(r.bits == int(hashlib.md5(r.context.encode()).hexdigest()[:13], 16) for r in info.collect())


def test_words_of_a_text_are_counted_without_a_list(spark):
    every = "".join(map(chr, range(1, 300))) + " \U0001f600́ a1b2-c3 été"
    rows = [(t,) for t in ("", None, "one, two", "...", "a_b", every, every[::-1], " ".join(every))]
    both = spark.createDataFrame(rows, "text string").select(
        tx.n_words(F.col("text")).alias("n"), tx.word_count(tx.tokens(F.col("text"))).alias("m")
    )
    assert all(r.n == r.m for r in both.collect())


def test_steps_side_by_side(spark):
    assert [d.count() for d in queries.side_by_side(spark, lambda: spark.range(3), lambda: spark.range(5))] == [3, 5]

    def fails():
        raise ValueError("no budget")

    with pytest.raises(ValueError, match="no budget"):
        queries.side_by_side(spark, lambda: spark.range(3), fails)
