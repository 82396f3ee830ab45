import random

import pytest
from pyspark.sql import functions as F

from veilmill.functions import text as tx
from veilmill.operators import generate, lsh
from veilmill.operators import starcluster as star
from veilmill.operators import triples as tr
from veilmill.operators.ngram_lm import train_ngram_lm
from veilmill.plans.prepare import dedupe_triples


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_default_extractor(spark):
    rows = tr.extract_triples(docs(spark, "Fresh tea is hot. No anchor here", "", "?!.", "a | b"))
    assert [r.triple for r in rows.orderBy("pos").collect()] == ["tea | is | hot", "fresh tea | is | hot"]


def test_user_extractor_and_underscore_repeat(spark):
    repeated = lambda text: [("a_b", "r", "c"), ("a_b", "r", "c")]
    rows = tr.document_triples(docs(spark, "x"), repeated).collect()
    assert [(r.pos, r.triple) for r in rows] == [(0, "a b | r | c")]


def test_parse_and_clean(spark):
    df = spark.createDataFrame([("a | b | c | d",), ("a | b",)], "t string")
    parsed = df.select(tx.parse_triple(F.col("t")).alias("p")).select("p.*").collect()
    assert tuple(parsed[0]) == ("a", "b", "c") and tuple(parsed[1]) == (None, None, None)
    raw = spark.createDataFrame([("x Output text: A b.\nNote: c",)], "t string")
    assert raw.select(tx.clean_generation(F.col("t"))).first()[0] == "A b."
    short = spark.createDataFrame([("ab",)], "t string")
    assert short.select(tx.shingles(F.col("t"))).first()[0] == []


def _index(spark, edges):
    """A bucket per edge of a hand-drawn graph."""
    rows = [(0, b, 2, p) for b, edge in enumerate(edges) for p in edge]
    index = spark.createDataFrame(rows, "doc_id bigint, bucket bigint, n bigint, pos int")
    degrees = {}
    for a, b in edges:
        degrees.setdefault(a, set()).add(b)
        degrees.setdefault(b, set()).add(a)
    table = [(0, p, len(near)) for p, near in degrees.items()]
    return index, spark.createDataFrame(table, "doc_id bigint, pos int, degree bigint"), degrees


def _greedy(around):
    clusters, covered = set(), set()
    for node in sorted(around, key=lambda v: (-len(around[v]), v)):
        if node not in covered:
            clusters |= {(node, m) for m in around[node]}
            covered |= around[node]
    return clusters


def test_star_clusters_overlap(spark):
    index, degrees, _ = _index(spark, [(0, 1), (0, 2), (3, 2), (3, 4)])
    made = {(r.seed, r.member) for r in star.star_clusters(index, degrees).collect()}
    assert made == {(0, 1), (0, 2), (3, 2), (3, 4)}


@pytest.mark.parametrize("group_rows", [1 << 18, 20, 0])
def test_star_clusters_equal_sequential_greedy(spark, monkeypatch, group_rows):
    """In one group, by some rounds and a group for the rest, and by rounds alone."""
    monkeypatch.setattr(star, "GROUP_ROWS", group_rows)
    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    index, degrees, around = _index(spark, edges)
    made = star.star_clusters(index, degrees)
    assert {(r.seed, r.member) for r in made.collect()} == _greedy(around)
    assert made.count() == made.distinct().count()


def test_a_long_chain_has_no_round_limit(spark):
    n = 5000
    index, degrees, around = _index(spark, [(i, i + 1) for i in range(n)])
    made = {(r.seed, r.member) for r in star.star_clusters(index, degrees).collect()}
    assert made == _greedy(around)


def test_degrees_agree_between_paths_and_brute_force(spark):
    texts = [f"item {i % 7} number | is | thing {i % 5} of {i}" for i in range(60)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, pos int, triple string")
    signed = lsh.signatures(rows).cache()
    keys = {r.pos: [tuple(k) for k in r["keys"]] for r in signed.collect()}
    expected = {
        p: sum(any(a == b for a, b in zip(k, other)) for q, other in keys.items() if q != p)
        for p, k in keys.items()
    }
    expected = {p: n for p, n in expected.items() if n}
    for limit, block in ((64, 2048), (3, 16)):
        made = lsh.triple_degree(signed, lsh.lsh_index(signed, limit), limit, block).collect()
        assert {r.pos: r.degree for r in made} == expected


def test_pair_drops_the_first_and_isolated_needs_the_flag(spark):
    rows = spark.createDataFrame(
        [(1, 0, "green tea leaves | are | very hot today"), (1, 1, "green tea leaves | are | very hot todays"),
         (2, 0, "xyz | is | qrst")],
        "doc_id bigint, pos int, triple string",
    )
    lm = train_ngram_lm(docs(spark, "green tea leaves are very hot today", "xyz is qrst"))
    plain = dedupe_triples(rows, lm).survivors.collect()
    assert [(r.doc_id, r.pos) for r in plain] == [(1, 1)]
    kept = dedupe_triples(rows, lm, include_seed=True, keep_singletons=True).survivors.collect()
    assert {(r.doc_id, r.pos) for r in kept} == {(1, 0), (2, 0)}


def test_empty_policy(spark):
    originals = docs(spark, "one", "two")
    made = spark.createDataFrame([(0, "new")], "doc_id bigint, text string")
    result = {
        p: {r.doc_id: r.text for r in generate.apply_empty_policy(originals, made, p).collect()}
        for p in generate.POLICIES
    }
    assert result == {"null": {0: "new", 1: None}, "passthrough": {0: "new", 1: "two"}, "drop": {0: "new"}}
    with pytest.raises(ValueError):
        generate.apply_empty_policy(originals, made, "keep")


def test_generator_plugin(spark):
    rows = spark.createDataFrame([(1, 0, "a | is | b")], "doc_id bigint, pos int, triple string")
    echo = lambda prompts: ["Output text: " + p[-1]["content"] + "\nUSER: x" for p in prompts]
    text = generate.reconstruct_text(rows, generator=echo).first().text
    assert text == "Input triples: [{subject: a, relation: is, object: b}]"
