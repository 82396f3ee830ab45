import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmill.operators import draw, ngram_lm, noise, wordvecs
from veilmill.operators import tokens as tk
from veilmill.operators.privatize import similarity


@pytest.mark.parametrize(
    "k, epsilon, expected",
    [
        (64, 1, 5.96901062), (64, 15, 0.57905523), (64, 57.5, 0.21786956), (64, 575, 0.05343802),
        (768, 1, 20.67725931), (768, 30, 1.19009985), (768, 287.5, 0.27536883), (768, 575, 0.18511474),
    ],
)
def test_analytic_scale(k, epsilon, expected):
    assert noise.noise_scale(epsilon, k, "analytic_gaussian") == pytest.approx(expected, rel=2e-6)


def test_classic_scales():
    assert noise.noise_scale(3, 64, "laplace") == pytest.approx(4.2666667, abs=1e-7)
    assert noise.noise_scale(57.5, 64, "gaussian") == pytest.approx(0.1348120, abs=1e-7)
    with pytest.raises(ValueError):
        noise.noise_scale(1, 64, "uniform")


def test_exponential_probs(spark):
    cands = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.0)], "g int, c int, u double")
    rows = draw.exponential_probs(cands, ["g"], "u", F.lit(1.0)).orderBy("c").collect()
    assert [round(r.prob, 6) for r in rows] == [0.419229, 0.326496, 0.254275]


def _chi_square(counts, probs, n):
    return sum((counts[c] - n * p) ** 2 / (n * p) for c, p in probs.items())


def given():
    """The utility that members carry; a local function, which is sent whole to the workers."""
    return lambda queries, members: members["u"].to_numpy()


def _draws(spark, members, n, epsilon, block_size, seed="seed"):
    blocks = draw.member_blocks(members, ["g"], "id", ["u"], block_size)
    queries = spark.range(n).select(F.lit(0).alias("g"), F.col("id").alias("q"), F.lit(epsilon).alias("eps"))
    made = draw.draw_one(queries, blocks, ["g"], ["q"], given(), "eps", seed)
    return {r.q: r.key for r in made.select("q", "chosen.key").collect()}


@pytest.mark.parametrize("epsilon", [2.0, 9.0])
def test_draw_follows_the_exponential_mechanism(spark, epsilon):
    n, size = 20_000, 24
    utility = {i: i / (size - 1) for i in range(size)}
    members = spark.createDataFrame([(0, i, u) for i, u in utility.items()], "g int, id int, u double")
    whole = _draws(spark, members, n, epsilon, 256)
    counts = Counter(whole.values())
    assert sum(counts.values()) == n
    weights = {i: math.exp(epsilon * u / 2) for i, u in utility.items()}
    total = sum(weights.values())
    # 23 degrees of freedom: 49.7 is the 0.999 quantile.
    assert _chi_square(counts, {i: w / total for i, w in weights.items()}, n) < 49.7
    # The same winners however the group is cut, and others for another seed.
    assert _draws(spark, members, n, epsilon, 4) == whole
    assert _draws(spark, members, n, epsilon, 256, "other") != whole


def test_runs_are_drawn_apart(spark, monkeypatch):
    members = spark.createDataFrame([(0, i, i / 9) for i in range(10)], "g int, id int, u double")
    blocks = draw.member_blocks(members, ["g"], "id", ["u"])
    runs = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(e).alias("eps")) for r, e in (("a", 1.0), ("b", 1.0), ("c", 500.0))))
    queries = spark.range(3000).select(F.lit(0).alias("g"), F.col("id").alias("q"), runs.alias("runs"))
    rows = draw.draw_one(queries, blocks, ["g"], ["q"], given(), "runs", "s").collect()
    by = {run: {r.q: r.chosen.key for r in rows if r.run == run} for run in "abc"}
    assert all(len(x) == 3000 for x in by.values()) and set(by["c"].values()) == {9}
    same = sum(by["a"][q] == by["b"][q] for q in by["a"])
    assert 250 < same < 450  # as often as two independent draws agree
    alone = queries.select("g", "q", F.lit(1.0).alias("eps"))
    single = draw.draw_one(alone.withColumn("eps", F.array(F.struct(F.lit("a").alias("run"), F.lit(1.0).alias("eps")))), blocks, ["g"], ["q"], given(), "eps", "s")
    assert {r.q: r.chosen.key for r in single.collect()} == by["a"]
    monkeypatch.setattr(draw, "QUERY_PART", 100)
    monkeypatch.setattr(draw, "CELLS", 64)
    again = draw.draw_one(queries, blocks, ["g"], ["q"], given(), "runs", "s").collect()
    assert {run: {r.q: r.chosen.key for r in again if r.run == run} for run in "abc"} == by


def test_query_without_members_has_no_row(spark):
    members = spark.createDataFrame([(0, 1, 0.5)], "g int, id int, u double")
    blocks = draw.member_blocks(members, ["g"], "id", ["u"])
    queries = spark.createDataFrame([(0, 1, 1.0), (9, 2, 1.0)], "g int, q int, eps double")
    made = draw.draw_one(queries, blocks, ["g"], ["q"], given(), "eps", "s").collect()
    assert [r.q for r in made] == [1]
    assert draw.draw_one(queries.limit(0), blocks, ["g"], ["q"], given(), "eps", "s").count() == 0


def test_topk_ties_go_to_the_smaller_key(spark):
    rows = [(0, i, [1.0, float(i % 3)]) for i in range(40)]
    members = spark.createDataFrame(rows, "g int, id int, vec array<double>")
    queries = spark.createDataFrame([(0, 7, [1.0, 0.0])], "g int, q int, vec array<double>")
    for size in (2048, 5):
        blocks = draw.member_blocks(members, ["g"], "id", ["vec"], size)
        got = draw.topk_in_group(queries, blocks, ["g"], ["q"], similarity, 6).orderBy("rank").collect()
        assert [r.key for r in got] == [0, 3, 6, 9, 12, 15] and {round(r.utility, 9) for r in got} == {1.0}


def test_similarity_bounds():
    queries = pa.table({"vec": [[1.0, 0.0], [0.0, 0.0], [1.0, 1.0]]})
    members = pa.table({"vec": [[-1.0, 0.0], [1.0, 0.0], [2.0, 2.0]]})
    made = similarity(queries, members).round(6).tolist()
    assert made == [[0.0, 1.0, 0.707107], [0.0, 0.0, 0.0], [0.0, 0.707107, 1.0]]


def test_noise_moments_and_sharing(spark):
    vecs = spark.range(400).select(
        (F.col("id") % 20).alias("doc_id"), F.col("id").alias("pos"),
        F.array_repeat(F.lit(0.0), 64).alias("vec"),
    )
    for method in ("laplace", "gaussian"):
        scale = noise.noise_scale(10.0, 64, method)
        made = noise.add_noise(vecs, 10.0, method, "s", dim=64).select(F.explode("vec").alias("x"))
        mean, sd = made.agg(F.avg("x"), F.stddev("x")).first()
        expected = scale * (math.sqrt(2) if method == "laplace" else 1)
        assert abs(mean) < expected * 0.03 and sd == pytest.approx(expected, rel=0.03)
    shared = noise.add_noise(vecs, 10.0, "laplace", "s", dim=64, noise_per="doc")
    assert shared.select("vec").distinct().count() == 20
    by_column = noise.add_noise(vecs.withColumn("e", F.lit(10.0)), "e", "laplace", "s")
    fixed = noise.add_noise(vecs, 10.0, "laplace", "s", dim=64)
    assert by_column.select("pos", "vec").exceptAll(fixed.select("pos", "vec")).isEmpty()


def test_every_word_can_become_any(spark):
    docs = spark.createDataFrame([(1, "Zyx, qwv! zyx 42 known."), (2, "known"), (3, "..."), (4, "")], "doc_id long, text string")
    near = spark.createDataFrame(
        [("known", "alpha", 0.2), ("known", "beta", 0.9), ("alpha", "alpha", 0.0)], "word string, candidate string, distance double"
    )
    words = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("known",)], "word string")
    slots = {(r.doc_id, r.pos): r for r in tk.word_slots(docs, F.lit(9.0)).collect()}
    assert [slots[1, p].prev for p in (0, 2, 4, 5, 6)] == ["<s>", "zyx", "qwv", "zyx", "42"]
    made = {(r.doc_id, r.pos): r.token for r in tk.replace_words(docs, near, words, F.lit(9.0), 1.0, "s").collect()}
    assert made.keys() == slots.keys()
    assert all(made[k] in ("alpha", "beta", "gamma", "known") if s.is_word else made[k] == s.token for k, s in slots.items())
    nothing = tk.replace_words(docs, near.limit(0), words.limit(0), F.lit(9.0), 1.0, "s")
    assert {r.token for r in nothing.collect()} == {tk.HIDDEN, ",", "!", "."}


def test_replacement_has_the_chances_of_the_mechanism(spark):
    """Frequencies of words with and without neighbours, and the ratio of their exact chances."""
    n, epsilon, gamma = 6000, 4.0, 1.0
    near = [("a", "a", 0.0), ("a", "b", 0.3), ("b", "b", 0.0), ("b", "a", 0.3), ("b", "c", 0.8)]
    vocabulary = "abcdef"

    def chances(word):
        u = {c: 1 - d / gamma for w, c, d in near if w == word}
        weights = {c: math.exp(epsilon * u.get(c, 0.0) / 2) for c in vocabulary}
        return {c: w / sum(weights.values()) for c, w in weights.items()}

    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abz")), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    near_rows = spark.createDataFrame(near, "word string, candidate string, distance double")
    words = spark.createDataFrame([(c,) for c in vocabulary], "word string")
    made = tk.replace_words(docs, near_rows, words, F.lit(epsilon), gamma, "s").collect()
    for k, word in enumerate("abz"):
        counts = Counter(r.token for r in made if r.doc_id % 3 == k)
        assert counts.keys() == set(vocabulary)
        # 5 degrees of freedom: 20.5 is the 0.999 quantile.
        assert _chi_square(counts, chances(word), n // 3) < 20.5
    for first in "abz":
        for second in "abz":
            p, q = chances(first), chances(second)
            assert max(p[c] / q[c] for c in vocabulary) <= math.exp(epsilon) + 1e-9


def test_rewriting_has_one_support(spark):
    """Frequencies behind a known and an unknown word follow the back-off mixture."""
    rows = [("<s>", "x", 6), ("<s>", "y", 2), ("x", "y", 5), ("x", "x", 1), ("y", "z", 3), ("y", "x", 1)]
    lm = ngram_lm.NgramModel(
        spark.createDataFrame([(p, w, c, sum(k for q, _, k in rows if q == p), 0) for p, w, c in rows], "prev string, word string, n long, n_prev long, logp long"),
        None, 3, 0.1,
    )
    low, high, epsilon, n = -6.0, 0.0, 8.0, 6000
    model = tk.backoff(lm, low, high)
    total = Counter()
    for _, w, c in rows:
        total[w] += c
    seen = {p: {w: c for q, w, c in rows if q == p} for p in ("<s>", "x", "y")}

    def chances(prev):
        after = seen.get(prev, {})
        p = {w: 0.8 * after.get(w, 0) / max(1, sum(after.values())) + 0.2 * c / total.total() for w, c in total.items()}
        weights = {w: math.exp(epsilon / 2 * (min(max(math.log(x), low), high) - low) / (high - low)) for w, x in p.items()}
        return {w: x / sum(weights.values()) for w, x in weights.items()}

    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x q y").alias("text"))
    made = tk.rewrite_tokens(docs, model, F.lit(3 * epsilon), "s").collect()
    for pos, prev in enumerate(("<s>", "x", "q")):
        counts = Counter(r.token for r in made if r.pos == pos)
        assert counts.keys() == total.keys()
        assert _chi_square(counts, chances(prev), n) < 13.9  # 2 degrees of freedom, 0.999


def test_singular_vectors_match_numpy(spark):
    rng = np.random.default_rng(2)
    left = rng.standard_normal((40, 5))
    dense = left @ np.diag([9.0, 7.0, 5.0, 3.0, 2.0]) @ left.T
    rows = [(f"w{i}", f"w{j}", float(dense[i, j])) for i in range(40) for j in range(40)]
    info = spark.createDataFrame(rows, "word string, context string, value double")
    got = {r.word: np.array(r.vec) for r in wordvecs.singular_vectors(info, 5, extra=3).collect()}
    made = np.stack([got[f"w{i}"] for i in range(40)])
    assert np.allclose(made @ made.T, dense, atol=1e-6)


def test_noise_asks_for_a_seed(spark):
    vecs = spark.createDataFrame([(1, 0, [0.5])], "doc_id long, pos int, vec array<double>")
    with pytest.raises(TypeError):
        noise.add_noise(vecs, 10.0, "laplace", dim=1)


def test_small_blocks_meet_queries_in_sets(spark):
    """Copies of queries don't grow with the number of blocks, and the same members are found."""
    rows = spark.createDataFrame([(i % 3, i, [float(i % 7), 1.0, float(i % 5)]) for i in range(300)], "g int, k long, vec array<double>")
    tops, copies = [], []
    for size in (4, 2048):
        blocks = draw.member_blocks(rows, ["g"], "k", ["vec"], size)
        queries = rows.select("g", F.col("k").alias("q"), "vec")
        found = draw.topk_in_group(queries, blocks, ["g"], ["q"], similarity, 3)
        tops.append(sorted(tuple(r) for r in found.collect()))
        copies.append(draw._met(queries, blocks, ["g"], ["q"], lambda a, m: iter([a.select(["q"])]), "q long").count())
    assert tops[0] == tops[1] and copies == [300, 300]
