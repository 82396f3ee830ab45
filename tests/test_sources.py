import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmill.operators import clusters as cl
from veilmill.operators import evaluate
from veilmill.operators import sweep as sw
from veilmill.operators import tokens as tk
from veilmill.functions import text as tx
from veilmill.operators.embed import embed_text
from veilmill.operators.order import positions
from veilmill.operators.triples import document_triples
from veilmill.sources import corpus, release, store
from veilmill.streaming import ingest


def test_cap_by_id_is_exact(spark):
    df = spark.range(50_000).select((F.col("id") * F.col("id") - 10**6).alias("doc_id"))
    for n in (0, 1, 777, 50_000, 60_000):
        kept = corpus.cap_by_id(df, n)
        assert kept.count() == min(n, 50_000)
    assert corpus.cap_by_id(df, 777).agg(F.max("doc_id")).first()[0] == 776**2 - 10**6


def test_csv_dataset_and_flat_discovery(spark, tmp_path):
    pd.DataFrame({"review": ["good, \"very\"\nlong", "bad"], "sentiment": [1, 0], "user_id": [5, 6]}).to_csv(
        tmp_path / "yelp_TEM_29.5.csv", index=False
    )
    rows = corpus.read_dataset(spark, str(tmp_path / "*.csv"), "yelp", "csv", "review string, sentiment int, user_id int")
    assert {r.text for r in rows.collect()} == {"good, \"very\"\nlong", "bad"}
    assert rows.columns == ["dataset", "doc_id", "text", "sentiment", "user_id"]
    flat = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path))
    found = release.discover_flat(flat).select("dataset", "method", "epsilon").distinct().collect()
    assert [tuple(r) for r in found] == [("yelp", "TEM", 29.5)]


def _embedded(docs):
    return embed_text(document_triples(docs), 32, "triple")


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    rows = [(i, f"Big word{i % 4} is red{i} now. x", "en" if i % 3 else "de") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    for attempt in ("a", "b"):  # a new checkpoint replays every batch
        stream = ingest.stream_corpus(spark, str(tmp_path / "in"), files_per_trigger=1)
        ingest.stream_ingest(
            stream, _embedded, str(tmp_path / "store"), str(tmp_path / "seen"), str(tmp_path / f"c{attempt}")
        ).awaitTermination()
        kept = corpus.corpus_filter(docs)
        expected = {r.key for r in store.with_key(_embedded(kept)).select("key").collect()}
        found = [r.key for r in store.read_store(spark, str(tmp_path / "store")).select("key").collect()]
        assert sorted(found) == sorted(expected)
        stats = ingest.ingest_stats(spark, str(tmp_path / "store"), str(tmp_path / "seen")).first()
        assert (stats.documents, stats.triples) == (8, len(expected))
    stream = ingest.stream_corpus(spark, str(tmp_path / "in"), files_per_trigger=1)
    ingest.stream_ingest(
        stream, _embedded, str(tmp_path / "s2"), str(tmp_path / "seen2"), str(tmp_path / "c2"), max_docs=5
    ).awaitTermination()
    assert ingest.ingest_stats(spark, str(tmp_path / "s2"), str(tmp_path / "seen2")).first().documents == 5


def test_release_partitions_and_resume(spark, tmp_path):
    data = spark.createDataFrame([("d", 1, "One two, three")], "dataset string, doc_id bigint, text string")
    grid = sw.epsilon_grid(data)
    assert sorted(r.epsilon for r in grid.collect()) == [0.3, 1.5, 3.0]
    lower = lambda df: df.select("doc_id", F.lower("text").alias("text"))
    path = str(tmp_path / "out")
    assert release.finished_runs(spark, path).isEmpty()
    release.write_release(sw.sweep(data, grid.filter("epsilon > 1"), "m", sw.each_run(lower)), path)
    left = sw.resume_grid(grid, release.finished_runs(spark, path), "m").collect()
    assert [r.epsilon for r in left] == [0.3]


def test_granularity(spark):
    assert cl.granularity_column("100k") == "hundredk"
    with pytest.raises(ValueError):
        cl.granularity_column("10k")


def test_nearest_centroid_in_several_blocks(spark, monkeypatch):
    vecs = spark.range(40).select("id", F.array(F.sin("id"), F.cos("id")).alias("vec"))
    cents = spark.range(15).select(
        F.col("id").cast("int").alias("cluster_id"), F.array(F.sin(F.col("id") * 3), F.cos(F.col("id") * 3)).alias("centroid")
    )
    whole = {r.id: r.cluster_id for r in cl.nearest_centroid(vecs, cents).collect()}
    monkeypatch.setattr(cl, "BROADCAST_BYTES", 4 * 16)
    assert {r.id: r.cluster_id for r in cl.nearest_centroid(vecs, cents).collect()} == whole


def test_pruned_passes_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 6)) * 3
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 6))
    matrix, label, upper, lower, worked = x[::75].copy(), None, None, None, []
    before = None
    for step in range(12):
        bounds = cl.Bounds(matrix, before)
        if step == 0:
            label, upper, lower = bounds.first(x)
        else:
            worked.append(bounds.again(x, label, upper, lower))
        plain = ((x[:, None] - matrix[None]) ** 2).sum(axis=2)
        assert (label == plain.argmin(axis=1)).all()
        before = matrix
        matrix = np.stack([x[label == c].mean(axis=0) if (label == c).any() else matrix[c] for c in range(len(matrix))])
    assert worked[-1] < 3000 * 40 / 4  # most distances are never worked out


def test_fit_spreads_its_starts(spark):
    vecs = spark.range(200).select(F.col("id").alias("key"), F.array(F.sin("id"), F.cos("id")).alias("vec"))
    for k in (1, 9, 200, 500):
        starts = cl.spread_starts(vecs, k).collect()
        assert sorted(r.cluster_id for r in starts) == list(range(min(k, 200)))
        assert len({tuple(r.centroid) for r in starts}) == min(k, 200)
    made = cl.fit_clusters(vecs, 9, 2, max_iter=2).collect()
    assert sorted(r.cluster_id for r in made) == list(range(9))
    assert cl.fit_clusters(vecs.limit(0), 9, 2, max_iter=2).count() == 0


def test_positions_count_through_all_parts(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(6)
    assert [r.position for r in positions(rows, ["x"]).orderBy("x").collect()] == list(range(1000))


def test_budgets(spark):
    df = spark.createDataFrame([("?!.",), ("a b, c",)], "text string")
    rows = df.select(tk.word_budget(F.lit(6.0), tx.tokens(F.col("text"))).alias("e")).collect()
    assert [r.e for r in rows] == [None, 2.0]


def test_judge_means_without_scores(spark):
    rows = spark.createDataFrame(
        [("d", "m", 1.0, "Fluency x", None), ("d", "m", 1.0, "Clarity", 0.25), ("d", "m", 1.0, "Clarity", None)],
        "dataset string, method string, epsilon double, metric string, score double",
    )
    made = evaluate.judge_means(rows, metrics=("Fluency", "Clarity")).first()
    assert (made.Fluency, made.Clarity) == (0.0, 0.25)


def test_release_keeps_names_as_text(spark, tmp_path):
    path = str(tmp_path / "release")
    rows = [("0042", "1", 2.0, 1, "a"), ("true", "m", 0.5, 2, None)]
    made = spark.createDataFrame(rows, "dataset string, method string, epsilon double, doc_id long, text string")
    release.write_release(made, path)
    back = release.read_release(spark, path).select("dataset", "method", "epsilon", "doc_id", "text")
    assert back.schema == made.schema and sorted(map(tuple, back.collect())) == rows


def test_ids_do_not_depend_on_the_packing(spark, tmp_path):
    rows = spark.createDataFrame([(f"text {i % 40}", i % 3, None) for i in range(200)] + [(None, None, None)] * 2, "review string, sentiment int, user_id int")
    ids = []
    for k, parts in enumerate((1, 7)):
        path = str(tmp_path / f"packed{k}")
        rows.repartition(parts).write.parquet(path)
        read = corpus.read_dataset(spark, path, "yelp")
        ids.append(sorted((r.doc_id, r.text or "", r.sentiment or 0) for r in read.collect()))
        assert read.select("doc_id").distinct().count() == 202
    assert ids[0] == ids[1]


def test_bucketed_store_is_not_shuffled(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 20).alias("label"))
    held = store.save_bucketed(rows, "bucketed_store", "label", 4, str(tmp_path / "store"))
    asked = spark.range(20).select(F.col("id").alias("label"), F.lit(1).alias("q"))
    joined = asked.hint("merge").join(held, "label")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 500  # that of the queries
    spark.sql("DROP TABLE bucketed_store")


def test_perplexity_of_a_light_and_a_heavy_model(spark, monkeypatch):
    from veilmill.operators import ngram_lm

    texts = spark.createDataFrame([(1, "a b a b c"), (2, "zz a yy"), (3, "..."), (4, "a a a a a b")], "doc_id long, text string")
    lm = ngram_lm.train_ngram_lm(spark.createDataFrame([(1, "a b c a b"), (2, "b a c")], "doc_id long, text string"))
    light = sorted(map(tuple, ngram_lm.perplexity(texts, lm, ["doc_id"]).collect()))
    monkeypatch.setattr(ngram_lm, "LIGHT_MODEL", 0)
    assert sorted(map(tuple, ngram_lm.perplexity(texts, lm, ["doc_id"]).collect())) == light and [r[:2] for r in light] == [(1, 5), (2, 3), (4, 6)]


def test_upsert_reads_only_touched_prefixes(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(300).select(F.concat(F.lit("text "), "id").alias("triple"), F.array(F.lit(1.0)).alias("vec"))
    store.upsert_triples(store.with_key(rows), path)
    one = store.with_key(rows.limit(1))
    held = store.touched(store.read_store(spark, path), one)
    plan = held._jdf.queryExecution().executedPlan().toString()
    prefix = one.first().key[:1]
    assert "PartitionFilters: [" in plan and {r.prefix for r in held.select("prefix").distinct().collect()} == {prefix}
    store.upsert_triples(store.with_key(rows), path)
    assert store.read_store(spark, path).count() == 300


def test_score_logs_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "scores")
    schema = "dataset string, cs double, other double"
    assert release.read_scores(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("a", 0.5), ("b", None)], "dataset string, cs double")
    for _ in range(2):
        release.export_scores(rows, path, "cosine")
    release.export_scores(rows.select("dataset", F.lit(2.0).alias("other")).where("dataset = 'a'"), path, "judge")
    back = sorted(map(tuple, release.read_scores(spark, path, schema).collect()), key=repr)
    assert back == [("a", 0.5, None, "cosine"), ("a", None, 2.0, "judge"), ("b", None, None, "cosine")]


def test_large_runs_get_several_files_and_small_ones_share(spark, tmp_path):
    path = str(tmp_path / "release")
    many = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    runs = many.select("*", F.lit("big").alias("dataset"), F.lit("m").alias("method"), F.lit(1.0).alias("epsilon"))
    runs = runs.unionByName(runs.where("doc_id < 3").withColumn("dataset", F.lit("small")))
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        release.write_release(runs, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    files = [len(list((tmp_path / "release" / f"dataset={d}").rglob("*.parquet"))) for d in ("big", "small")]
    assert files[0] > 2 and files[1] == 1
    assert release.read_release(spark, path).groupBy("dataset").count().orderBy("dataset").collect() == [("big", 40_000), ("small", 3)]


def test_originals_are_embedded_once(spark):
    data = spark.createDataFrame([("d", 1, "red apples fall"), ("d", 2, None), ("d", 3, "blue")], "dataset string, doc_id long, text string")
    private = spark.createDataFrame(
        [("d", "m", 1.0, 1, "red apples"), ("d", "m", 2.0, 1, "pears"), ("d", "m", 1.0, 3, None)],
        "dataset string, method string, epsilon double, doc_id long, text string",
    )
    once = evaluate.cosine_of_runs(data, private)
    assert sorted(once.collect()) == sorted(evaluate.cosine_by_model(evaluate.eval_align(data, private)).collect())
