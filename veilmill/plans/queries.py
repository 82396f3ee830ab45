"""The registered queries: every operator on the given tables, whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from veilmill.functions import text as tx
from veilmill.functions import vectors as vx
from veilmill.operators import clusters as cl
from veilmill.operators import draw, evaluate, generate, lsh, ngram_lm, noise, privatize, wordvecs
from veilmill.operators import starcluster as star
from veilmill.operators import sweep as sw
from veilmill.operators import tokens as tk
from veilmill.operators import triples as tr
from veilmill.operators.embed import embed_text
from veilmill.plans import documents as plan
from veilmill.plans import prepare
from veilmill.session import cut_lineage, scratch_dir
from veilmill.sources import corpus, release, store
from veilmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DRAW_SEED = "7"
EPSILON = 10.0
CELL_BITS = 6
TURNS = 1 << 20  # of a conversation at most, for ids of turns
DIM = 32
VECTOR_DIM = 64  # of the given vectors
# Budgets of the noise queries, by label modulo 3.
NOISE_EPSILONS = (1.0, 15.0, 57.5)
# Logit range of the bigram model (natural logs of probabilities).
LM_LOW, LM_HIGH = -12.0, 0.0
GAMMA = 1.0  # of the distance of unit vectors
KMEANS = (10, 10)  # clusters and passes
# Clusters and passes of the three granularities, in proportion to the given vectors.
SIZES = {"50k": (4, 2), "100k": (8, 3), "200k": (16, 3)}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs -------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; only the public corpus is filtered (``corpus_filter``)."""
    return corpus.spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("source").alias("dataset"), "doc_id", "text")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as documents."""
    rows = table(spark, sf, "conversations")
    return corpus.spread(rows.select((F.col("conv_id") * TURNS + F.col("turn")).alias("doc_id"), "text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as rows of documents, ten to a document."""
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("doc_id"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        "vec_id",
        F.col("embedding").alias("vec"),
        "label",
    )


def vectors32(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumn("vec", vx.truncate_dim(F.col("vec"), DIM))


def unfolded(df: DataFrame, ids: list[str], vec: str = "vec") -> DataFrame:
    """One row per component, rounded."""
    rows = df.select(*ids, F.posexplode(vec).alias("i", "x"))
    return rows.select(*ids, "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def signed(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures, worked out where they are used: they take many times the room of the triples."""
    return lsh.signatures(cut_lineage(tr.document_triples(documents(spark, sf)), "triples"))


def deduped(spark: SparkSession, sf: str) -> tuple[prepare.Deduped, ngram_lm.NgramModel]:
    docs = documents(spark, sf)
    lm = ngram_lm.train_ngram_lm(docs)
    return prepare.dedupe_triples(tr.document_triples(docs), lm), lm


def label_centroids(vecs: DataFrame, dim: int) -> DataFrame:
    return cut_lineage(cl.mean_centroids(vecs, "label", dim), "centroids")


def text_store(spark: SparkSession, sf: str):
    """The public side, from conversation turns: a language model, the store's blocks and its cells."""
    public = turns(spark, sf)
    lm = ngram_lm.train_ngram_lm(public)
    store_rows = cut_lineage(prepare.public_store(prepare.embedded_survivors(public, lm, DIM)), "store")
    centroids = cut_lineage(cl.sign_centroids(store_rows, DIM, CELL_BITS), "centroids")
    labelled = cl.nearest_centroid(store_rows, centroids)
    return lm, cut_lineage(privatize.store_blocks(labelled), "blocks"), centroids


def verbalized(spark: SparkSession, sf: str) -> DataFrame:
    """A release to evaluate: every document rewritten from its own triples, without noise."""
    docs = documents(spark, sf)
    texts = generate.reconstruct_text(tr.document_triples(docs))
    texts = generate.apply_empty_policy(docs, texts, "null")
    return docs.select(F.col("source").alias("dataset"), "doc_id").join(texts, "doc_id").select(
        "dataset", F.lit("nodp").alias("method"), F.lit(1.0).alias("epsilon"), "doc_id", "text"
    )


def side_by_side(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the steps give, where none needs another: their jobs share the cores, so small ones leave none idle."""
    scratch_dir(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        return list(pool.map(lambda step: step(), [inheritable_thread_target(spark)(s) for s in steps]))


# ---- sources and sinks --------------------------------------------------------------------


@query
def dataset_projection(spark, sf):
    specs = (
        corpus.DatasetSpec("documents", id_col="doc_id"),
        corpus.DatasetSpec("pages", text_col="html", id_col="page_id"),
        corpus.DatasetSpec("benchmark", id_col="item_id"),
    )
    parts = [
        corpus.read_dataset(spark, f"{sf}/{s.name}.parquet", s).select("dataset", "doc_id", "text")
        for s in specs
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dataset_csv(spark, sf):
    """Documents as CSV files without an id column: ids come from the content."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select("text", "lang")
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    read = corpus.read_dataset(spark, path, corpus.DatasetSpec("documents"), "csv", "text string, lang string")
    return read.select("dataset", "doc_id", "lang", F.length("text").alias("n_chars"))


def _plain_embedded(docs: DataFrame) -> DataFrame:
    return embed_text(tr.document_triples(docs), DIM, "triple")


@query
def stream_ingest(spark, sf):
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.stream_corpus(spark, f"{sf}/documents*.parquet")
    lm = ngram_lm.train_ngram_lm(documents(spark, sf))

    def survivors(batch: DataFrame) -> DataFrame:
        """Near-duplicates within a document go before its batch is stored."""
        return prepare.embedded_survivors(batch, lm, DIM)

    ingest.stream_ingest(
        stream, survivors, f"{base}/store", f"{base}/accepted", f"{base}/checkpoint"
    ).awaitTermination()
    return store.read_store(spark, f"{base}/store").select("key", "text")


@query
def ingest_stats(spark, sf):
    base = f"{scratch_dir(spark)}/stats-{uuid.uuid4().hex}"
    stream = ingest.stream_corpus(spark, f"{sf}/documents*.parquet")
    ingest.stream_ingest(
        stream, _plain_embedded, f"{base}/store", f"{base}/accepted", f"{base}/checkpoint"
    ).awaitTermination()
    return ingest.ingest_stats(spark, f"{base}/store", f"{base}/accepted")


@query
def triple_store_upsert(spark, sf):
    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    docs = documents(spark, sf)
    for batch in (items, docs, items):
        store.upsert_triples(store.with_key(_plain_embedded(batch)), path)
    return store.read_store(spark, path).select("key", "text")


@query
def label_writeback(spark, sf):
    public = vectors(spark, sf).withColumn("key", F.md5(F.col("vec_id").cast("string")))
    public = cut_lineage(public.select("key", "vec_id", "vec"), "public")
    bits = {"50k": 2, "100k": 3, "200k": 4}
    centroids = {m: cut_lineage(cl.sign_centroids(public, VECTOR_DIM, b)) for m, b in bits.items()}
    labels = cl.label_triples(public, centroids).drop("vec", "vec_id")
    return store.write_labels(public, labels).drop("vec")


@query
def store_join(spark, sf):
    """Queries against a store that is bucketed by its label: counts join without a shuffle of the store,
    and vectors are compared in products of blocks."""
    rows = cut_lineage(vectors(spark, sf), "vectors")
    name = f"store_{uuid.uuid4().hex}"
    public = rows.select("label", F.col("vec_id").alias("key"), "vec")
    held = store.save_bucketed(public, name, "label", 8, f"{scratch_dir(spark)}/{name}")
    near = cl.nearest_centroid(rows, label_centroids(rows, VECTOR_DIM)).select("vec_id", "vec", F.col("cluster_id").alias("label"))
    return store.best_in_label(cut_lineage(near, "near"), held, "label", "vec_id", VECTOR_DIM).withColumn("best", F.round("best", 6))


@query
def release_roundtrip(spark, sf):
    path = f"{scratch_dir(spark)}/release-{uuid.uuid4().hex}"
    originals = documents(spark, sf).select(F.col("source").alias("dataset"), "doc_id", "text", "lang")
    release.write_release(release.replace_text(originals, verbalized(spark, sf)), path)
    return release.read_release(spark, path).select(
        "dataset", "method", "epsilon", "doc_id", "text", "lang"
    )


@query
def release_discovery(spark, sf):
    path = f"{scratch_dir(spark)}/release-{uuid.uuid4().hex}"
    release.write_release(verbalized(spark, sf), path)
    found = release.finished_runs(spark, path)
    rows = release.read_release(spark, path).groupBy(*release.RUN).agg(F.count("*").alias("n"))
    return found.join(rows, release.RUN)


# ---- filters and projections --------------------------------------------------------------


@query
def corpus_filter(spark, sf):
    return corpus.corpus_filter(table(spark, sf, "documents")).select("doc_id", "text")


@query
def corpus_cap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return corpus.corpus_filter(docs, max_docs=400).select("doc_id")


@query
def truncate_tokens(spark, sf):
    kept = tx.truncate_tokens(tx.tokens(F.col("text")), 512)
    return table(spark, sf, "documents").select("doc_id", F.array_join(kept, " ").alias("head"))


@query
def no_triple_policy(spark, sf):
    docs = documents(spark, sf)
    texts = generate.reconstruct_text(tr.document_triples(docs))
    parts = [
        generate.apply_empty_policy(docs, texts, p).select(F.lit(p).alias("policy"), "doc_id", "text")
        for p in generate.POLICIES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def tokenize(spark, sf):
    rows = turns(spark, sf).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))
    return rows.select("doc_id", "pos", "token", tx.is_punctuation(F.col("token")).alias("punct"))


@query
def detokenize(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.detokenize(tx.tokens(F.col("text"))).alias("text"))


# ---- triples ------------------------------------------------------------------------------


@query
def extract_triples(spark, sf):
    return tr.extract_triples(documents(spark, sf))


@query
def triple_render(spark, sf):
    rows = tr.extract_triples(documents(spark, sf))
    return rows.select("triple").groupBy("triple").agg(F.count("*").alias("n"))


@query
def triple_dedupe(spark, sf):
    return tr.dedupe_exact(tr.extract_triples(documents(spark, sf)))


@query
def triple_parse(spark, sf):
    rows = tr.document_triples(documents(spark, sf))
    t = tx.parse_triple(F.col("triple"), swap_ends=True)
    return rows.select("doc_id", "pos", t.alias("t")).select("doc_id", "pos", "t.*")


@query
def shingles(spark, sf):
    rows = tr.document_triples(documents(spark, sf))
    return rows.select("doc_id", "pos", F.explode(tx.shingles(F.col("triple"))).alias("shingle"))


@query
def minhash_signature(spark, sf):
    rows = tr.document_triples(documents(spark, sf))
    sig = rows.select(
        "doc_id", "pos", lsh.minhash_signature(lsh.shingle_hashes(F.col("triple"))).alias("sig")
    )
    return sig.select("doc_id", "pos", F.array_join("sig", ",").alias("sig"))


@query
def lsh_index(spark, sf):
    return lsh.lsh_index(signed(spark, sf))


@query
def triple_degree(spark, sf):
    keys = signed(spark, sf)
    return lsh.triple_degree(keys, cut_lineage(lsh.lsh_index(keys)))


@query
def star_clusters(spark, sf):
    keys = signed(spark, sf)
    index = cut_lineage(lsh.lsh_index(keys))
    return star.star_clusters(index, cut_lineage(lsh.triple_degree(keys, index)))


@query
def triple_ppl(spark, sf):
    found, lm = deduped(spark, sf)
    scores = prepare.member_perplexity(found.triples, found.clusters, lm)
    return scores.select("doc_id", "pos", "n_words", F.round("ppl", 6).alias("ppl"))


@query
def cluster_best(spark, sf):
    return deduped(spark, sf)[0].best


@query
def surviving_triples(spark, sf):
    return deduped(spark, sf)[0].survivors


# ---- language model -----------------------------------------------------------------------


def _lm_corpus(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query
def ngram_counts(spark, sf):
    return ngram_lm.bigram_counts(corpus.spread(_lm_corpus(spark, sf)))


@query
def perplexity(spark, sf):
    docs = corpus.spread(_lm_corpus(spark, sf))
    scores = ngram_lm.perplexity(docs, ngram_lm.train_ngram_lm(docs), ["doc_id"])
    return scores.select("doc_id", "n_words", F.round("ppl", 4).alias("ppl"))


@query
def perplexity_mean(spark, sf):
    docs = corpus.spread(_lm_corpus(spark, sf))
    scores = ngram_lm.perplexity(docs, ngram_lm.train_ngram_lm(docs), ["doc_id"])
    return ngram_lm.mean_perplexity(scores).select(F.round("mean_ppl", 4).alias("mean_ppl"))


@query
def ngram_lm_probabilities(spark, sf):
    lm = ngram_lm.train_ngram_lm(corpus.spread(_lm_corpus(spark, sf)))
    p = F.exp(F.col("logp") / F.lit(float(ngram_lm.NANO)))
    return lm.bigrams.select("prev", "word", "n", "n_prev", F.round(p, 6).alias("p"))


# ---- vectors and clusters -----------------------------------------------------------------


@query
def embed_triples(spark, sf):
    rows = tr.document_triples(documents(spark, sf)).select("triple").distinct()
    return unfolded(embed_text(rows, DIM, "triple"), ["triple"])


@query
def truncate_dim(spark, sf):
    return unfolded(vectors32(spark, sf), ["vec_id"])


@query
def kmeans_fit(spark, sf):
    vecs = vectors(spark, sf).withColumn("key", F.col("vec_id"))
    return unfolded(cl.fit_clusters(vecs, KMEANS[0], VECTOR_DIM, KMEANS[1]), ["cluster_id"], "centroid")


@query
def granularity_roundtrip(spark, sf):
    """Three granularities from the fit over centroid tables and labels in the store to the draw."""
    path = f"{scratch_dir(spark)}/centroids-{uuid.uuid4().hex}"
    rows = vectors(spark, sf)
    public = cut_lineage(rows.select(F.md5(F.col("vec_id").cast("string")).alias("key"), "vec_id", "vec"), "public")
    for mode, made in cl.fit_granularities(public, VECTOR_DIM, SIZES).items():
        store.write_centroids(made, mode, path)
    centroids = {mode: cut_lineage(store.read_centroids(spark, mode, path), "centroids") for mode in SIZES}
    labels = cl.label_triples(public, centroids, "euclidean").drop("vec", "vec_id")
    labelled = cut_lineage(store.write_labels(public, labels), "labelled")
    parts = []
    for mode, table_ in centroids.items():
        label = cl.granularity_column(mode)
        blocks = cut_lineage(
            privatize.store_blocks(labelled, attrs=("vec", "vec_id", label), granularity=mode), "blocks"
        )
        drawn = privatize.privatize_triples(
            rows.select("doc_id", "pos", "vec"), blocks, table_, EPSILON, DRAW_SEED, keep=("vec_id", label)
        )
        drawn = drawn.select(
            F.lit(mode).alias("granularity"), "doc_id", "pos", F.col("chosen.vec_id").alias("chosen_id"),
            F.col(f"chosen.{label}").alias("cluster_id"),
        )
        parts.append(drawn.join(cl.cluster_counts(labelled, table_, label), "cluster_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def kmeans_refine(spark, sf):
    vecs = vectors(spark, sf)
    start = cut_lineage(cl.sign_centroids(vecs, VECTOR_DIM, 4), "start")
    return unfolded(cl.refine_centroids(vecs, start, VECTOR_DIM, 3), ["cluster_id"], "centroid")


@query
def kmeans_assign(spark, sf):
    vecs = vectors(spark, sf)
    made = cl.nearest_centroid(vecs, label_centroids(vecs, VECTOR_DIM), "euclidean")
    return made.select("vec_id", "cluster_id")


@query
def cluster_counts(spark, sf):
    vecs = vectors(spark, sf)
    labels = cl.nearest_centroid(vecs, label_centroids(vecs, VECTOR_DIM))
    ids = spark.range(12).select(F.col("id").cast("int").alias("cluster_id"))
    return cl.cluster_counts(labels, ids)


@query
def nearest_centroid(spark, sf):
    vecs = vectors(spark, sf)
    made = cl.nearest_centroid(vecs, label_centroids(vecs, VECTOR_DIM))
    return made.select("vec_id", "cluster_id")


def _vector_search(spark, sf, block_size=draw.BLOCK_SIZE):
    """All vectors as queries against all vectors as members of the label clusters."""
    vecs = cut_lineage(vectors(spark, sf), "vectors")
    centroids = label_centroids(vecs, VECTOR_DIM)
    queries = cut_lineage(cl.nearest_centroid(vecs, centroids).drop("label"), "queries")
    blocks = privatize.store_blocks(vecs, "label", ("vec",), block_size, "vec_id")
    return queries, cut_lineage(blocks, "blocks"), centroids


@query
def cluster_candidates(spark, sf):
    queries, blocks, _ = _vector_search(spark, sf)
    stats = draw.candidate_stats(queries, blocks, ["cluster_id"], ["vec_id"], privatize.similarity)
    return stats.select(
        "vec_id", "n_candidates",
        F.round("max_utility", 6).alias("max_utility"),
        F.round("mean_utility", 6).alias("mean_utility"),
    )


@query
def cluster_topk(spark, sf):
    queries, blocks, _ = _vector_search(spark, sf, 32)
    top = draw.topk_in_group(queries, blocks, ["cluster_id"], ["vec_id"], privatize.similarity, 5)
    return top.select(
        "vec_id", "rank", F.col("key").alias("neighbour"), F.round("utility", 6).alias("utility")
    )


@query
def pairwise_cosine(spark, sf):
    vecs = vectors(spark, sf)
    centroids = label_centroids(vecs, VECTOR_DIM).withColumnRenamed("cluster_id", "label")
    centers = vecs.select("vec_id", "label").join(centroids, "label").select(
        "vec_id", F.col("centroid").alias("vec")
    )
    made = evaluate.pairwise_cosine(vecs, centers, ["vec_id"])
    return made.select("vec_id", F.round("cos", 6).alias("cos"))


# ---- privacy mechanisms -------------------------------------------------------------------


@query
def budget_split(spark, sf):
    rows = tr.document_triples(documents(spark, sf))
    made = privatize.budget_split(rows, EPSILON)
    return made.select("doc_id", "pos", F.round("eps", 6).alias("eps"))


def _candidates(spark, sf):
    """Each label's members with their utility for the label's mean vector."""
    vecs = vectors(spark, sf)
    centroids = label_centroids(vecs, VECTOR_DIM).withColumnRenamed("cluster_id", "label")
    u = F.greatest(vx.cosine(F.col("vec"), F.col("centroid")), F.lit(0.0))
    return vecs.join(centroids, "label").select("label", "vec_id", u.alias("utility"))


@query
def exponential_mechanism(spark, sf):
    runs = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("run")
    cands = _candidates(spark, sf).select("*", runs)
    return draw.exponential_mechanism(
        cands, ["label", "run"], "vec_id", "utility", F.lit(EPSILON), DRAW_SEED
    )


@query
def exponential_probs(spark, sf):
    made = draw.exponential_probs(_candidates(spark, sf), ["label"], "utility", F.lit(EPSILON))
    return made.select("label", "vec_id", F.round("prob", 6).alias("prob"))


@query
def privatize_triples(spark, sf):
    queries, blocks, centroids = _vector_search(spark, sf)
    made = privatize.privatize_triples(
        queries.select("doc_id", "pos", "vec_id", "vec"), blocks, centroids, EPSILON, DRAW_SEED,
        passthrough=("vec_id",),
    )
    return made.select("doc_id", "pos", "vec_id", F.col("chosen.key").alias("chosen_id"))


@query
def privatize_triples_hot(spark, sf):
    """The same draw with small blocks, as of a hot cluster: the same winners."""
    queries, blocks, centroids = _vector_search(spark, sf, 16)
    made = privatize.privatize_triples(
        queries.select("doc_id", "pos", "vec_id", "vec"), blocks, centroids, EPSILON, DRAW_SEED,
        passthrough=("vec_id",),
    )
    return made.select("doc_id", "pos", "vec_id", F.col("chosen.key").alias("chosen_id"))


@query
def vector_clip(spark, sf):
    return unfolded(noise.clip_vectors(vectors(spark, sf)), ["vec_id"])


def _noisy(spark, sf, method, **options):
    made = noise.add_noise(vectors(spark, sf), 57.5, method, DRAW_SEED, dim=64, **options)
    return unfolded(made, ["vec_id"])


@query
def noise_laplace(spark, sf):
    return _noisy(spark, sf, "laplace")


@query
def noise_gaussian(spark, sf):
    return _noisy(spark, sf, "gaussian")


@query
def noise_analytic(spark, sf):
    choice = F.element_at(F.array(*[F.lit(e) for e in NOISE_EPSILONS]), F.col("label") % 3 + 1)
    vecs = vectors(spark, sf).withColumn("eps", choice)
    return unfolded(noise.add_noise(vecs, "eps", "analytic_gaussian", DRAW_SEED), ["vec_id"])


@query
def noise_shared(spark, sf):
    return _noisy(spark, sf, "gaussian", noise_per="doc")


@query
def privatize_vectors(spark, sf):
    made = noise.privatize_vectors(vectors(spark, sf), 57.5, "laplace", DRAW_SEED, dim=64)
    return unfolded(made, ["vec_id"])


def _logits(spark, sf):
    """Vectors as rows of logits, one per component."""
    logits = F.transform(vx.as_double(F.col("vec")), lambda x: x * F.lit(60.0))
    return vectors(spark, sf).select("doc_id", "pos", logits.alias("logits"))


@query
def logit_clip(spark, sf):
    rows = _logits(spark, sf).select("doc_id", "pos", F.posexplode("logits").alias("token", "logit"))
    return rows.select("doc_id", "pos", "token", F.round(tk.clamp(F.col("logit")), 6).alias("logit"))


@query
def budget_temperature(spark, sf):
    eps = tk.token_budget(F.lit(57.5), tx.tokens(tx.paraphrase_prompt(F.col("text"))))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(tk.temperature(eps), 6).alias("temperature"))


@query
def sample_tokens(spark, sf):
    rows = _logits(spark, sf).select("doc_id", "pos", F.posexplode("logits").alias("token", "logit"))
    return tk.sample_tokens(rows, F.lit(575.0), DRAW_SEED)


@query
def sample_tokens_direct(spark, sf):
    return tk.sample_rows(_logits(spark, sf), F.lit(100.0), DRAW_SEED)


@query
def token_budget(spark, sf):
    eps = tk.token_budget(F.lit(100.0), tx.tokens(tx.paraphrase_prompt(F.col("text"))))
    return table(spark, sf, "documents").select("doc_id", F.round(eps, 6).alias("eps"))


@query
def word_budget(spark, sf):
    eps = tk.word_budget(F.lit(100.0), tx.tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.round(eps, 6).alias("eps"))


def _turn_model(spark, sf):
    """Conversation turns as private texts, and a model of other, public ones."""
    return turns(spark, sf), ngram_lm.train_ngram_lm(corpus.spread(_lm_corpus(spark, sf)))


def _rewritten(spark, sf):
    docs, lm = _turn_model(spark, sf)
    return tk.rewrite_tokens(docs, tk.backoff(lm, LM_LOW, LM_HIGH), F.lit(50.0), DRAW_SEED)


@query
def word_neighbours(spark, sf):
    lm = ngram_lm.train_ngram_lm(corpus.spread(_lm_corpus(spark, sf)))
    near = wordvecs.word_neighbours(wordvecs.projected(wordvecs.information(lm)), GAMMA)
    return near.rows().select("word", "candidate", F.round("distance", 6).alias("distance"))


@query
def replace_words(spark, sf):
    """Each word among all words nearer than ``GAMMA``, whatever their cell."""
    docs, lm = _turn_model(spark, sf)
    near = wordvecs.word_neighbours(wordvecs.projected(wordvecs.information(lm)), GAMMA, 0)
    return tk.replace_words(docs, near, lm.bigrams, F.lit(EPSILON), GAMMA, DRAW_SEED)


@query
def rewrite_tokens(spark, sf):
    return _rewritten(spark, sf)


@query
def rewrite_text(spark, sf):
    return tk.join_tokens(_rewritten(spark, sf))


# ---- grids --------------------------------------------------------------------------------


@query
def epsilon_grid(spark, sf):
    return sw.epsilon_grid(datasets(spark, sf))


def _lower_words(df: DataFrame) -> DataFrame:
    """A stand-in mechanism for the grid queries: words only, lower-cased."""
    return df.select("doc_id", F.array_join(tx.words(F.col("text")), " ").alias("text"))


@query
def sweep(spark, sf):
    data = datasets(spark, sf)
    made = sw.sweep(data, sw.epsilon_grid(data), "words", sw.each_run(_lower_words))
    return made.select("dataset", "method", "epsilon", "doc_id", F.md5("text").alias("digest"))


@query
def sweep_mechanisms(spark, sf):
    """Two mechanisms over their grids: words of turns by role, triples of documents by source."""
    def words() -> DataFrame:
        spoken = corpus.spread(table(spark, sf, "conversations").select(
            F.col("role").alias("dataset"), (F.col("conv_id") * TURNS + F.col("turn")).alias("doc_id"), "text"
        ))
        model = ngram_lm.train_ngram_lm(corpus.spread(_lm_corpus(spark, sf)))
        near = wordvecs.word_neighbours(wordvecs.projected(wordvecs.information(model)), GAMMA)

        def mechanism(docs: DataFrame) -> DataFrame:
            return tk.join_tokens(tk.replace_words(docs, near, model.bigrams, "runs", GAMMA, DRAW_SEED))

        return sw.sweep(spoken, sw.epsilon_grid(spoken), "words", mechanism)

    def triples() -> DataFrame:
        lm, blocks, centroids = text_store(spark, sf)
        data = datasets(spark, sf)

        def mechanism(docs: DataFrame) -> DataFrame:
            return plan.privatize_documents(docs, lm, blocks, centroids, "runs", DRAW_SEED)

        return sw.sweep(data, sw.epsilon_grid(data), "triples", mechanism)

    parts = side_by_side(spark, words, triples)
    made = parts[0].unionByName(parts[1])
    return made.select("dataset", "method", "epsilon", "doc_id", F.md5("text").alias("digest"))


@query
def resume_grid(spark, sf):
    path = f"{scratch_dir(spark)}/resume-{uuid.uuid4().hex}"
    data = datasets(spark, sf)
    grid = cut_lineage(sw.epsilon_grid(data), "grid")
    smallest = grid.groupBy("dataset").agg(F.min("epsilon").alias("epsilon"))
    release.write_release(sw.sweep(data, smallest, "words", sw.each_run(_lower_words)), path)
    return sw.resume_grid(grid, release.finished_runs(spark, path), "words")


# ---- text assembly ------------------------------------------------------------------------


@query
def assemble_prompts(spark, sf):
    made = generate.assemble_prompts(tr.document_triples(documents(spark, sf)))
    rows = made.select("doc_id", F.posexplode("messages").alias("turn", "m"))
    return rows.select("doc_id", "turn", "m.role", "m.content")


@query
def paraphrase_prompt(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.paraphrase_prompt(F.col("text")).alias("prompt")
    )


@query
def reconstruct_text(spark, sf):
    docs = documents(spark, sf)
    return generate.reconstruct_text(tr.document_triples(docs), docs)


@query
def reconstruct_nodp(spark, sf):
    docs = documents(spark, sf)
    found, lm = deduped(spark, sf)
    return plan.privatize_documents(docs, lm, dp=False, triples=found.survivors)


@query
def clean_generation(spark, sf):
    rows = table(spark, sf, "conversations")
    raw = F.concat(
        F.lit("Sure.\nOutput text: "), F.col("text"), F.lit("\n"),
        F.when(F.col("turn") % 2 == 0, "Note: done").otherwise("USER: more"),
    )
    return rows.select("conv_id", "turn", tx.clean_generation(raw).alias("text"))


@query
def privatize_documents(spark, sf):
    """Documents rewritten with triples of a store that holds none of their own text."""
    lm, blocks, centroids = text_store(spark, sf)
    return plan.privatize_documents(documents(spark, sf), lm, blocks, centroids, EPSILON, DRAW_SEED)


# ---- evaluation ---------------------------------------------------------------------------


@query
def eval_align(spark, sf):
    made = evaluate.eval_align(datasets(spark, sf), verbalized(spark, sf))
    return made.select(
        "dataset", "doc_id", F.length("text").alias("n_private"), F.length("original").alias("n_original")
    )


@query
def cosine_by_model(spark, sf):
    made = evaluate.cosine_of_runs(datasets(spark, sf), verbalized(spark, sf))
    return made.withColumn("cos", F.round("cos", 6))


@query
def cosine_summary(spark, sf):
    made = evaluate.cosine_summary(
        evaluate.cosine_of_runs(datasets(spark, sf), verbalized(spark, sf))
    )
    shown = F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s)), ",")
    return made.withColumn("scores", shown)


@query
def eval_sample(spark, sf):
    rows = evaluate.eval_sample(verbalized(spark, sf).filter(F.col("text").isNotNull()), 20)
    return rows.select("dataset", "doc_id")


def _quality(spark, sf):
    docs = documents(spark, sf)
    lm = ngram_lm.train_ngram_lm(docs)
    aligned = evaluate.eval_align(datasets(spark, sf), verbalized(spark, sf))
    return evaluate.text_quality(cut_lineage(aligned), lm, [*evaluate.RUN, "doc_id"])


@query
def text_quality(spark, sf):
    return _quality(spark, sf).select(
        "dataset", "doc_id", "metric", F.round("score", 4).alias("score")
    )


@query
def judge_means(spark, sf):
    return evaluate.judge_means(_quality(spark, sf))


@query
def score_log(spark, sf):
    path = f"{scratch_dir(spark)}/scores-{uuid.uuid4().hex}"
    data, private = datasets(spark, sf), verbalized(spark, sf)
    release.export_scores(evaluate.cosine_summary(evaluate.cosine_of_runs(data, private)).drop("scores"), path, "cosine")
    release.export_scores(evaluate.judge_means(_quality(spark, sf)), path, "judge")
    schema = ", ".join(f"{c} double" for c in ("epsilon", "cs", *evaluate.METRICS))
    return release.read_scores(spark, path, f"dataset string, method string, {schema}")


@query
def eval_baseline(spark, sf):
    data = datasets(spark, sf)
    pairs = cut_lineage(evaluate.baseline_pairs(data))
    lm = ngram_lm.train_ngram_lm(data)
    return evaluate.judge_means(evaluate.text_quality(pairs, lm, [*evaluate.RUN, "doc_id"]))


@query
def eval_private(spark, sf):
    data = datasets(spark, sf)
    lm = ngram_lm.train_ngram_lm(data)
    return evaluate.evaluate_runs(data, verbalized(spark, sf), lm, 100, 42)
