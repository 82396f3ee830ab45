import re
import statistics

import numpy as np
import pyarrow as pa

from veilmill.functions import runs
from veilmill.operators import evaluate, ngram_lm

TEXTS = ["One two. One two!  Three", "", None, "ab", "GrößeKİx 9a.b?c\nd", "...", "the end", "End the"]


def _words(text):
    return [w.lower() for w in re.findall("[A-Za-z]+", text or "")]


def test_words_of_a_sliced_batch_are_those_of_each_text():
    texts = pa.array(["skipped words", *TEXTS])[1:]
    words, counts, _ = runs.split_words(texts)
    assert words.to_pylist() == [w for t in TEXTS for w in _words(t)]
    assert counts.tolist() == [len(_words(t)) for t in TEXTS]


def test_measures_of_texts(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    parts = [runs.measures(some["text"]) for some in runs.chunks(batch)]
    made = {name: np.concatenate([p[name] for p in parts]).tolist() for name in parts[0]}
    for i, text in enumerate(TEXTS):
        words = _words(text)
        pieces = [n for n in (len(_words(s)) for s in re.split(r"[.!?\n]+", text or "")) if n]
        expected = (len(words), sum(map(len, words)), len(pieces), sum(n * n for n in pieces), len(set(zip(["<s>", *words], words))))
        assert tuple(made[c][i] for c in ("n_words", "letters", "sentences", "squares", "bigrams")) == expected


def test_no_bigram_list_or_partial_map_of_a_whole_task(spark):
    """counts leave a task in chunks; text_quality exchanges numbers, never words."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    counts = {(r.prev, r.word): r.n for r in ngram_lm.bigram_counts(docs).collect()}
    expected = {}
    for text in TEXTS:
        for pair in zip(["<s>", *_words(text)], _words(text)):
            expected[pair] = expected.get(pair, 0) + 1
    assert counts == expected
    plan = ngram_lm.bigram_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "regexp" not in plan


def test_quality_numbers(spark, monkeypatch):
    docs = spark.createDataFrame([("d", i, t) for i, t in enumerate(TEXTS)], "dataset string, doc_id bigint, text string")
    pairs = evaluate.baseline_pairs(docs)
    lm = ngram_lm.train_ngram_lm(docs)
    ids = [*evaluate.RUN, "doc_id"]
    rows = evaluate.text_quality(pairs, lm, ids).collect()
    monkeypatch.setattr(ngram_lm, "LIGHT_MODEL", 0)
    assert sorted(map(str, rows)) == sorted(map(str, evaluate.text_quality(pairs, lm, ids).collect()))
    plan = evaluate.text_quality(pairs, lm, ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan
    scores = {(r.doc_id, r.metric): r.score for r in rows}
    assert round(scores[0, "sent_len_stddev"] - statistics.pstdev([2, 2, 1]), 12) == 0
    assert scores[0, "repeated_bigram_ratio"] == 1.0 - 4 / 5
    assert scores[1, "mean_word_len"] is scores[2, "bigram_ppl"] is scores[5, "sent_len_stddev"] is None


def test_unknown_bigrams_and_first_words_of_a_large_model(spark, monkeypatch):
    lm = ngram_lm.train_ngram_lm(spark.createDataFrame([("a b a c",)], "text string"))
    texts = spark.createDataFrame([(1, "a b"), (1, "z a a"), (None, "a z q"), (3, "")], "id bigint, text string")
    light = sorted(map(str, ngram_lm.perplexity(texts, lm, ["id"]).collect()))
    monkeypatch.setattr(ngram_lm, "LIGHT_MODEL", 0)
    assert sorted(map(str, ngram_lm.perplexity(texts, lm, ["id"]).collect())) == light and len(light) == 2
    assert ngram_lm.perplexity(texts, lm, ["id"], 1).agg({"n_words": "sum"}).first()[0] == 3
