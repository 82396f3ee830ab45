"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
FAST = [
    "corpus_filter", "corpus_cap", "detokenize", "extract_triples", "lsh_index", "perplexity",
    "nearest_centroid", "cluster_topk", "exponential_mechanism", "privatize_triples_hot",
    "noise_analytic", "sample_tokens", "resume_grid", "reconstruct_text", "judge_means",
    "cosine_summary", "cosine_by_model", "score_log", "release_roundtrip", "release_discovery",
]


def test_every_oracle_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    made = sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))
    result = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert made == sorted(map(repr, (tuple(r[i] for i in at) for r in result.fetchall())))
