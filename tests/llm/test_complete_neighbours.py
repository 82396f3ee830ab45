"""Every query gets its neighbours, also where its lists hold too few."""

import numpy as np

from veilmill.llm import ann


def test_all_queries_have_twenty(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 32)) * 2
    sizes = rng.integers(3, 400, 60)
    x = np.concatenate([c + rng.standard_normal((n, 32)) * 0.4 for c, n in zip(centres, sizes, strict=True)]).astype(np.float32)
    x *= rng.uniform(0.2, 3.0, len(x)).astype(np.float32)[:, None]
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    by = {}
    for r in ann.neighbours(table).collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    real, hit = x.astype(np.float64), []
    for q in range(0, len(x), 20):
        scores = real @ real[q]
        scores[q] = -np.inf
        assert len(by[q]) == 20
        hit.append(len(set(np.argsort(-scores)[:20].tolist()) & set(by[q])) / 20)
    assert np.mean(hit) >= 0.95
