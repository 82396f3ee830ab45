"""Means above the bound of the distribution table."""

from veilmill.llm import mixing


def test_a_large_mean_is_drawn(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id < 20, 'rare', 'b') as source", "'t' as text")
    wanted = spark.createDataFrame([("rare", 20, 2418.0), ("b", 380, 0.5)], "source string, n_rows long, mean double")
    counts = [r["count"] for r in mixing.replicate(docs, wanted, "s").where("source = 'rare'").groupBy("doc_id").count().collect()]
    mean = sum(counts) / 20
    assert len(counts) == 20 and abs(mean - 2418) < 5 * (2418 / 20) ** 0.5
    assert 900 < sum((c - mean) ** 2 for c in counts) / 19 < 6000  # about the mean
    one = docs.where("source = 'rare'").limit(1).unionByName(spark.range(400000).selectExpr("id + 1000 as doc_id", "'b' as source", "'t' as text"))
    weights = spark.createDataFrame([("rare", 1.0), ("b", 99.0)], "source string, weight double")
    mixed = {r.source: r["count"] for r in mixing.mix(one, "s", weights).groupBy("source").count().collect()}
    assert abs(mixed["rare"] - 4000) < 350
