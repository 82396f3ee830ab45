"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from veilmill.plans.queries import QUERIES  # noqa: E402
from veilmill.session import build_session  # noqa: E402

# Not in the default set, because untimed at sf0.1 so far: surviving_triples, stream_ingest,
# eval_private, privatize_documents.  Name them as arguments to run them.
HEADLINE = (
    "corpus_filter", "extract_triples", "minhash_signature", "lsh_index", "star_clusters",
    "perplexity", "nearest_centroid", "cluster_topk", "privatize_triples", "noise_analytic",
    "sample_tokens", "sweep", "cosine_summary",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
