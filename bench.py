"""Benchmark of the headline queries.

Runs each query once to warm up the JVM and the code caches, then times a full execution (a
``noop`` write, so every row is produced but nothing is collected to the driver). Reads
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "deals",                  # flagship: spread + exact median + top-500
    "current_offers",         # latest observation per key
    "normalize_outcomes",     # feed → classified items (ingest front half)
    "spike_outcomes",         # spike-aware LWW fold (ingest back half)
    "new_products",           # insert-if-absent + dense ids
    "daily_rollup",           # history rollup
    "price_history",          # rollup read with month pruning
    "collection_items",       # every collection rule at once
    "search_broad_capped",    # ranked search with the 1,000 cap
    "document_postings",      # inverted index over the documents corpus
    "product_embeddings",     # feature hashing over the catalog
    "similar_products",       # exact k-NN
    "ops_latency_quantiles",  # windowed exact quantiles
    "change_feed_gaps",       # dense sequence + gap detection
]


def main() -> None:
    from pricelake.plans.registry import queries
    from pricelake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", max(cpus * 2, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g"),
                                 "spark.sql.files.maxPartitionBytes": str(64 << 20)})
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]

    def run(name: str, d: str = sf_dir) -> float:
        t0 = time.time()
        qs[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.time() - t0

    # Warm-up on the small scale factor: JIT and generated code for every plan shape, so the
    # timed run at the target scale measures execution, not compilation.
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.01"))
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for n in names:
        run(n, warm_dir)
    times = {}
    for n in names:
        times[n] = round(run(n), 3)
    throughput = {}
    if not sys.argv[1:]:
        ingest_end_to_end(spark, warm_dir)
        n_items, secs = ingest_end_to_end(spark, sf_dir)
        times["ingest_end_to_end"] = round(secs, 3)
        throughput["ingest_items_per_sec"] = round(n_items / secs)
        n_products = spark.read.parquet(f"{sf_dir}/part.parquet").count()
        throughput["embed_products_per_sec"] = round(n_products / times["product_embeddings"])
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "throughput": throughput}))


def ingest_end_to_end(spark, sf_dir: str) -> tuple[int, float]:
    """The whole ingest step (normalize, dedupe, create products, spike rule, LWW, quarantine,
    history, rollup, outcomes — every sink written) over the landed synthetic feed, as one batch.
    Comparable with the reference's seed-ingest rate (offers/s)."""
    import datetime as dt
    import tempfile

    from pyspark.sql import functions as F

    from pricelake.session import checkpoint_dir, freeze
    from pricelake.sources import fixtures as fx
    from pricelake.sources.feed import synthetic_items
    from pricelake.streaming import ingest

    checkpoint_dir(spark)
    r = fx.retailers(spark, sf_dir)
    slugs = F.broadcast(r.select(F.col("id").alias("retailer_id"), F.col("slug").alias("retailer")))
    items = freeze(synthetic_items(spark, sf_dir).join(slugs, "retailer_id")
                   .select("retailer", "page", "pos", "raw"), "bench-landed")   # landed pages
    n = items.count()
    out = tempfile.mkdtemp(prefix="bench-ingest-", dir=os.environ.get("BENCH_SCRATCH", "/tmp"))
    t0 = time.time()
    ingest.process_batch(items, 0, ingest.Paths(out), r, dt.datetime(2002, 1, 1))
    return n, time.time() - t0


if __name__ == "__main__":
    main()
