"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line, in seconds (median of three warm runs)."""

from __future__ import annotations

import json
import os
import statistics
import time

from affinis.plans.catalog import QUERIES
from affinis.session import session

HEADLINE = [
    "top_users", "top_words", "category_avg", "user_baskets", "frequent_pairs", "jaccard_pairs", "tfidf_top", "dup_rating_mean", "item_pearson",
    "predict_item", "label_propagation", "components", "kmeans_fixed_seed", "cluster_stats", "bloom_probe", "fm_estimate", "sliding_distinct", "stream_equals_batch",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
