"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from corpusflow.plans import registry
from corpusflow.session import build_session

HEADLINE = [
    "vs3_search_all_exact", "vs3_search_all_grouped_topk", "vs2_tenant_topk", "vs4_ivf_topk", "vs5_keyword_topk", "ex_extract_chunks", "ex10_links",
    "cr1_bfs", "tf1_char_ngrams", "lg1_train_nb", "lg2_score_nb", "bn1_binary_nb", "cq2_template_swaps", "cs1_language_fold",
    "cs2_constraint_fold", "ge11_rank_fill", "rc1_recommend", "rc5_weighted_sources", "snk1_upsert", "bi2_health",
    "bi8_durations", "st3_rate_limit",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # start the Python workers before the clock; the queries themselves run cold, once each
    spark.read.parquet(f"{sf}/nation.parquet").repartition(spark.sparkContext.defaultParallelism) \
        .mapInPandas(lambda batches: batches, "n_nationkey int, n_name string, n_regionkey int").count()
    took = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
