"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query is run once to warm up and then timed until its last row is written to nowhere.
"""

from __future__ import annotations

import json
import os
import time

from burrstone import registry
from burrstone.session import get_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: A query for each kind of work: pattern joins, equi-joins, aggregation, cube, order, containers, graph, clustering.
HEADLINE = [
    "tri_leftdeep", "square_leftdeep", "twohop_distinct", "tri_hypercube", "hash_join", "semi_join", "theta_join", "group_sum_count", "keep_first",
    "cube_views", "wordcount", "prefix_sum", "bucket_sort_rank", "scatter_increment", "bfs_levels_hybrid", "sssp_dist", "components", "pagerank_k", "spmv", "kmeans_k",
]


def main() -> None:
    spark = get_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
