"""Time the headline queries and print one JSON line. The tables the queries share are prepared first, as their own entry."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kgspark.plans import canonical as K  # noqa: E402
from kgspark.registry import load_all  # noqa: E402
from kgspark.session import get_spark  # noqa: E402

HEADLINE = [
    "answer_by_traversal", "follow_path", "enumerate_simple_paths", "bm25_search", "dense_search", "rrf_fuse", "retrieval_report", "answer_report",
    "entity_recall", "majority_vote", "chain_index", "contrastive_examples", "classify_question",
]
# queries that answer one question per order
PER_ORDER = {"answer_by_traversal", "follow_path", "enumerate_simple_paths", "all_shortest_paths", "bfs_paths_undirected", "retrieve_with_fallbacks",
             "rrf_fuse", "retrieval_report", "answer_report", "entity_recall", "majority_vote", "contrastive_examples"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    times: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine
    timed("prepare_tables", lambda: [t(spark, sf_dir) for t in (K.triples, K.subgraphs, K.paths)])
    for name in only:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    orders = K.table(spark, sf_dir, "orders").count()
    rate = {n: round(orders / t, 1) for n, t in times.items() if n in PER_ORDER}
    print(json.dumps({"metric": "headline queries, total wall clock", "value": total, "unit": "sec", "queries": times, "questions_per_second": rate, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
