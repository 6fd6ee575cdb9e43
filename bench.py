"""Headline workload timings; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through Spark's ``noop`` sink (nothing is
collected to the driver) in one warm session; the value is the sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.config import Settings  # noqa: E402
from quarry.plans import commands  # noqa: E402
from quarry.plans.retrieval import build_index, read_index, retrieve, write_index  # noqa: E402
from quarry.session import get_session, scratch_path  # noqa: E402
from quarry.operators import chunking  # noqa: E402
from quarry.sources import tables  # noqa: E402
from quarry.streaming import jobs  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", app="quarry-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    s = Settings()
    docs = tables.documents(spark, sf_dir)
    bench_q = tables.benchmark_queries(spark, sf_dir)

    # warm-up on the smallest input so JIT and class loading are not timed
    run(retrieve(tables.benchmark_queries(spark, "/root/testdata/sf0.001"),
                 build_index(tables.documents(spark, "/root/testdata/sf0.001"), s), s).hits)

    timings = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        timings[name] = round(time.time() - t0, 3)

    # prompts served from the stored index, rate audit over the request log
    out = scratch_path(spark, "bench-index")
    timed("chunk", lambda: run(chunking.chunk_documents(docs, s.chunk_size, s.delimiters)))
    timed("index", lambda: write_index(build_index(docs, s), out))
    stored = read_index(spark, out)
    timed("search", lambda: run(retrieve(bench_q, stored, s).hits))
    timed("prompts", lambda: run(retrieve(bench_q, stored, s).prompts))
    timed("rate_audit", lambda: run(jobs.rate_audit(tables.events(spark, sf_dir))))
    # the two commands over the corpus files: load into a new collection, one
    # changed load of it, and serve from its postings
    coll, parsed = scratch_path(spark, "bench-coll"), scratch_path(spark, "bench-parsed")
    got = tables.corpus_files(spark, sf_dir)
    timed("load", lambda: commands.load_files(spark, got, coll, parsed, s))
    timed("load_unchanged", lambda: commands.load_files(spark, got, coll, parsed, s))
    timed("serve", lambda: run(commands.serve(spark, coll, bench_q, s).hits))
    # the flagship registered query: documents to ranked hits in one plan
    timed("search_from_documents", lambda: run(retrieve(bench_q, build_index(docs, s), s).hits))

    total = sum(v for k, v in timings.items() if k not in ("load", "load_unchanged", "serve"))
    print(json.dumps({"metric": "workload_total_sec", "value": round(total, 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
