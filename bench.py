"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query runs once to warm
up and is then timed to a full read of its result by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from doclake.operators import chunking, embedding, retrieval, store  # noqa: E402
from doclake.plans.catalog import QUERIES  # noqa: E402
from doclake.plans.catalog import base, search  # noqa: E402
from doclake.session import build_session, scratch_dir, stage  # noqa: E402
from doclake.sources import tables  # noqa: E402

HEADLINE = [
    "chunk_text",
    "chunk_index",
    "hash_embed",
    "embed_memo",
    "upsert_chunks",
    "get_or_create_docs",
    "csv_rows",
    "sheet_rows",
    "detect_type",
    "url_public_ip",
    "topk_global",
    "topk_scoped",
    "context_budget",
    "groundedness",
    "rag_context",
    "ask_documents",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    begin = time.time()
    action()
    return round(time.time() - begin, 3)


def throughputs(spark, sf: str) -> dict[str, float]:
    """Rows per second of the steps the published figures speak of, each on staged input."""
    figures = {}
    sections = stage(base.whole_sections(spark, sf).repartition(spark.sparkContext.defaultParallelism), "sections")
    chunks = stage(chunking.chunk_sections(sections), "chunks")
    n = chunks.count()
    figures["chunks_per_sec"] = n / timed(lambda: run(chunking.chunk_sections(sections)))
    figures["encoded_chunks_per_sec"] = n / timed(lambda: run(embedding.embed(chunks, "chunk_text", "passage")))
    # against a store that holds half of them already, with the write of the other half
    half = stage(chunks.where(F.pmod(F.crc32(F.col("text_hash").cast("binary")), F.lit(2)) == 0), "half")
    folder = f"{scratch_dir(spark)}/upserted-{uuid.uuid4().hex}"
    figures["upserted_chunks_per_sec"] = n / timed(lambda: tables.write_chunks(store.new_chunks(chunks, half), folder))
    vectors = stage(embedding.embed(chunks, "chunk_text", "passage"), "vectors")
    asked = stage(embedding.embed(search.benchmark_questions(spark, sf), "question", "query"), "asked")
    took = timed(lambda: run(retrieval.top_k(asked, vectors)))
    figures["distances_per_sec"] = asked.count() * n / took
    figures["ms_per_query_batched"] = took * 1000 / asked.count()
    return {name: round(value, 1) for name, value in figures.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(QUERIES[name](spark, sf))
        times[name] = timed(lambda: run(QUERIES[name](spark, sf)))
        print(f"{name} {times[name]}s", file=sys.stderr, flush=True)
    figures = throughputs(spark, sf)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "throughput": figures,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
