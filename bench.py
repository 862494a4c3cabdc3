"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS; prints one JSON line.

The tables of texts, pages and parts are first written again, untimed, in a file for each cpu: large ones come in many
splits, while each of the given files is one, which a single task would read.
"""

import json
import os
import statistics
import tempfile
import time

import pyspark

from corpusloom.plans.catalog import QUERIES
from corpusloom.session import build_session, scratch_path

HEADLINE = {
    "semantic_top3": "semantic_search",
    "semantic_batch": "semantic_search_batch",
    "fuzzy_name_top3": "find_function_match",
    "refresh_index": "refresh_index",
    "extract_blocks": "extract_blocks",
    "sentence_chunks": "sentence_chunks",
    "pack_context": "pack_context",
    "reach_depth5": "children_by_depth",
    "memory_epochs": "memory_epochs",
    "page_links": "domain_links",
    "embed_documents": "embed_documents",
    "html_to_text": "html_to_text",
}


def run(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def in_splits(spark, sf_dir: str, files: int) -> str:
    """The tables that the queries read, with the same rows, those of long rows in so many files."""
    path = scratch_path(spark, "bench-tables")
    for name, split in {"documents": files, "pages": files, "part": files, "conversations": 1, "embeddings": 1}.items():
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(split).write.parquet(f"{path}/{name}.parquet")
    return path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp()},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, given = {}, sf_dir
    sf_dir = in_splits(spark, sf_dir, int(cpus))
    for label, name in HEADLINE.items():
        run(spark, name, sf_dir)
        times[label] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": pyspark.__version__,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
