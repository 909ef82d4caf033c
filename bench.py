"""Time the headline queries: one warm-up run, then the median of three, written to the no-op sink."""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from grantlake.registry.queries import REGISTRY
from grantlake.session import build_session

HEADLINE = (
    "tokenize_tf",
    "keyword_retrieve_topk",
    "cosine_retrieve_topk",
    "answer_questions_table",
    "normalize_dispatch",
    "upsert_last_wins",
    "ckan_flatten",
    "page_title",
    "page_text_lines",
    "page_links_resolved",
    "labelled_page_fields",
    "page_sections",
    "pay_rates",
)
RUNS = 3


def seconds(spark, build, sf_dir: str) -> float:
    began = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "grantlake-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, REGISTRY[name], sf_dir)
        times[name] = round(statistics.median(seconds(spark, REGISTRY[name], sf_dir) for _ in range(RUNS)), 3)
    spark.stop()
    result = {
        "metric": "total median wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
