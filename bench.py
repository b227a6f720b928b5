"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from formproof.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "C9_all_findings", "C10_record_rollup", "D4_cross_field_findings", "E14_scrubbed_text",
    "E14_scrub_documents", "F1_labelled_instances", "G8_rule_score", "G8_rule_score_documents",
    "I8_blended_score", "J3_verdict_score", "K6_status", "L7_grouped_folds",
    "M3_threshold_for_recall", "M6_precision_recall_curve", "M10_evaluation",
    "N1_passages_in_documents", "O2_calibration_error", "O5_group_intervals",
    "P5_agreement_summary", "Q2_banded_flags", "Q8_assessment_priority", "R1_distributions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("formproof-bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (sys.argv[1:] or HEADLINE)]
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the session once
    timings = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
        print(f"{timings[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
