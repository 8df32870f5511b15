"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trainset.queries import QUERIES, load_all  # noqa: E402
from trainset.session import build_session  # noqa: E402

HEADLINE = (
    "import_reject_report",
    "dedupe_exact_documents",
    "clean_documents_report",
    "dataset_stats_documents",
    "char_percentiles",
    "token_statistics",
    "trace_issue_report",
    "drop_trailing_turns",
    "train_eval_split",
    "render_chatml",
    "encode_sft_samples",
    "text_chunks",
    "packed_blocks",
    "length_batches",
    "tool_call_arguments",
    "smoothed_loss",
    "lineage_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
