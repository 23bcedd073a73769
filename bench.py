"""Headline timings; prints one JSON line.

BENCH_SF_DIR   data directory (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local master (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from slotlake.session import configure  # noqa: E402
from slotlake.showcase import all_queries  # noqa: E402
from slotlake.showcase import lifecycle  # noqa: E402

# The text of the two largest imports is made before the clock starts, as the
# reference starts from a file as well.
HEADLINES = (
    "import_good_rows", "import_rejects", "reject_summary", "auto_id_from_one",
    "records_over_lines", "raw_lines", "chunk_checkpoints", "resume_from_line",
    "insert_batches", "ndjson_docs", "tsv_rewrite",
    "convert_uint", "convert_bigint", "convert_float", "convert_bool_strict",
    "convert_timestamp", "convert_multi", "convert_json", "all_types_typed", "all_types_sql",
    "import_and_read", "main_delta_union", "swap_then_read", "failed_import_keeps_old",
    "backup_restore", "stream_import", "stream_resume",
    "cluster_groups", "winner_per_cluster", "winner_preferred", "quorum", "fleet_status",
    "table_status_matrix", "table_health", "env_extract", "history_top50", "latest_job",
    "grid_search", "grid_page", "sql_passthrough", "broadcast_union",
)


def timed(run) -> float:
    start = time.monotonic()
    run()
    return round(time.monotonic() - start, 3)


def sink(df) -> None:
    """Run the whole query, every column and row, without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("slotlake-bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", "/tmp/slotlake-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    # Start-up and first compilation are not measured.
    sink(found["grid_pages"][0](spark, sf_dir))
    sink(found["all_types_typed"][0](spark, sf_dir))
    sink(found["import_and_read"][0](spark, sf_dir))

    path = lifecycle.lineitem_file(spark, sf_dir)
    rows = spark.read.text(path).count()
    times = {"import_lineitem": timed(lambda: lifecycle.import_lineitem_file(spark, path))}
    for name in HEADLINES:
        times[name] = timed(lambda: sink(found[name][0](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "slotlake headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "import_rows_per_sec": round(rows / times["import_lineitem"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
