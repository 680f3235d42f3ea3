"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from foliospark.plans import queries as Q

HEADLINES = ("ingest_files", "pending_pages", "resolve_attempts", "region_hits", "adaptive_threshold", "column_text", "extract_text_for_regions", "assemble_report", "collect_candidates", "layout_scan")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = Q.queries()
    every["ingest_files"](spark, sf_dir).limit(1).collect()  # start Python and the code generator
    took = {}
    for name in HEADLINES:
        began = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "document queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
