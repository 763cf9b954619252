"""Seconds per registered query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``python bench.py name ...`` times only the named queries; ``BENCH_ALL=1`` times every query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from chartloom.catalog import load
from chartloom.session import build_session

HEADLINE = [
    "patient_findings",
    "parsed_measurements",
    "containment_join",
    "overlap_join",
    "cohort_notes",
    "cohort_labs",
    "cohort_drugs",
    "complete_cases",
    "age_histogram",
    "drugs_by_code_prefix",
    "edit_distance_matches",
    "jaro_winkler_matches",
    "nearest_vectors",
    "codes_per_synonym",
    "text_patient_flags",
    "source_comparison",
    "value_boxes",
    "value_density",
    "exact_match_counts",
    "inclusive_match_counts",
    "bootstrap_intervals",
    "end_to_end_scores",
    "value_scores",
    "balanced_split",
    "term_tagging",
    "note_chunks",
    "overlaps_resolved",
    "standoff_full_entities",
    "standoff_entities",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='chartloom-bench-')}",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    names = sys.argv[1:] or (list(catalog) if os.environ.get("BENCH_ALL") else HEADLINE)
    # Start the executors and compile the common code paths on the smallest tables before timing.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("patient_findings", "jaro_winkler_matches"):
        run(spark, catalog[name], small if os.path.isdir(small) else sf_dir)
    times = {}
    for name in names:
        times[name] = run(spark, catalog[name], sf_dir)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
