"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from wavemill.plans import catalogue

HEADLINE = [
    "refractory_fraction", "isi_stats", "burst_segments", "correlogram_auto", "coincidence_matrix", "asof_previous", "band_anti_join", "clean_mask",
    "waveform_stats", "median_waveform", "mad_scale", "error_matrix", "similarity_matrix", "isolation_distance", "nearest_centroid",
    "burst_index", "mixture_classes", "butterworth_highpass", "multitaper_power", "median_filter", "fir_lowpass", "common_average_reference", "refractory_detection", "union_find", "undo_log",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the second run finds compiled code, as in a long session
            at = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - at)
        took[name] = round(best, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1].rstrip(".")) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
