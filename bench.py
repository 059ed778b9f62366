"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from lodestone.plans import registry

HEADLINE = [
    "L01_exact", "L03_fuzzy", "L04_surname_component", "L09_resolve_best_class", "L11_L12_greedy_allocation", "L18_L22_linkage_tier", "L27_waterfall",
    "J10_J14_coverage_orders_customer", "J18_edit_join", "W06_W07_spells", "O05_O08_tiers", "O24_W04_cardinality", "O25_cardinality_ever", "A01_A04_aggregates", "A05_A07_pivot", "A12_A13_apportion",
    "C06_effective_share", "G01_geocode_conflicts", "J25_G07_points_in_polygons", "X01_X02_wilson_ppv", "X07_spearman", "X08_quantiles", "F34_safe_divide", "S20_html_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, took = registry.queries(), {}
    every[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up and warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
