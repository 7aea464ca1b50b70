"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ("summarize", "windowed_profile", "modes_whole", "modes_per_chapter", "generate_default", "shape_curve", "nearest_beat_nearest", "energy_per_chapter", "merge_analyze", "silence_islands", "events_roundtrip", "cfr_direct_play")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from chronoloom.plans import catalog

    def run(name: str) -> float:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for name in HEADLINE[:3]:  # compile and load once
        run(name)
    took = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline queries, best of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
