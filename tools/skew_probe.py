"""Skew probe: a third of all ledger lines moved to one customer.

Usage: python tools/skew_probe.py [sf_dir] [shuffle_partitions]

Derives a skewed ledger from the test tables (every third transaction is
reassigned to customer 1), runs the 4-day feature frame with an event log in
a fresh scratch folder, and prints per-stage shuffle records per task
(max / median).  Balanced aggregation stages mean the hot key was absorbed
by the map-side combines.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from churnscope.operators import asof as A  # noqa: E402
from churnscope.operators import features as FE  # noqa: E402
from churnscope.sources import fixtures as X  # noqa: E402


def _events(folder: str) -> list[dict]:
    path = glob.glob(f"{folder}/*/events*")[0]
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
    return [json.loads(line) for line in raw.decode().splitlines() if line.strip()]


def main(argv: list[str]) -> None:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    parts = argv[2] if len(argv) > 2 else "32"
    logs = tempfile.mkdtemp(prefix="skew-events-")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
             .config("spark.sql.shuffle.partitions", parts)
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    led = X.ledger(spark, sf)
    hot = led.withColumn("CUSTNO", F.when(F.col("TRANSREFNO") % 3 == 0, F.lit(1)).otherwise(F.col("CUSTNO")))
    df = FE.feature_frame(hot, X.register(spark, sf), A.backtest_days(spark, X.TRAINING_END))
    df.write.format("noop").mode("overwrite").save()
    spark.stop()
    per_stage: dict[int, list[tuple[int, int]]] = {}
    for e in _events(logs):
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            per_stage.setdefault(e["Stage ID"], []).append((
                m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0),
                m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)))
    for sid, ts in sorted(per_stage.items()):
        rd, wr = [t[0] for t in ts], [t[1] for t in ts]
        if max(rd) or max(wr):
            print(f"stage {sid:3d} tasks={len(ts):3d} shuffle read max/median={max(rd)}/{statistics.median(rd):.0f}"
                  f" write max/median={max(wr)}/{statistics.median(wr):.0f}")


if __name__ == "__main__":
    main(sys.argv)
