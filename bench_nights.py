"""Times the detectors on nights of real size: 8 hours, flow at 100 a second, everything else at 1.

``python bench_nights.py 1 15`` prints a JSON line per number of nights: the seconds of the first
run, made before the compiler has warmed up, and of the best of two more. The nights are made
by Spark and written once, as the stretches of samples that the source of recordings gives.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nightloom.operators import detect, report

HOURS, RATE = 8, 100


def nights(spark: SparkSession, n: int, folder: str) -> dict:
    """Signals of ``n`` nights with pauses, shallow breaths and falls of oxygen."""
    seconds = HOURS * 3600
    slow = spark.range(n * seconds).selectExpr(f"id div {seconds} as rec", f"id % {seconds} as i", "pmod(xxhash64(id), 1000) as c")
    slow = slow.selectExpr(
        "rec", "i", "case (i div 20) % 7 when 3 then 4L when 1 then 55L else 100L end as amp", "if((i div 100) % 3 = 0, 0L, if(i % 2 = 0, 8L, -8L)) as effort",
        "case when c < 3 then 127L when (i div 20) % 7 = 4 then 88L else 96L - c % 2 end as spo2", "case when c > 996 then 511L else 60L + c % 30 end as pulse", "1L + (i div 1800) % 6 as position",
    )
    slow.write.mode("overwrite").parquet(f"{folder}/slow-{n}")
    # A breath of four seconds, by the second; ten minutes make a stretch.
    wave = F.transform(F.sequence(F.lit(0), F.lit(RATE - 1)), lambda k: F.col("amp") * F.sin((F.col("i") * RATE + k) * 0.0157) + F.pmod(F.col("i") * 7 + k * 13, F.lit(5)))
    flow = slow.withColumn("x", wave).groupBy("rec", F.expr("i div 600").alias("part"))
    flow = flow.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("parts"))
    flow.select("rec", (F.col("part") * 600 * RATE).alias("first"), F.flatten("parts.x").alias("samples")).write.mode("overwrite").parquet(f"{folder}/flow-{n}")
    return {"slow": spark.read.parquet(f"{folder}/slow-{n}"), "flow": spark.read.parquet(f"{folder}/flow-{n}")}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "16")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="nightloom-nights-")
    for n in map(int, sys.argv[1:] or ["1"]):
        view, took = nights(spark, n, folder), []
        for _ in range(3):
            began = time.time()
            events = detect.all_events(view, RATE)
            report.indices(events, view["slow"]).write.format("noop").mode("overwrite").save()
            took.append(round(time.time() - began, 2))
        print(json.dumps({"nights": n, "samples": n * HOURS * 3600 * RATE, "first": took[0], "warm": min(took[1:]), "warm_per_night": round(min(took[1:]) / n, 2)}), flush=True)


if __name__ == "__main__":
    main()
