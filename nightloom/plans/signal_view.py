"""A deterministic signal view over the ``events`` table: eight recordings of one row a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom.storage import stored

RATE = 4


def signal_view(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``slow`` (rec, i, c, amp, effort, spo2, pulse, position) and ``flow`` (rec, j, flow) at 4 a second."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    # Numbered by recording and day, and by the sizes of the days before.
    events = events.withColumns({"rec": F.col("user_id") % 8, "day": F.to_date("ts")})
    order = Window.partitionBy("rec", "day").orderBy("ts", "event_id")
    before = Window.partitionBy("rec").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = events.groupBy("rec", "day").agg(F.count("*").alias("n"))
    days = days.select(F.col("rec").alias("_rec"), F.col("day").alias("_day"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slow = events.withColumn("place", F.row_number().over(order) - 1).join(days, F.col("rec").eqNullSafe(F.col("_rec")) & F.col("day").eqNullSafe(F.col("_day")))
    slow = slow.select("rec", (F.col("place") + F.col("before")).cast("long").alias("i"), F.round(F.col("value") * 100).cast("long").alias("c"))
    slow = slow.selectExpr(
        "rec", "i", "c",
        "case (i div 20) % 3 when 2 then 4L when 1 then 55L else 100L end as amp",
        """case (i div 100) % 3 when 0 then 0L when 1 then if(i % 2 = 0, 8L, -8L)
           else if(i % 20 < 10, 0L, if(i % 2 = 0, 8L, -8L)) end as effort""",
        "case when c % 97 = 0 then 127L when i % 20 < 8 and (i div 20) % 3 = 0 then 88L else 96L - c % 2 end as spo2",
        "case when c % 89 = 0 then 511L else 60L + c % 30 end as pulse",
        "1L + (i div 60) % 6 as position",
    )
    slow = stored(slow)  # stands for a table of signals: numbered once, read by every detector
    flow = slow.select("rec", "i", "c", "amp", F.explode(F.array(*[F.lit(k) for k in range(RATE)])).alias("k"))
    flow = flow.selectExpr(
        "rec", "4 * i + k as j", "amp * case when (i div 40) % 2 = 0 then if(k % 2 = 0, 1, -1) else if(i % 2 = 0, 1, -1) end + c % 3 as flow"
    )
    return {"slow": slow, "flow": flow, "truth": _truth(slow)}


def _truth(slow: DataFrame) -> DataFrame:
    """(rec, t, s, d): labelled events made of the samples, some of a kind that does not count."""
    kind = "element_at(array('OBSTR', 'cntrl', 'MIXED', 'HYPOP', 'OTHER'), cast(c div 53 % 5 as int) + 1)"
    return slow.where("c % 53 = 0 and rec <> 7").selectExpr("rec", f"{kind} as t", "cast(i as double) as s", "10.0D + c % 20 as d")
