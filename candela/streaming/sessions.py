"""Hourly session bars from ticks, in batch and as a stream.

Batch and event-time stream give the same bars; open and close follow event time. A session's volume is what the accumulated volume
has gained over the earlier sessions of the day, never less than zero; since that is a running
maximum, it needs no sequential pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First second, last second and label of each session.
SESSIONS = [("09:00:00", "09:59:59.999999", "09:00:00"), ("10:00:00", "11:30:00", "10:00:00"), ("13:00:00", "13:59:59.999999", "13:00:00"), ("14:00:00", "15:00:00", "14:00:00")]


def session_of(ts: Column) -> Column:
    """1 to 4, or null outside of trading hours; ends are inclusive to the microsecond."""
    clock = F.date_format(ts, "HH:mm:ss.SSSSSS")
    out = F
    for i, (lo, hi, _) in enumerate(SESSIONS):
        low, high = lo + ".000000", hi if "." in hi else hi + ".000000"
        out = out.when((clock >= low) & (clock <= high), i + 1)
    return out


#: The layouts of times in the feed, in the order they are tried, each with its shape.
STAMPS = [("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), ("yyyy/M/d H:m:s", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), ("yyyy-M-d H:m", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"), ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$")]


def parse_timestamp(text: Column) -> Column:
    """A time in one of four layouts, with a blank or T between date and clock; null for anything else."""
    t = F.trim(F.translate(text, "T", " "))
    # a layout is only tried on text of its shape: failing to parse is slow
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(f))) for f, shape in STAMPS]).cast("timestamp_ntz")


def start_of(date: Column, session: Column) -> Column:
    label = F.element_at(F.array(*[F.lit(s[2]) for s in SESSIONS]), session)
    return F.concat(date.cast("string"), F.lit(" "), label).cast("timestamp_ntz")


def session_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("session_index", session_of(F.col("timestamp"))).where("session_index IS NOT NULL")


def session_bars(ticks: DataFrame, *keys: Column) -> DataFrame:
    """(ticker, date, session): OHLC and the last accumulated volume and value. Works on streams too, in event time."""
    order = F.struct("timestamp", "event_id") if "event_id" in ticks.columns else F.col("timestamp")
    return session_ticks(ticks).groupBy("ticker", "date", "session_index", *keys).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.max_by("accumulated_volume", order).alias("acc_volume"), F.max_by("accumulated_value", order).alias("acc_value"), F.max("timestamp").alias("last_tick"),
    )


def hourly_bars(ticks: DataFrame) -> DataFrame:
    """BARS_1H of a batch of ticks."""
    day = Window.partitionBy("ticker", "date").orderBy("session_index")
    before = day.rowsBetween(Window.unboundedPreceding, -1)
    df = session_bars(ticks)
    gain = lambda c: F.greatest(F.col(c) - F.coalesce(F.max(c).over(before), F.lit(0)), F.lit(0))
    last = F.max("session_index").over(Window.partitionBy("ticker", "date"))
    return df.select("ticker", start_of(F.col("date"), F.col("session_index")).alias("datetime"), "date", "session_index", "open", "high", "low", "close", gain("acc_volume").cast("bigint").alias("volume"), gain("acc_value").cast("double").alias("value"), (F.col("session_index") < last).alias("is_closed"))


def stream_session_bars(ticks: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Session bars of a streaming DataFrame of ticks, for update mode; rows later than ``delay`` behind the newest are dropped by the watermark."""
    timed = ticks.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    # the day's window is the date again; with it in the key the watermark can drop the state of past days
    return session_bars(timed, F.window("event_time", "1 day").alias("day")).drop("day")


def upsert_batches(bars: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes changed bars to a versioned Parquet log; ``read_upserted`` gives the newest row of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return bars.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_upserted(spark, path: str, *keys: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("k = 1").drop("k", "batch")
