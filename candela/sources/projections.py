"""Bars, index snapshots and ticks projected from the order tables.

The tables hold no market data, so daily bars are made of the trades of a brand (ticker), index
rows of the orders of a region (exchange), and ticks of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BARS_1D: one row for each ticker and date."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").cast("bigint").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_linestatus", "l_returnflag")
    sell, buy, foreign = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    add = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    g = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("total_trade"), F.sum("q").alias("total_volume"), F.sum("v").cast("double").alias("total_value"),
        (F.sum("v").cast("double") / F.sum("q").cast("double")).alias("close"), F.max("px").alias("high"), F.min("px").alias("low"),
        add(sell, F.col("v")).cast("double").alias("fv"), add(sell, F.col("q")).alias("fq"), add(buy, 1).cast("bigint").alias("buy_count"), add(sell, 1).cast("bigint").alias("sell_count"),
        add(buy, F.col("q")).alias("buy_volume"), add(sell, F.col("q")).alias("sell_volume"), add(foreign & buy, F.col("q")).alias("foreign_buy_volume"), add(foreign & sell, F.col("q")).alias("foreign_sell_volume"),
        add(foreign & buy, F.col("v")).cast("double").alias("foreign_buy_value"), add(foreign & sell, F.col("v")).cast("double").alias("foreign_sell_value"),
    )
    w = Window.partitionBy("ticker").orderBy("date")
    room = F.lit(10_000_000) - F.sum(F.col("foreign_buy_volume") - F.col("foreign_sell_volume")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    opened = F.when(F.col("fq") > 0, F.greatest("low", F.least("high", F.try_divide(F.col("fv"), F.col("fq").cast("double"))))).otherwise(F.col("close"))
    return g.select(
        "ticker", "date", F.coalesce(F.lag("close").over(w), "close").alias("prev_close"), opened.alias("open"), "high", "low", "close", "total_trade", "total_value", "total_volume",
        "buy_count", "sell_count", "buy_volume", "sell_volume", "foreign_buy_volume", "foreign_sell_volume", "foreign_buy_value", "foreign_sell_value", room.cast("bigint").alias("foreign_room"),
    )


def flawed(bars: DataFrame) -> DataFrame:
    """Bars with what good ones lack: previous closes that do not match, days without volume, moves of the foreign room."""
    day, month = F.dayofmonth("date"), F.month("date")
    return bars.withColumns({
        "prev_close": F.when(day == 13, F.col("prev_close") * 1.0213131).otherwise(F.col("prev_close")),
        "total_volume": F.when(day == 21, F.lit(0).cast("bigint")).otherwise(F.col("total_volume")),
        "foreign_room": F.col("foreign_room") + F.when(month % 2 == 0, 250_000).otherwise(0),
    })


#: Newest rows that :func:`uneven` leaves of a ticker, by its number modulo 5.
LEFT = (15, 45, 51, 52, 230)


def uneven(bars: DataFrame) -> DataFrame:
    """Bars of short and broken histories: few rows by ticker, closes with a trend, and one of zero for every third ticker."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    number = F.split_part("ticker", F.lit("#"), F.lit(2)).cast("int")
    left = F.get(F.array(*map(F.lit, LEFT)), number % 5)
    close = F.when((F.col("k") == 40) & (number % 3 == 0), 0.0).otherwise(F.col("close") * (1 + (300 - F.col("k")) * 0.02))
    return bars.withColumn("k", k).where(F.col("k") <= left).withColumn("close", close).drop("k")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNAPSHOT: ticks with accumulated volume and value of the day."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(
        F.col("event_type").alias("ticker"), F.col("ts").alias("timestamp"), F.to_date("ts").alias("date"), F.col("value").alias("price"),
        (F.row_number().over(w) * 100).cast("bigint").alias("accumulated_volume"),
        F.sum(F.col("value").cast("decimal(18,2)") * 100).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("accumulated_value"),
        "event_id",
    )


def index_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INDEX_1D: one row for each exchange and date."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("exchange"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "exchange")
    count = lambda s: F.count_if(F.col("o_orderstatus") == s).cast("int")
    g = o.join(c, o["o_custkey"] == c["c_custkey"]).join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("exchange", "date").agg(
        F.count(F.lit(1)).alias("total_trade"), F.sum("v").cast("double").alias("total_value"), F.countDistinct("o_custkey").alias("total_volume"),
        count("F").alias("advances"), count("O").alias("declines"), count("P").alias("unchanged"),
    ).withColumn("index_current", F.col("total_value") / F.col("total_trade").cast("double"))
    p = F.lag("index_current").over(Window.partitionBy("exchange").orderBy("date"))
    return g.withColumn("p", p).select(
        "exchange", "date", "index_current", F.coalesce(F.col("index_current") - F.col("p"), F.lit(0.0)).alias("index_change"),
        F.coalesce((F.col("index_current") - F.col("p")) / F.col("p") * 100, F.lit(0.0)).alias("index_percent_change"),
        "total_trade", "total_value", "total_volume", "advances", "declines", "unchanged",
    )
