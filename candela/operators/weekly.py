"""Weekly bars, 52-week statistics and market breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import W, cases, cents, r2, r6, ratio, recent

SUMMED = [
    "total_trade", "total_value", "total_volume", "buy_count", "sell_count", "buy_volume", "sell_volume",
    "foreign_buy_volume", "foreign_sell_volume", "foreign_buy_value", "foreign_sell_value",
]


def weekly_bars(bars: DataFrame) -> DataFrame:
    """One row for each ticker and ISO week, named by its last trading date."""
    g = bars.groupBy("ticker", F.date_trunc("week", F.col("date").cast("timestamp_ntz")).alias("week")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.max_by("foreign_room", "date").alias("foreign_room"), F.count(F.lit(1)).alias("trading_days"), *[F.sum(c).alias(c) for c in SUMMED])
    return g.withColumn("prev_close", F.lag("close").over(W())).drop("week")


def weekly_bars_view(bars: DataFrame) -> DataFrame:
    money = {"total_value", "foreign_buy_value", "foreign_sell_value"}
    return weekly_bars(bars).select("ticker", "date", r6("prev_close").alias("prev_close"), r6("close").alias("close"), *[r2(c).alias(c) if c in money else F.col(c) for c in SUMMED], "foreign_room", "trading_days")


def thin_weeks(bars: DataFrame, days: int = 3) -> DataFrame:
    return weekly_bars(bars).where(F.col("trading_days") < days).select("ticker", "date", "trading_days")


#: Fixed value: sessions from which on figures are of a full year.
FULL_YEAR = 240


def stats_52w(bars: DataFrame, n: int = 250, required: int | None = None) -> DataFrame:
    """Extremes of the last n closes (the earliest of equals), distance to them, drawdown, return and means.

    Null below ``required`` rows: 20, or 80 % of n if that is more.
    """
    required = max(20, n * 4 // 5) if required is None else required
    df = recent(bars, n).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date"))).withColumn("peak", F.max("close").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    g = df.groupBy("ticker").agg(
        F.max("date").alias("date"), F.count(F.lit(1)).alias("window_sessions"), F.max(F.struct("close", (-F.col("day")).alias("back"))).alias("h"), F.min(F.struct("close", "day")).alias("l"),
        F.max_by("close", "date").alias("close"), F.min_by("close", "date").alias("first"), F.min(ratio("close", "peak") - 1).alias("dd"), F.avg("total_volume").alias("v"), F.avg("total_value").alias("m"),
    )
    g = g.withColumn("high", F.col("h.close")).withColumn("low", F.col("l.close"))
    as_date = lambda d: F.date_add(F.lit("1970-01-01").cast("date"), d.cast("int"))
    share = lambda base: F.when(F.col(base) > 0, (F.col("close") - F.col(base)) / F.col(base) * 100).otherwise(0.0)
    figures = {
        "is_full": F.col("window_sessions") >= FULL_YEAR, "high": r6("high"), "high_date": as_date(-F.col("h.back")), "low": r6("low"), "low_date": as_date(F.col("l.day")),
        "from_high_pct": r6(share("high")), "from_low_pct": r6(share("low")), "max_drawdown_pct": r6(F.col("dd") * 100), "return_pct": r6(share("first")), "avg_volume": r2("v"), "avg_value": r2("m"),
    }
    enough = F.col("window_sessions") >= required
    return g.select("ticker", "date", "window_sessions", F.lit(required).cast("bigint").alias("required"), *[F.when(enough, c).alias(k) for k, c in figures.items()])


def normalized_100(bars: DataFrame, n: int = 250) -> DataFrame:
    first = F.first("close").over(W().rowsBetween(Window.unboundedPreceding, 0))
    return recent(bars, n).select("ticker", "date", r6(F.col("close") / first * 100).alias("normalized"))


def index_latest(index: DataFrame) -> DataFrame:
    newest = Window.partitionBy("exchange").orderBy(F.desc("date"))
    return index.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")


def market_breadth(index: DataFrame) -> DataFrame:
    """Advances over declines of the newest row of each exchange, and its regime by the rounded ratio."""
    df = index_latest(index).withColumn("ad", F.when(F.col("declines") > 0, cents(ratio("advances", "declines"))))
    x, a = F.col("ad"), F.col("advances")
    regime = cases((x.isNull() & (a > 0), "strongly_bullish"), (x.isNull(), "neutral"), (x >= 2, "strongly_bullish"), (x >= 1.2, "bullish"), (x >= 0.8, "neutral"), (x >= 0.5, "bearish"), otherwise="strongly_bearish")
    return df.select("exchange", "date", "advances", "declines", "unchanged", r6("index_current").alias("index_current"), r6("index_percent_change").alias("index_percent_change"), x.alias("ad_ratio"), regime.alias("regime"))


