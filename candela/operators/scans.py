"""Scans of the stored tables: ranges, newest rows, as-of, points, counts, fallbacks, universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import lag, recent


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def scan_range(bars: DataFrame, start: str | None, end: str | None, ticker: str | None = None) -> DataFrame:
    """Rows with start <= date <= end (None: open), of one ticker or all; the filter reaches the scan of a stored table."""
    df = bars
    if start is not None:
        df = df.where(F.col("date") >= day(start))
    if end is not None:
        df = df.where(F.col("date") <= day(end))
    return df if ticker is None else df.where(F.col("ticker") == ticker.upper())


def scan_recent(bars: DataFrame, n: int) -> DataFrame:
    return recent(bars, n) if n > 0 else bars.limit(0)


def scan_as_of(bars: DataFrame, as_of: str, n: int) -> DataFrame:
    """The newest n rows up to a date, with the effective date and whether the date itself traded."""
    df = recent(bars.where(F.col("date") <= day(as_of)), n)
    effective = F.max("date").over(Window.partitionBy("ticker"))
    return df.withColumn("effective_date", effective).withColumn("is_trading_day", F.col("effective_date") == day(as_of))


def as_of_join(left: DataFrame, bars: DataFrame, *columns: str) -> DataFrame:
    """Each row of ``left`` (ticker, date, ..) with bar_date and the columns of its ticker's newest bar up to its date; null before the first.

    Both sides are merged in one sort by (ticker, year, date), bars before rows of ``left`` of their date, and the newest
    bar is carried along. A year begins with what the years before it left, one bar a ticker and year, so that a ticker with
    very many rows is split by its years. Bars of a ticker have different dates; rows of ``left`` may repeat.
    """
    bar = F.struct(F.col("date").alias("bar_date"), *columns)
    rest = [c for c in left.columns if c not in ("ticker", "date")]
    mine = left.select("ticker", "date", F.lit(1).alias("side"), F.lit(None).alias("bar"), F.struct("date", *rest).alias("row"))
    theirs = bars.select("ticker", "date", F.lit(0).alias("side"), bar.alias("bar"), F.lit(None).alias("row"))
    both = theirs.unionByName(mine).withColumn("year", F.year("date"))
    inside = Window.partitionBy("ticker", "year").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    years = both.where("side = 0").groupBy("ticker", "year").agg(F.max_by("bar", "date").alias("last")).unionByName(both.where("side = 1").select("ticker", "year", F.lit(None).alias("last")).distinct())
    years = years.groupBy("ticker", "year").agg(F.max("last").alias("last"))
    before = Window.partitionBy("ticker").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("ticker", "year", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = both.withColumn("own", F.last("bar", ignorenulls=True).over(inside)).where("side = 1").join(years, ["ticker", "year"])
    found = found.withColumn("bar", F.coalesce("own", "carried"))
    return found.select("ticker", "row.*", *[F.col(f"bar.{c}").alias(c) for c in ("bar_date", *columns)])


def list_tickers(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()


def row_count(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


def date_bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def recent_hours(hours: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("ticker").orderBy(F.desc("datetime"))
    return hours.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n).drop("k")


def hourly_range(hours: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """A bound of ten characters means the start or the end of that day; None: open."""
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    if start is not None:
        hours = hours.where(F.col("datetime") >= stamp(f"{start} 00:00:00" if len(start) == 10 else start))
    if end is not None:
        hours = hours.where(F.col("datetime") <= stamp(f"{end} 23:59:59" if len(end) == 10 else end))
    return hours


def hourly_point(hours: DataFrame, ticker: str, at: str) -> DataFrame:
    return hours.where((F.col("ticker") == ticker) & (F.col("datetime") == F.lit(at).cast("timestamp_ntz")))


def price_fallback(bars: DataFrame, start: str | None, end: str | None, n: int) -> DataFrame:
    """Rows of the range; a ticker that has none there gives its newest n rows instead, and says so."""
    inside = scan_range(bars, start, end)
    missing = bars.select("ticker").distinct().join(inside.select("ticker").distinct(), "ticker", "left_anti")
    rest = recent(bars.join(missing, "ticker", "left_semi"), n)
    return inside.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


def hourly_as_daily(hours: DataFrame) -> DataFrame:
    """Hourly bars in the daily shape: previous close from the bar before (or the own open), zero flows."""
    w = Window.partitionBy("ticker").orderBy("datetime")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("total_trade", "buy_count", "sell_count", "buy_volume", "sell_volume", "foreign_buy_volume", "foreign_sell_volume", "foreign_room")]
    return hours.select("ticker", "datetime", F.coalesce(F.lag("close").over(w), F.col("open")).alias("prev_close"), "open", "high", "low", "close", F.col("value").alias("total_value"), F.col("volume").alias("total_volume"), *zero)


def universe_filter(bars: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted tickers that are stored, in the order asked for; if none is, all stored ones."""
    ask = bars.sparkSession.createDataFrame([(t.upper(), i) for i, t in enumerate(wanted)], "ticker string, pos bigint")
    stored = list_tickers(bars)
    hit = ask.join(stored, "ticker", "left_semi").withColumn("is_fallback", F.lit(False))
    n_hit = F.broadcast(hit.agg(F.count(F.lit(1)).alias("hits")))  # one row
    every = stored.withColumn("pos", F.row_number().over(Window.orderBy("ticker")).cast("bigint") - 1).withColumn("is_fallback", F.lit(True))
    return hit.unionByName(every.join(n_hit, F.col("hits") == 0).drop("hits"))


def upsert(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The stored rows with those of ``new`` in their place; of several new rows of a key the one of the highest ``seq`` wins."""
    both = stored.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "seq")


def derived_frame(bars: DataFrame) -> DataFrame:
    """Net flows, sizes per trade and the room's daily change."""
    div = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return bars.select(
        "ticker", "date", (F.col("buy_volume") - F.col("sell_volume")).alias("net_volume"), (F.col("buy_count") - F.col("sell_count")).alias("net_count"),
        F.round(div("buy_volume", "buy_count"), 6).alias("avg_buy_size"), F.round(div("sell_volume", "sell_count"), 6).alias("avg_sell_size"), F.round(div("total_value", "total_trade"), 6).alias("avg_trade_value"),
        (F.col("foreign_buy_volume") - F.col("foreign_sell_volume")).alias("foreign_net_volume"), F.round(F.col("foreign_buy_value") - F.col("foreign_sell_value"), 2).alias("foreign_net_value"),
        (F.col("foreign_buy_volume") + F.col("foreign_sell_volume")).alias("foreign_total_volume"), (F.col("foreign_room") - lag("foreign_room")).alias("room_change"),
    )
