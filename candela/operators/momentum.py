"""Momentum: RSI, z-score, percentiles, streaks, stochastic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.exprs import TICKER, W, cases, full, full_avg, lag, latest, r6, ratio


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Latest Wilder RSI and its zone; null below n + 1 rows."""
    s = folds.series(bars, c="close").select("ticker", "date", F.size("c").cast("bigint").alias("available"), folds.rsi(F.col("c"), n).alias("v"))
    v = F.col("v")
    return s.select("ticker", "date", "available", F.lit(n + 1).cast("bigint").alias("required"), r6("v").alias("rsi"), cases((v.isNull(), None), (v >= 70, "overbought"), (v <= 30, "oversold"), otherwise="neutral").alias("zone"))


def z_score(bars: DataFrame, n: int = 20) -> DataFrame:
    """Latest return against the last n returns, itself included; 0 where they do not vary."""
    df = bars.withColumn("ret", ratio(F.col("close") - lag("close"), lag("close"))).withColumn("rows", F.count(F.lit(1)).over(TICKER()))
    spread = full(F.stddev_samp, "ret", n)
    df = latest(df.withColumn("m", full_avg("ret", n)).withColumn("s", spread))
    z = F.when(F.col("rows") >= n + 2, F.when(F.col("s") > 1e-15, (F.col("ret") - F.col("m")) / F.col("s")).otherwise(0.0))
    df = df.select("ticker", "date", r6(z).alias("z_score"))
    v = F.col("z_score")
    return df.withColumn("flag", cases((v.isNull(), None), (v >= 2, "extreme_high"), (v >= 1.5, "elevated"), (v <= -2, "extreme_low"), (v <= -1.5, "depressed"), otherwise="normal"))


def percentile(n: int):
    """Place of the close between the lowest and highest of the last n; 0.5 where they are equal."""
    low, high = full(F.min, "close", n), full(F.max, "close", n)
    return F.when(high.isNotNull(), F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5))


def close_percentile(bars: DataFrame, n: int = 20) -> DataFrame:
    df = latest(bars.select("ticker", "date", percentile(n).alias("p")))
    p = F.col("p")
    return df.select("ticker", "date", r6("p").alias("percentile"), cases((p.isNull(), None), (p >= 0.8, "near_high"), (p <= 0.2, "near_low"), otherwise="middle").alias("zone"))


def close_percentile_by_window(bars: DataFrame, windows=(20, 60, 126)) -> DataFrame:
    return latest(bars.select("ticker", "date", *[r6(percentile(n)).alias(f"percentile_{n}") for n in windows]))


def return_streak(bars: DataFrame) -> DataFrame:
    """Signed length of the run of same-sign changes at the end: gaps and islands."""
    df = bars.withColumn("sign", F.signum(F.col("close") - lag("close"))).where("sign IS NOT NULL")
    df = df.withColumn("new", F.when(F.col("sign") == F.lag("sign").over(W()), 0).otherwise(1)).withColumn("island", F.sum("new").over(W())).withColumn("last", F.max("island").over(TICKER()))
    g = df.where("island = last").groupBy("ticker").agg(F.max("date").alias("date"), (F.count(F.lit(1)) * F.first("sign").cast("bigint")).alias("streak"))
    n = F.abs("streak")
    return g.select("ticker", "date", "streak", cases((n >= 5, "extended"), (n >= 3, "notable"), otherwise="normal").alias("flag"))


def stochastic(bars: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """%K over k rows (50 where flat) and %D, its mean over d, with the crossover of the last two rows."""
    low, high = full(F.min, "low", k), full(F.max, "high", k)
    df = bars.select("ticker", "date", F.when(high.isNotNull() & low.isNotNull(), F.when(high > low, (F.col("close") - low) / (high - low) * 100).otherwise(50.0)).alias("k"))
    df = df.withColumn("d", full_avg("k", d)).withColumn("pk", lag("k")).withColumn("pd", lag("d"))
    df = latest(df)
    a, b, pa, pb = F.col("k"), F.col("d"), F.col("pk"), F.col("pd")
    cross = cases(((pa <= pb) & (a > b), "bullish_crossover"), ((pa >= pb) & (a < b), "bearish_crossover"))
    zone = cases((b.isNull(), None), (a > 80, "overbought"), (a < 20, "oversold"), otherwise="neutral")
    return df.select("ticker", "date", r6(F.when(b.isNotNull(), a)).alias("k"), r6("d").alias("d"), zone.alias("zone"), cross.alias("crossover"))


