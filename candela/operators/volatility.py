"""Volatility: Bollinger bands, realised volatility, true range, ATR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.exprs import TICKER, W, cases, full, full_avg, lag, latest, r6, ratio


def bands(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """middle, upper, lower, pct_b and bandwidth (percent) for each row, unrounded."""
    df = bars.select("ticker", "date", "close", full_avg("close", n).alias("middle"), full(F.stddev_pop, "close", n).alias("sd"))
    df = df.withColumn("upper", F.col("middle") + width * F.col("sd")).withColumn("lower", F.col("middle") - width * F.col("sd"))
    span = F.col("upper") - F.col("lower")
    return df.withColumn("pct_b", F.when(span > 1e-12, (F.col("close") - F.col("lower")) / span)).withColumn("width", span).withColumn("bandwidth", ratio(span, "middle") * 100)


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    return bands(bars, n, width).where("middle IS NOT NULL").select("ticker", "date", *[r6(c).alias(c) for c in ("middle", "upper", "lower", "pct_b", "bandwidth")])


def bollinger_position(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    p = F.col("pct_b")
    label = cases((F.col("middle").isNull(), None), (p.isNull(), "middle"), (p >= 1, "above_upper"), (p >= 0.8, "near_upper"), (p <= 0, "below_lower"), (p <= 0.2, "near_lower"), otherwise="inside_band")
    return latest(bands(bars, n, width)).select("ticker", "date", label.alias("position"))


def bollinger_squeeze(bars: DataFrame, n: int = 20, look: int = 20, share: float = 0.15) -> DataFrame:
    """Whether the latest bandwidth, upper - lower over the middle, is at most the 15 % quantile of the last 20 bandwidths."""
    w = W().rowsBetween(-(look - 1), 0)
    df = bands(bars, n).withColumn("width", ratio(F.col("upper") - F.col("lower"), "middle"))
    df = df.withColumn("cut", F.when(F.count("width").over(w) == look, F.percentile("width", F.lit(share)).over(w)))
    return latest(df).select("ticker", "date", r6("width").alias("width"), r6("cut").alias("quantile"), F.coalesce(F.col("width") <= F.col("cut"), F.lit(False)).alias("squeeze"))


def c2c_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Sample deviation of log returns in percent, daily and yearly; refused if any close of the ticker's rows is not positive."""
    bad = F.min("close").over(TICKER()) <= 0
    df = bars.select("ticker", "date", "close", F.when((F.col("close") > 0) & (lag("close") > 0), F.ln(F.col("close") / lag("close"))).alias("r"))
    df = latest(df.withColumn("bad", bad).withColumn("sd", full(F.stddev_samp, "r", n) * 100))
    sd = F.when(~F.col("bad"), F.col("sd"))
    return df.select("ticker", "date", r6(sd).alias("daily_pct"), r6(sd * F.sqrt(F.lit(252.0))).alias("annual_pct"), r6(sd * 2).alias("stop_pct"))


def true_range(bars: DataFrame) -> DataFrame:
    """Greatest of high - low and the distances of both to the previous close; null without high or low."""
    pc = F.coalesce("prev_close", lag("close"))
    tr = F.when(F.col("high").isNotNull() & F.col("low").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    return bars.select("ticker", "date", "close", tr.alias("true_range"))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean of the true range; insufficient once a range after the first is missing."""
    s = folds.series(true_range(bars), c="close", t="true_range")
    t = F.col("t")
    valid = F.when(F.exists(t, lambda x: x.isNull()), F.lit(None)).otherwise(folds.wilder(t, n))
    return s.select("ticker", "date", F.size(t).cast("bigint").alias("available"), valid.alias("a"), F.element_at("c", -1).alias("close")).select("ticker", "date", "available", r6("a").alias("atr"), r6(ratio("a", "close") * 100).alias("atr_pct"), r6(F.col("a") * 2).alias("stop"))
