"""Trend: moving averages, MACD, returns, crossovers, candles. Input: BARS_1D of any number of tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.exprs import W, cases, full_avg, lag, latest, pct, r6

SMA_WINDOWS = (5, 10, 20, 50, 100, 200)
EMA_WINDOWS = (12, 20, 26, 50, 200)
RETURN_WINDOWS = (5, 20, 60, 120, 250)
CROSS_PAIRS = ((20, 50), (50, 200))


def sma(bars: DataFrame, windows=SMA_WINDOWS) -> DataFrame:
    """Means of the last n closes, for each row."""
    return bars.select("ticker", "date", *[r6(full_avg("close", n)).alias(f"sma_{n}") for n in windows])


def sma_direction(bars: DataFrame, windows=SMA_WINDOWS) -> DataFrame:
    """Whether the latest mean lies more than 0.1 % above or below the one min(5, rows - n) rows ago."""
    df = bars.withColumn("available", F.count(F.lit(1)).over(W()))
    for n in windows:
        df = df.withColumn(f"m{n}", full_avg("close", n))
    for n in windows:
        now, back = F.col(f"m{n}"), F.least(F.lit(5), F.col("available") - n)
        past = F.coalesce(*[F.when(back == k, lag(f"m{n}", k)) for k in range(1, 6)])
        df = df.withColumn(f"direction_{n}", cases((past.isNull() | now.isNull(), "unknown"), (now > past * 1.001, "rising"), (now < past * 0.999, "falling"), otherwise="flat"))
    return latest(df).select("ticker", "date", "available", *[f"direction_{n}" for n in windows])


def ema(bars: DataFrame, windows=EMA_WINDOWS) -> DataFrame:
    s = folds.series(bars, c="close")
    return s.select("ticker", "date", *[r6(folds.ema(F.col("c"), n)).alias(f"ema_{n}") for n in windows])


def moving_averages(bars: DataFrame) -> DataFrame:
    """One row per ticker: latest close, sma_n, ema_n, unrounded."""
    last = latest(bars.select("ticker", "date", "close", *[full_avg("close", n).alias(f"sma_{n}") for n in SMA_WINDOWS]))
    s = folds.series(bars, c="close").select("ticker", *[folds.ema(F.col("c"), n).alias(f"ema_{n}") for n in EMA_WINDOWS])
    return last.join(s, "ticker")


def ma_distance(bars: DataFrame) -> DataFrame:
    """Percent from each mean to the close; null unless the mean is positive."""
    names = [f"sma_{n}" for n in SMA_WINDOWS] + [f"ema_{n}" for n in EMA_WINDOWS]
    return moving_averages(bars).select("ticker", "date", *[r6(F.when(F.col(m) > 0, pct("close", m))).alias(f"dist_{m}") for m in names])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    s = folds.series(bars, c="close").select("ticker", "date", F.size("c").cast("bigint").alias("available"), folds.macd(F.col("c"), fast, slow, signal).alias("m"))
    return s.select("ticker", "date", "available", F.lit(slow + signal - 1).cast("bigint").alias("required"), r6("m.macd").alias("macd"), r6("m.signal").alias("signal"), r6("m.hist").alias("histogram"))


def macd_crossover(bars: DataFrame) -> DataFrame:
    """Sign change of the histogram over the last two rows."""
    s = folds.series(bars, c="close").select("ticker", "date", folds.macd(F.col("c")).alias("m"))
    p, h = F.col("m.prev"), F.col("m.hist")
    return s.select("ticker", "date", cases((p.isNull() | h.isNull(), "unknown"), ((p <= 0) & (h > 0), "bullish_cross"), ((p >= 0) & (h < 0), "bearish_cross"), otherwise="none").alias("crossover"))


def returns_by_window(bars: DataFrame, windows=RETURN_WINDOWS) -> DataFrame:
    return latest(bars.select("ticker", "date", *[r6(pct("close", lag("close", n))).alias(f"return_{n}") for n in windows]))


def sma_crossover(bars: DataFrame, pairs=CROSS_PAIRS) -> DataFrame:
    """For each pair the last date on which the fast mean went above (golden) or not above (death) the slow one; none below slow + 2 rows."""
    df = bars
    for n in sorted({x for p in pairs for x in p}):
        df = df.withColumn(f"m{n}", full_avg("close", n))
    parts = []
    for fast, slow in pairs:
        above = F.when(F.col(f"m{slow}").isNotNull(), F.col(f"m{fast}") > F.col(f"m{slow}"))
        x = df.select("ticker", "date", above.alias("above")).withColumn("was", F.lag("above").over(W()))
        flip = F.when(F.col("above") != F.col("was"), F.struct("date", "above"))
        g = x.groupBy("ticker").agg(F.when(F.count(F.lit(1)) >= slow + 2, F.max(flip)).alias("f"))
        kind = cases((F.col("f").isNull(), "none"), (F.col("f.above"), "golden_cross"), otherwise="death_cross")
        parts.append(g.select("ticker", F.lit(fast).cast("bigint").alias("fast"), F.lit(slow).cast("bigint").alias("slow"), kind.alias("crossover"), F.col("f.date").alias("date")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candlestick(bars: DataFrame) -> DataFrame:
    """Shape of the latest candle; the first rule that holds names the pattern."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - low
    share = lambda x: F.when(span > 0, F.round((x / span).cast("decimal(28,8)"), 4).cast("double")).otherwise(0.0)
    df = latest(bars).where("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL")
    df = df.select("ticker", "date", o, c, span.alias("span"), share(F.abs(c - o)).alias("body_ratio"), share(F.greatest(h - F.greatest(o, c), F.lit(0.0))).alias("upper_ratio"), share(F.greatest(F.least(o, c) - low, F.lit(0.0))).alias("lower_ratio"), r6(F.when(F.col("prev_close") > 0, pct("open", "prev_close"))).alias("gap_pct"))
    b, u, d = F.col("body_ratio"), F.col("upper_ratio"), F.col("lower_ratio")
    small = (b > 0.10) & (b <= 0.35)
    pattern = cases(
        ((F.col("span") == 0) | (b <= 0.10), "doji"),
        ((c > o) & (b >= 0.85), "bullish_marubozu"),
        ((c < o) & (b >= 0.85), "bearish_marubozu"),
        ((d >= 0.55) & (u <= 0.15) & small, "hammer"),
        ((u >= 0.55) & (d <= 0.15) & small, "shooting_star"),
        otherwise="standard",
    )
    return df.select("ticker", "date", "body_ratio", "upper_ratio", "lower_ratio", "gap_pct", pattern.alias("pattern"))


def trend_alignment(bars: DataFrame) -> DataFrame:
    """Order of close, SMA20, SMA50 and SMA200."""
    c, a, b, d = F.col("close"), F.col("m20"), F.col("m50"), F.col("m200")
    last = latest(bars.select("ticker", "date", "close", *[full_avg("close", n).alias(f"m{n}") for n in (20, 50, 200)]))
    label = cases(
        (a.isNull() | b.isNull(), None),
        ((c > a) & (a > b) & (b > d), "aligned_uptrend"),
        ((c < a) & (a < b) & (b < d), "aligned_downtrend"),
        (c > d, "above_sma200_transitional"),
        (d.isNotNull(), "below_sma200_transitional"),
        ((c > a) & (a > b), "short_term_uptrend"),
        ((c < a) & (a < b), "short_term_downtrend"),
        otherwise="transitional",
    )
    return last.select("ticker", "date", label.alias("alignment"))
