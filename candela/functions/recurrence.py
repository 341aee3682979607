"""Recurrences s = a * s' + b over a ticker's ordered rows as an associative scan, in window and aggregate expressions.

The rows of a ticker are cut into blocks: calendar years of their date, and in a year parts of ``PART`` rows. Applying a block
to a state is an affine map, and so is applying several: a block of m rows is (a ** m, its own result from zero).

* Inside a block the result from zero is a running sum: sum(b * a ** -p) * a ** p at place p.
* The state that enters a block is a fold over the blocks before it; blocks further back than a ** rows can be told from zero
  in a double do not count, so the fold is over a bounded number of them.
* A row's state is its block's own result plus a ** (p + 1) times the entering state.

So no task holds more of a ticker than the rows of one year, and one row for each of its blocks. The seed, a mean of
the first n values, is the b of row n; rows before it have b = 0 and no result.

Dates of a ticker must differ (as upserted bars have it). A null value ends its ticker's series: it and all later rows are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block at most: a ** -PART stays a double for a >= 1/3, as n >= 2 has it.
PART = 256
BLOCK = ["ticker", "year", "part"]


def numbered(df: DataFrame, *values: str) -> DataFrame:
    """(ticker, date, *values) with year, part, p (place in the part) and i (place in the ticker, from 0)."""
    year = Window.partitionBy("ticker", "year").orderBy("date")
    df = df.select("ticker", "date", F.year("date").alias("year"), *values).withColumn("at", F.row_number().over(year) - 1)
    before = Window.partitionBy("ticker").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = df.groupBy("ticker", "year").agg(F.count(F.lit(1)).alias("rows"))
    years = years.select("ticker", "year", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    df = df.join(years, ["ticker", "year"])
    return df.select("ticker", "date", "year", F.floor(F.col("at") / PART).alias("part"), (F.col("at") % PART).alias("p"), (F.col("at") + F.col("earlier")).alias("i"), *values)


def previous(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` (numbered) with the value of the ticker's row before, across years without gathering the ticker."""
    year, years = Window.partitionBy("ticker", "year").orderBy("date"), Window.partitionBy("ticker").orderBy("year")
    last = df.groupBy("ticker", "year").agg(F.max_by(value, "date").alias("last"))
    last = last.select("ticker", "year", F.lag("last").over(years).alias("carried"))
    first = F.row_number().over(year) == 1
    return df.withColumn("first", first).withColumn(name, F.lag(value).over(year)).join(last, ["ticker", "year"]).withColumn(name, F.when(F.col("first"), F.col("carried")).otherwise(F.col(name))).drop("first", "carried")


def smoothed(df: DataFrame, start: int = 0, **means: tuple[str, int, float]) -> DataFrame:
    """``df`` (numbered) with a column for each mean name=(value, n, alpha): s = alpha * x + (1 - alpha) * s'.

    The value's rows count from place ``start`` on; the seed is the mean of its first n values, at place start + n - 1.
    """
    seeds = df.where((F.col("i") >= start) & (F.col("i") < start + max(n for _, n, _ in means.values()))).groupBy("ticker").agg(
        *[F.avg(F.when(F.col("i") < start + n, F.col(v))).alias(f"{k}_seed") for k, (v, n, _) in means.items()],
    )
    gaps = df.where(F.col("i") >= start).groupBy("ticker").agg(*[F.min(F.when(F.col(v).isNull(), F.col("i"))).alias(f"{k}_gap") for k, (v, _, _) in means.items()])
    df = df.join(seeds, "ticker", "left").join(gaps, "ticker", "left")
    inside = Window.partitionBy(*BLOCK).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    for k, (v, n, alpha) in means.items():
        a, seed = 1 - alpha, start + n - 1
        b = F.when(F.col("i") < seed, 0.0).when(F.col("i") == seed, F.col(f"{k}_seed")).otherwise(F.coalesce(F.col(v), F.lit(0.0)) * alpha)
        if a == 0:
            df = df.withColumn(f"{k}_own", b)
        else:
            df = df.withColumn(f"{k}_own", F.sum(b * F.pow(F.lit(a), -F.col("p"))).over(inside) * F.pow(F.lit(a), F.col("p")))
    blocks = df.groupBy(*BLOCK).agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("rows"), *[F.max_by(f"{k}_own", "p").alias(f"{k}_own") for k in means])
    for k, (_, _, alpha) in means.items():
        blocks = blocks.withColumn(f"{k}_in", _entering(k, 1 - alpha))
    df = df.join(blocks.select(*BLOCK, *[f"{k}_in" for k in means]), BLOCK)
    for k, (_, n, alpha) in means.items():
        there = (F.col("i") >= start + n - 1) & (F.col(f"{k}_gap").isNull() | (F.col("i") < F.col(f"{k}_gap")))
        df = df.withColumn(k, F.when(there, F.col(f"{k}_own") + F.pow(F.lit(1 - alpha), F.col("p") + 1) * F.col(f"{k}_in")))
    return df.drop(*[f"{k}_{x}" for k in means for x in ("own", "in", "seed", "gap")])


def _entering(k: str, a: float) -> Column:
    """The state before a block: the blocks that can still be told from zero (a ** rows is a double), folded in order."""
    reach = PART if a == 0 else math.ceil(-745 / math.log(a)) + PART
    earlier = Window.partitionBy("ticker").orderBy("first").rangeBetween(-reach, -1)
    item = F.struct("rows", F.col(f"{k}_own").alias("own"))
    return F.aggregate(F.collect_list(item).over(earlier), F.lit(0.0), lambda s, x: s * F.pow(F.lit(a), x["rows"]) + x["own"])


def exponential(n: int) -> float:
    return 2.0 / (n + 1)


def ema_series(bars: DataFrame, windows: tuple[int, ...] = (12, 26)) -> DataFrame:
    """(ticker, date, ema_n..): the exponential mean of each row's close, null on the first n - 1 rows."""
    df = smoothed(numbered(bars, "close"), **{f"ema_{n}": ("close", n, exponential(n)) for n in windows})
    return df.select("ticker", "date", *[f"ema_{n}" for n in windows])


def macd_series(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(ticker, date, macd, signal, histogram) of each row; the line from row slow on, the others from slow + signal - 1 on."""
    if fast >= slow:
        raise ValueError("fast must be shorter than slow")
    df = smoothed(numbered(bars, "close"), fast=("close", fast, exponential(fast)), slow=("close", slow, exponential(slow)))
    df = smoothed(df.withColumn("macd", F.col("fast") - F.col("slow")), slow - 1, signal=("macd", signal, exponential(signal)))
    return df.select("ticker", "date", "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram"))


def rsi_series(bars: DataFrame, n: int = 14) -> DataFrame:
    """(ticker, date, rsi) of each row, from row n + 1 on: 100 without losses, 50 without any move."""
    df = previous(numbered(bars, "close"), "close", "before")
    df = df.withColumn("up", F.greatest(F.col("close") - F.col("before"), F.lit(0.0))).withColumn("down", F.greatest(F.col("before") - F.col("close"), F.lit(0.0)))
    df = smoothed(df, 1, gain=("up", n, 1.0 / n), loss=("down", n, 1.0 / n))
    value = F.when(F.col("loss") == 0, F.when(F.col("gain") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    return df.select("ticker", "date", F.when(F.col("gain").isNotNull(), value).alias("rsi"))


def atr_series(bars: DataFrame, n: int = 14) -> DataFrame:
    """(ticker, date, true_range, atr, atr_pct) of each row, Wilder's mean from row n on; it ends where a range is missing."""
    df = previous(numbered(bars, "close", "high", "low", "prev_close"), "close", "before")
    past = F.coalesce("prev_close", "before")
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - past), F.abs(F.col("low") - past))
    df = smoothed(df.withColumn("true_range", F.when(F.col("high").isNotNull() & F.col("low").isNotNull(), spread)), atr=("true_range", n, 1.0 / n))
    return df.select("ticker", "date", "true_range", "atr", (F.try_divide("atr", "close") * 100).alias("atr_pct"))
