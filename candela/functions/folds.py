"""Order recurrences as folds over a ticker's sorted array; the lookback bounds the array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def series(df: DataFrame, **values: str) -> DataFrame:
    """One row per ticker: the last date and an array in date order for each named expression."""
    packed = F.struct("date", *[F.expr(e).alias(k) for k, e in values.items()])
    return df.groupBy("ticker").agg(F.max("date").alias("date"), F.array_sort(F.collect_list(packed)).alias("s")).select("ticker", "date", *[F.col("s")[k].alias(k) for k in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def rest(a: Column, n: int) -> Column:
    """What follows the first n elements."""
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def ema(a: Column, n: int) -> Column:
    """Last value of the exponential mean with alpha 2 / (n + 1), seeded by the mean of the first n values."""
    k = 2.0 / (n + 1)
    return F.when(F.size(a) >= n, F.aggregate(rest(a, n), total(F.slice(a, 1, n)) / n, lambda s, x: x * k + s * (1 - k)))


def ema_series(a: Column, n: int) -> Column:
    """All values of the mean, the first one for the n-th element."""
    k = 2.0 / (n + 1)
    seed = F.array(total(F.slice(a, 1, n)) / n)
    return F.when(F.size(a) >= n, F.aggregate(rest(a, n), seed, lambda s, x: F.array_append(s, x * k + F.element_at(s, -1) * (1 - k))))


def macd(a: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(macd, signal, histogram, previous histogram); null below slow + signal - 1 values."""
    line = F.zip_with(rest(ema_series(a, fast), slow - fast), ema_series(a, slow), lambda x, y: x - y)
    k = 2.0 / (signal + 1)
    seed_signal = total(F.slice(line, 1, signal)) / signal
    state = lambda s, h, p: F.struct(s.alias("signal"), h.alias("hist"), p.alias("prev"))
    start = state(seed_signal, F.element_at(line, signal) - seed_signal, F.lit(None).cast("double"))
    step = lambda s, x: state(x * k + s["signal"] * (1 - k), x - (x * k + s["signal"] * (1 - k)), s["hist"])
    out = F.aggregate(rest(line, signal), start, step)
    whole = F.struct(F.element_at(line, -1).alias("macd"), out["signal"].alias("signal"), out["hist"].alias("hist"), out["prev"].alias("prev"))
    return F.when(F.size(a) >= slow + signal - 1, whole)


def wilder(a: Column, n: int) -> Column:
    """Last value of Wilder's smoothing, seeded by the mean of the first n values."""
    return F.when(F.size(a) >= n, F.aggregate(rest(a, n), total(F.slice(a, 1, n)) / n, lambda s, x: (s * (n - 1) + x) / n))


def changes(a: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(rest(a, 1), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def rsi(a: Column, n: int = 14) -> Column:
    """Wilder's RSI: 100 without losses, 50 without any move."""
    d = changes(a)
    gain = wilder(F.transform(d, lambda x: F.greatest(x, F.lit(0.0))), n)
    loss = wilder(F.transform(d, lambda x: F.greatest(-x, F.lit(0.0))), n)
    return F.when(F.size(a) > n, F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss))))
