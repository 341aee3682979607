"""Expressions over one ticker's ordered bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def W() -> WindowSpec:
    """All per-ticker windows use this very partitioning, so that they share one exchange."""
    return Window.partitionBy("ticker").orderBy("date")


def NEWEST() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(F.desc("date"))


def TICKER() -> WindowSpec:
    return Window.partitionBy("ticker")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frame(n: int) -> WindowSpec:
    """This row and the n - 1 before it."""
    return W().rowsBetween(-(n - 1), 0)


def full(agg, c: Column | str, n: int) -> Column:
    """``agg`` over the last n rows, null unless all n values are there."""
    return F.when(F.count(col(c)).over(frame(n)) == n, agg(col(c)).over(frame(n)))


def full_avg(c: Column | str, n: int) -> Column:
    return full(F.avg, c, n)


def prior_avg(c: Column | str, n: int) -> Column:
    """Mean of the n rows before this one, null unless all are there."""
    w = W().rowsBetween(-n, -1)
    return F.when(F.count(col(c)).over(w) == n, F.avg(col(c)).over(w))


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(col(c), n).over(W())


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct(now: Column | str, past: Column | str) -> Column:
    return ratio(col(now) - col(past), past) * 100


def latest(df: DataFrame) -> DataFrame:
    """The newest row of each ticker."""
    return df.withColumn("__k", F.row_number().over(NEWEST())).where("__k = 1").drop("__k")


def recent(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each ticker."""
    return df.withColumn("__k", F.row_number().over(NEWEST())).where(F.col("__k") <= n).drop("__k")


def r6(c: Column | str) -> Column:
    return F.round(col(c), 6)


def r2(c: Column | str) -> Column:
    return F.round(col(c), 2)


def cents(c: Column | str) -> Column:
    """Rounded half up to 2 places through a decimal, for thresholds on rounded values."""
    return F.round(col(c).cast("decimal(28,8)"), 2).cast("double")


def cases(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out.otherwise(otherwise)
