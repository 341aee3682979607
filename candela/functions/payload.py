"""Results as JSON, one document for each ticker: what a caller outside of Spark gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import recent


def safe(c: Column, kind: str) -> Column:
    """Numbers that JSON has none for become null; dates become text."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return c.cast("string") if kind.startswith(("date", "timestamp")) else c


def scalars(df: DataFrame) -> DataFrame:
    """(ticker, json): the row of each ticker as an object; several rows of a ticker give several."""
    fields = [safe(F.col(c), kind).alias(c) for c, kind in df.dtypes]
    return df.select("ticker", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def series(df: DataFrame, tail: int = 20) -> DataFrame:
    """(ticker, json): for each value column the dates and values of the last ``tail`` rows, in date order."""
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if c not in ("ticker", "date")]
    g = recent(df, tail).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), *[safe(F.col(c), kinds[c]).alias(c) for c in names]))).alias("a"))
    return g.select("ticker", F.to_json(F.struct(*[F.struct(F.col("a.date").alias("dates"), F.col(f"a.{c}").alias("values")).alias(c) for c in names]), {"ignoreNullFields": "false"}).alias("json"))
