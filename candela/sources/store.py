"""Stored bars: a table partitioned by month, bucketed and sorted by ticker, with upserts that touch only the months they hold.

* A date filter prunes months, a ticker filter prunes buckets, and windows or groups by ticker need no exchange, as all rows of
  a ticker lie in one bucket, whatever the month.
* :func:`upsert` rewrites the months that the new rows fall into, by dynamic partition overwrite: files are written beside the
  table and moved in when all of them are there. A run that fails before that leaves the table as it was, and running it
  again gives the same rows; other months' files are not read or touched.
* :func:`append` only adds rows with a number of their run (cheap, for streams); reads take the newest row of each key, and
  :func:`compact` merges the months in which there is more than one run.

Two upserts or compactions of one month at once are not kept apart: run one at a time, as one ingest job does.

Of several new rows of a key the one of the highest ``seq`` wins. Rows without ticker or date are refused, as a key needs both.
"""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("ticker", "date")
MONTH = "month"
#: Number of the run that wrote a row; later runs win.
RUN = "run"


def _months(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, F.date_format("date", "yyyy-MM"))


def create(bars: DataFrame, name: str, buckets: int = 32, path: str | None = None) -> None:
    """Store ``bars`` as table ``name``, in the warehouse or in a folder of its own."""
    rows = _months(_keyed(bars)).withColumn(RUN, F.lit(0).cast("bigint"))
    # a task a month and bucket group, so that a month has a file for each bucket at most
    writer = rows.repartition(MONTH, F.pmod(F.hash("ticker"), F.lit(buckets))).write.partitionBy(MONTH).bucketBy(buckets, "ticker").sortBy(*KEY)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def _keyed(df: DataFrame) -> DataFrame:
    bad = df.where("ticker IS NULL OR date IS NULL")
    if not bad.isEmpty():
        raise ValueError("rows without ticker or date")
    return df


def read(spark: SparkSession, name: str, start: str | None = None, end: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """The stored bars, the newest row of each key. The filters reach the partitions, the buckets and the files."""
    df = spark.table(name)
    if start is not None:
        df = df.where((F.col(MONTH) >= start[:7]) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col(MONTH) <= end[:7]) & (F.col("date") <= F.lit(end).cast("date")))
    if tickers is not None:
        df = df.where(F.col("ticker").isin(tickers))
    return _newest(df).drop(MONTH, RUN)


def _newest(df: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.desc(RUN))
    return df.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def _next_run(spark: SparkSession) -> int:
    """A number above those of all earlier runs, also of other processes: the time in nanoseconds."""
    return time.time_ns()


@contextmanager
def _overwriting_months(spark: SparkSession):
    key = "spark.sql.sources.partitionOverwriteMode"
    old = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _stored(rows: DataFrame, name: str, overwrite: bool) -> None:
    spark = rows.sparkSession
    columns = spark.table(name).columns
    buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Num Buckets"))
    dealt = rows.repartition(MONTH, F.pmod(F.hash("ticker"), F.lit(buckets))).select(*columns)
    with _overwriting_months(spark):
        dealt.write.insertInto(name, overwrite=overwrite)


def _last_of_new(new: DataFrame, run: int) -> DataFrame:
    """The row of the highest seq of each key, as rows of this run."""
    new = _keyed(new)
    if "seq" in new.columns:
        order = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
        new = new.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", "seq")
    return _months(new).withColumn(RUN, F.lit(run).cast("bigint"))


def _rewritten(spark: SparkSession, name: str, months: list[str], more: DataFrame | None = None) -> None:
    old = spark.table(name).where(F.col(MONTH).isin(months))
    rows = old if more is None else old.unionByName(more, allowMissingColumns=True)
    _stored(_newest(rows), name, overwrite=True)


def upsert(new: DataFrame, name: str) -> list[str]:
    """Put ``new`` in place of stored rows of its keys, or beside them; the months rewritten."""
    spark = new.sparkSession
    rows = _last_of_new(new, _next_run(spark))
    months = sorted(r[0] for r in rows.select(MONTH).distinct().collect())  # a month each
    if months:
        _rewritten(spark, name, months, rows)
    return months


def append(new: DataFrame, name: str) -> None:
    """Add the rows of ``new`` as a run of its own; no stored file is read or changed."""
    _stored(_last_of_new(new, _next_run(new.sparkSession)), name, overwrite=False)


def compact(spark: SparkSession, name: str) -> list[str]:
    """Merge the months that hold several runs' rows of a key; the months rewritten."""
    twice = spark.table(name).groupBy(MONTH, *KEY).count().where("count > 1")
    months = sorted(r[0] for r in twice.select(MONTH).distinct().collect())
    if months:
        _rewritten(spark, name, months)
    return months
