"""Stored bars: pruning, plans without exchange, upserts of touched months, compaction, failures; as-of joins."""

import bisect
import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.operators import scans
from candela.sources import store

DAY = datetime.date(2024, 1, 1)


def rows_of(days, tickers="ABCDEFGH", close=1.0):
    return [(t, DAY + datetime.timedelta(days=i), close, i) for t in tickers for i in days]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double, total_volume long")


@pytest.fixture
def table(spark, tmp_path):
    name = f"bars_{random.randrange(1 << 40)}"
    store.create(frame(spark, rows_of(range(0, 180, 3))), name, 4, f"file://{tmp_path}/{name}")
    yield name, f"{tmp_path}/{name}"
    spark.sql(f"DROP TABLE {name}")


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/month=*/*.parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_files_and_windows_need_no_exchange(spark, table):
    name, _ = table
    some = store.read(spark, name, "2024-02-10", "2024-03-05", ["C"])
    shown = plan(some.withColumn("m", F.avg("close").over(Window.partitionBy("ticker").orderBy("date"))))
    assert "Exchange" not in shown and "SelectedBucketsCount: 1 out of 4" in shown and "InMemoryFileIndex(2 paths)" in shown
    assert some.count() == sum(DAY.replace(month=2, day=10) <= d <= DAY.replace(month=3, day=5) for _, d, _, _ in rows_of(range(0, 180, 3), "C"))
    assert "Exchange" not in plan(store.read(spark, name).groupBy("ticker").agg(F.max("date")))


def test_an_upsert_rewrites_its_months_only(spark, table):
    name, path = table
    before = files(path)
    new = spark.createDataFrame([("A", datetime.date(2024, 3, 1), 5.0, 7, 1), ("A", datetime.date(2024, 3, 1), 6.0, 8, 2), ("Z", datetime.date(2024, 3, 2), 9.0, 9, 1)], "ticker string, date date, close double, total_volume long, seq long")
    assert store.upsert(new, name) == ["2024-03"]
    after = files(path)
    assert {p for p in before if "2024-03" not in p} == {p for p in after if "2024-03" not in p} and all(after[p] == before[p] for p in before if "2024-03" not in p)
    assert not {p for p in before if "2024-03" in p} & set(after)
    got = {(r.ticker, r.date): (r.close, r.total_volume) for r in store.read(spark, name).collect()}
    want = {(t, d): (c, v) for t, d, c, v in rows_of(range(0, 180, 3))} | {("A", datetime.date(2024, 3, 1)): (6.0, 8), ("Z", datetime.date(2024, 3, 2)): (9.0, 9)}
    assert got == want
    assert store.upsert(new, name) == ["2024-03"] and {(r.ticker, r.date): (r.close, r.total_volume) for r in store.read(spark, name).collect()} == want
    assert store.upsert(new.limit(0), name) == []


def test_appends_are_merged_by_compaction(spark, table):
    name, path = table
    before = files(path)
    for close in (3.0, 4.0):
        store.append(frame(spark, rows_of([3, 6, 40], "AB", close)), name)
    assert set(before) <= set(files(path)), "stored files stay"
    want = {(t, d): c for t, d, c, _ in rows_of(range(0, 180, 3))} | {(t, d): c for t, d, c, _ in rows_of([3, 6, 40], "AB", 4.0)}
    view = lambda: {(r.ticker, r.date): r.close for r in store.read(spark, name).collect()}
    assert view() == want and spark.table(name).count() > len(want)
    assert store.compact(spark, name) == ["2024-01", "2024-02"] and view() == want and spark.table(name).count() == len(want)
    assert store.compact(spark, name) == []


def test_a_failed_upsert_leaves_the_table(spark, table):
    name, path = table
    before = files(path)
    new = frame(spark, rows_of([2, 60])).withColumn("close", F.when(F.col("total_volume") == 60, F.raise_error(F.lit("lost"))).otherwise(F.lit(2.0)))
    with pytest.raises(Exception, match="lost"):
        store.upsert(new, name)
    assert files(path) == before and store.read(spark, name).count() == 8 * 60
    with pytest.raises(ValueError):
        store.upsert(frame(spark, [(None, DAY, 1.0, 1)]), name)


def test_as_of_join_with_gaps_ties_and_early_dates(spark):
    rng = random.Random(2)
    bars = [(t, DAY + datetime.timedelta(days=i), float(i), i) for t, days in (("A", range(50, 900, 7)), ("B", range(1000, 1400, 90)), ("C", [0])) for i in days]
    left = [(t, DAY + datetime.timedelta(days=rng.randrange(1800)), k) for k, t in enumerate("AABBCD" * 60)] + [("A", DAY + datetime.timedelta(days=50), 999)] * 2
    got = scans.as_of_join(spark.createDataFrame(left, "ticker string, date date, k long"), frame(spark, bars), "close")
    by = {t: sorted(b[1:3] for b in bars if b[0] == t) for t in "ABCD"}

    def newest(t, d):
        i = bisect.bisect_right([x for x, _ in by[t]], d)
        return by[t][i - 1] if i else (None, None)

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((t, d, k, *newest(t, d)) for t, d, k in left), key=repr)
    assert got.columns == ["ticker", "date", "k", "bar_date", "close"]
