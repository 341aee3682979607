"""Ingest, feeds, sessions in batch and as a stream, and the request facade."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from candela import ingest_job
from candela.api import Engine, RequestError
from candela.functions import payload
from candela.operators import scans
from candela.plans import scoring
from candela.sources import feeds, ingest
from candela.sources.projections import bars_1d, index_1d, snapshots
from candela.streaming import sessions

RECORDS = [
    {"Symbol": "vnm", "Date": "02/01/2024", "PricePreviousClose": "68,500", "PriceClose": "68510", "TotalVolume": "500", "BuyQuantity": "300", "SellQuantity": "200"},
    {"Symbol": "VNM", "Date": "2024-01-03T00:00:00", "PricePreviousClose": "68510", "PriceClose": "-"},
    {"Symbol": "VNM", "Date": "2024-01-04", "PricePreviousClose": "NaN", "PriceClose": "1"},
    {"Symbol": "VNM", "Date": "02-01-2024", "PricePreviousClose": "68500", "PriceClose": "68600", "PriceOpen": "", "Open": "68400", "CurrentForeignRoom": "9,000,000.7"},
]


def daily(symbol):
    """A provider for the data source test."""
    return {"d": json.dumps({"Data": [[dict(RECORDS[0], Symbol=symbol)]]})}


def test_envelopes_are_opened():
    for wrapped in (RECORDS, {"Success": "true", "Data": RECORDS}, [[RECORDS]], {"d": json.dumps({"Data": RECORDS})}, json.dumps(RECORDS)):
        assert list(feeds.records(wrapped)) == RECORDS
    assert list(feeds.records({"Message": "none"})) == []


def test_ingest_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Data": RECORDS}))
    parsed = ingest.parse(feeds.read_envelopes(spark, str(tmp_path)))
    assert sorted((r.seq, r.reject_reason) for r in ingest.rejected(parsed).collect()) == [(1, "bad close"), (2, "bad prev_close")]
    row = ingest.dedupe_last(ingest.good(parsed), "ticker", "date").collect()
    assert len(row) == 1 and row[0].close == 68600 and row[0].open == 68400 and row[0].foreign_room == 9_000_000 and row[0].replaced == 1 and row[0].ticker == "VNM"
    assert ingest.summary(parsed).first().asDict() == {"records": 4, "parsed": 2, "rejected": 2, "written": 1, "tickers": "VNM"}


def test_xml_and_rest(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<Envelope><Body><HistoricalQuote><Symbol>A</Symbol><Close>5</Close></HistoricalQuote><HistoricalQuote><Symbol>B</Symbol><Close>6</Close></HistoricalQuote></Body></Envelope>")
    got = feeds.read_xml_items(spark, str(tmp_path / "x.xml"), "HistoricalQuote", "Symbol string, Close string").collect()
    assert {(r.Symbol, r.Close) for r in got} == {("A", "5"), ("B", "6")}
    (tmp_path / "f.xml").write_text("<Envelope><Body><Fault><faultcode>c</faultcode><faultstring>s</faultstring></Fault></Body></Envelope>")
    assert feeds.xml_faults(spark, str(tmp_path / "f.xml")).first().faultstring == "s"
    ok = json.dumps({"success": True, "data": [{"Symbol": "a", "Date": "2024-01-02", "Close": "1,5", "DealVolume": "7"}]})
    bodies = spark.createDataFrame([(ok,), (json.dumps({"success": False, "data": [{"Symbol": "b"}]}),)], "body string")
    r = feeds.rest_history(bodies).collect()
    assert len(r) == 1 and r[0].ticker == "A" and r[0].close == 15 and r[0].total_volume == 7
    market = spark.createDataFrame([(json.dumps({"success": True, "data": [{"Exchange": "HSX", "Date": "2024-01-02", "Advances": "3"}]}),)], "body string")
    assert feeds.rest_market(market).first().exchange == "VNINDEX"


def test_data_source(spark):
    spark.dataSource.register(feeds.FeedDataSource)
    df = spark.read.format("candela_feed").option("symbols", "AAA,BBB").option("provider", "tests.test_sources:daily").load()
    assert sorted(r.ticker for r in ingest.parse(df).collect()) == ["AAA", "BBB"]


def test_a_fault_fails_the_read(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<Envelope><Body><Quote><Symbol>A</Symbol></Quote></Body></Envelope>")
    assert [r.Symbol for r in feeds.soap_items(spark, str(tmp_path), "Quote", "Symbol string").collect()] == ["A"]
    (tmp_path / "f.xml").write_text("<Envelope><Body><Fault><faultcode>c</faultcode><faultstring> no such account </faultstring></Fault></Body></Envelope>")
    with pytest.raises(Exception, match="SOAP Fault: no such account"):
        feeds.soap_items(spark, str(tmp_path), "Quote", "Symbol string").collect()
    (tmp_path / "f.xml").write_text("<Envelope><Body><Fault><faultcode>c7</faultcode></Fault></Body></Envelope>")
    with pytest.raises(Exception, match="SOAP Fault: c7"):
        feeds.soap_items(spark, str(tmp_path), "Quote", "Symbol string").collect()


def test_filters_on_symbols_narrow_the_requests(spark):
    spark.dataSource.register(feeds.FeedDataSource)
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        df = spark.read.format("candela_feed").option("pushdown", "true").option("symbols", "AAA,BBB,CCC").option("provider", "tests.test_sources:daily").load()
        for condition, asked in (("Symbol = 'BBB'", 1), ("Symbol IN ('AAA', 'CCC', 'x')", 2), ("Symbol = 'x'", 0), ("PriceClose <> '1'", 3)):
            some = df.where(condition)
            assert some.count() == asked and some.rdd.getNumPartitions() == max(1, asked)
    finally:
        spark.conf.unset(key)


def counted(symbol):
    """A provider that never says the same twice."""
    import time

    return {"Data": [dict(RECORDS[0], Symbol=symbol, TotalVolume=str(time.time_ns()))]}


def test_landed_polls_are_replayed(spark, tmp_path):
    """Each response counts once, whatever restarts; a checkpoint that is behind reads the same responses again."""
    land, out, at = (str(tmp_path / x) for x in ("land", "out", "at"))
    polled = []
    for n in range(1, 4):
        feeds.land(spark, ["AAA", "BBB"], "tests.test_sources:counted", land)
        polled = sorted((r.Symbol, r.TotalVolume) for r in spark.read.parquet(land).collect())
        feeds.landed(spark, land).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(90)
        assert sorted((r.Symbol, r.TotalVolume) for r in spark.read.parquet(out).collect()) == polled and len(polled) == 2 * n
    again = str(tmp_path / "again")
    feeds.landed(spark, land).writeStream.format("parquet").option("path", again).option("checkpointLocation", f"{again}-at").trigger(availableNow=True).start().awaitTermination(90)
    assert sorted((r.Symbol, r.TotalVolume) for r in spark.read.parquet(again).collect()) == polled


def test_offsets_never_go_back():
    reader = feeds.FeedStreamReader({"symbols": "A", "provider": "x:y"})
    first = [reader.latestOffset()["at"] for _ in range(50)]
    after = feeds.FeedStreamReader({"symbols": "A", "provider": "x:y"})
    assert first == sorted(set(first)) and after.latestOffset()["at"] > first[-1] > reader.initialOffset()["at"]
    after.partitions({"at": 2**62}, {"at": 2**62 + 5})
    assert after.latestOffset()["at"] > 2**62 + 5


def test_stream_of_the_data_source(spark, tmp_path):
    spark.dataSource.register(feeds.FeedDataSource)
    stream = spark.readStream.format("candela_feed").option("symbols", "AAA,BBB").option("provider", "tests.test_sources:daily").load()
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(90)
    got = ingest.parse(spark.read.parquet(str(tmp_path / "out"))).groupBy("ticker").count().collect()
    assert {r.ticker for r in got} == {"AAA", "BBB"} and len({r["count"] for r in got}) == 1


def test_ingest_job(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"Data": RECORDS}))
    for _ in range(2):
        assert ingest_job.main(["--file", str(tmp_path / "a.json"), "--table", str(tmp_path / "t")], spark) == 0
    said = capsys.readouterr().out
    assert said.count("records 4, parsed 2, rejected 2, written 1, tickers VNM") == 2 and "rejected VNM 2024-01-03: bad close" in said
    assert ingest_job.main(["--symbols", "XXX", "--provider", "tests.test_sources:daily", "--table", str(tmp_path / "t")], spark) == 0
    rows = sessions.read_upserted(spark, str(tmp_path / "t"), "ticker", "date").collect()
    assert {(r.ticker, r.close) for r in rows} == {("VNM", 68600.0), ("XXX", 68510.0)}


def test_quotes_and_payloads(spark):
    body = json.dumps({"success": True, "data": [{"Symbol": "abc", "PriceBasic": "10,000", "PriceCurrent": "0", "PriceLast": "10500", "TotalVolume": "1,200", "PriceBid1": "10400", "QuantityBid1": "7"}, {"Symbol": "d", "PriceClose": "5"}]})
    a, d = feeds.rest_quotes(spark.createDataFrame([(body,)], "body string")).collect()
    assert (a.ticker, a.price_current, a.change, a.percent_change, a.accumulated_volume, a.bid_1.volume) == ("ABC", 10500.0, 500.0, 5.0, 1200, 7) and (d.price_current, d.change, d.price_open) == (5.0, 0.0, 0.0)
    df = spark.createDataFrame([("A", datetime.date(2024, 1, i), float("nan") if i == 3 else float(i)) for i in range(1, 5)], "ticker string, date date, x double")
    assert json.loads(payload.series(df, 2).first().json) == {"x": {"dates": ["2024-01-03", "2024-01-04"], "values": [None, 4.0]}}
    assert [json.loads(r.json) for r in payload.scalars(df.where("x = 4 OR isnan(x)")).collect()] == [{"ticker": "A", "date": "2024-01-03", "x": None}, {"ticker": "A", "date": "2024-01-04", "x": 4.0}]


def ticks(spark, times, acc=None):
    rows = [("T", datetime.datetime.fromisoformat(f"2024-01-02 {t}"), datetime.date(2024, 1, 2), float(i), (acc or range(1, 99))[i], float(i), i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "ticker string, timestamp timestamp_ntz, date date, price double, accumulated_volume long, accumulated_value double, event_id long")


def test_session_edges(spark):
    times = ["08:59:59", "09:00:00", "10:00:00", "11:30:00", "11:30:00.5", "11:30:01", "13:00:00", "14:00:00", "15:00:00", "15:00:01"]
    got = [r.s for r in ticks(spark, times).orderBy("event_id").select(sessions.session_of(F.col("timestamp")).alias("s")).collect()]
    assert got == [None, 1, 2, 2, None, None, 3, 4, 4, None]


def test_volume_never_goes_below_zero(spark):
    h = sessions.hourly_bars(ticks(spark, ["09:10:00", "10:10:00", "13:10:00", "14:10:00"], [100, 80, 130, 150])).orderBy("session_index").collect()
    assert [r.volume for r in h] == [100, 0, 30, 20] and [r.is_closed for r in h] == [True, True, True, False]


def test_stream_equals_batch(spark, data, tmp_path):
    s = snapshots(spark, f"{data}/sf0.001")
    s.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_session_bars(spark.readStream.schema(s.schema).parquet(str(tmp_path / "in")), "400 days")
    sessions.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sessions.read_upserted(spark, str(tmp_path / "out"), "ticker", "date", "session_index")
    key = lambda df: sorted((r.ticker, r.date, r.session_index, r.open, r.high, r.low, r.close, r.acc_volume) for r in df.collect())
    assert key(got) == key(sessions.session_bars(s)) and got.count() > 0


def test_timestamps(spark):
    rows = [("2024-01-02 09:15:00",), ("2024-01-02T09:15:00",), (" 2024/1/2 9:15:00 ",), ("2024-01-02 09:15",), ("2024-01-02",), ("02.01.2024",), ("2024-13-02 00:00:00",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(sessions.parse_timestamp(F.col("s")).alias("t")).collect()]
    nine = datetime.datetime(2024, 1, 2, 9, 15)
    assert got == [nine, nine, nine, nine, datetime.datetime(2024, 1, 2), None, None, None]


def test_counts_beyond_64_bits_are_rejected(spark):
    raw = spark.createDataFrame([(1, "A", "2024-01-02", "5", "5", "99999999999999999999"), (2, "A", "2024-01-02", "5", "5", "7")], "seq long, Symbol string, Date string, PricePreviousClose string, PriceClose string, TotalVolume string")
    assert [(r.seq, r.reject_reason, r.total_volume) for r in ingest.parse(raw).orderBy("seq").collect()] == [(1, "bad total_volume", 0), (2, None, 7)]
    assert raw.select(ingest.as_int(F.col("TotalVolume")).alias("x")).first().x == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "ticker string, date int, close double")
    new = spark.createDataFrame([("A", 1, 5.0, 1), ("A", 1, 6.0, 2), ("C", 1, 7.0, 1)], "ticker string, date int, close double, seq long")
    once = scans.upsert(old, new, "ticker", "date")
    assert {(r.ticker, r.close) for r in once.collect()} == {("A", 6.0), ("B", 2.0), ("C", 7.0)}
    assert sorted(scans.upsert(once, new, "ticker", "date").collect()) == sorted(once.collect())


def test_engine(spark, data, tmp_path):
    d = f"{data}/sf0.001"
    e = Engine(bars_1d(spark, d).cache(), index_1d(spark, d), sessions.hourly_bars(snapshots(spark, d)), audit=str(tmp_path / "audit"))
    two = ["Brand#1", "brand#2"]
    assert e.prices(two, lookback=5).count() == 10
    assert {r.fallback for r in e.prices(two, "2030-01-01", "2030-02-01", 3).collect()} == {True}
    assert e.indicators(["momentum"], two)["momentum.rsi"].count() == 2
    assert e.flow_summary(two).count() == 2
    report = e.multi_horizon(two, "mid_term")
    assert report["verdict"].count() == 2 and "stats_52w" not in report and set(e.multi_horizon(two, "levels")) == {"levels", "position"}
    assert e.weekly(two)["rsi"].count() == 2 and e.breadth().count() == 5 and e.breadth("asia").count() == 1
    assert e.compare(two)["stats_52w"].count() == 2
    assert e.screen(top_n=3).count() == 3 and e.screen("intraday_breakout", top_n=3).columns == ["rank", "ticker", "score", "change_pct"]
    assert e.foreign_scan(5, 2)["buyers"].count() <= 2
    old = e.prices(two, None, "1997-01-01")
    assert old.count() > 0 and not any(r.fallback for r in old.collect()) and old.agg(F.max("date")).first()[0] <= datetime.date(1997, 1, 1)
    assert e.prices(two, "1992-01-01", lookback=1).count() == e.bars.where("lower(ticker) IN ('brand#1', 'brand#2') AND date >= '1992-01-01'").count()
    assert e.prices(timeframe="1h", start="2024-01-03", end="2024-01-03").count() > 0 and e.prices(timeframe="1h", lookback=1).count() == e.hours.select("ticker").distinct().count()
    own = e.indicators(["trend", "momentum"], two, params={"rsi_window": 5, "ema_windows": [3], "sma_windows": [4]}, series_tail=2)
    assert own["trend.ema"].columns == ["ticker", "date", "ema_3"] and own["trend.series"].count() == 4 and own["trend.series"].columns[-1] == "sma_4" and "momentum.series" not in own
    assert own["momentum.rsi"].first().rsi != e.indicators(["momentum"], two)["momentum.rsi"].first().rsi
    assert report["perspectives"].count() == 2 and report["weekly_bars"].count() == 2
    more = e.multi_horizon(two, detail="full", series_tail=3)
    assert more["daily.trend.series"].count() == 6 and more["weekly.rsi"].count() == 2
    tie = scoring.screen_and_rank(e.bars.select("ticker", F.lit(5.0).alias("score")).distinct(), e.bars.withColumn("close", F.col("prev_close")), 3, spark.createDataFrame([("Brand#3", 0), ("Brand#1", 1), ("Brand#2", 2)], "ticker string, pos int"))
    assert [r.ticker for r in tie.orderBy("rank").collect()] == [t for t in ("Brand#3", "Brand#1", "Brand#2")]
    for call in (lambda: e.indicators(["trend"], params={"x": 1}), lambda: e.indicators(["trend"], params={"rsi_window": 0}), lambda: e.prices(timeframe="5m"), lambda: e.multi_horizon(detail="x"), lambda: e.indicators(["vwap"]), lambda: e.prices(["a b"]), lambda: e.compare(["Brand#1"]), lambda: e.screen("x"), lambda: e.multi_horizon(scope="x"), lambda: e.prices(lookback=0), lambda: e.flow_summary(window=1)):
        with pytest.raises(RequestError):
            call()
    log = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert {r["tool"] for r in log} >= {"prices", "indicators", "screen"} and all(r["seconds"] >= 0 for r in log) and sum(r["result"].startswith("refused") for r in log) == 11
