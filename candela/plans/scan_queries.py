"""Scan, ingest and session queries, each with its DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r2, r6
from ..operators import scans
from ..sources import ingest, store
from ..sources.projections import bars_1d, index_1d, snapshots, table
from ..streaming import sessions
from .sql import BARS, INDEX, TICKS, lag, q

START, END, AS_OF, LATE = "1996-03-01", "1996-04-15", "1997-06-15", "1998-11-15"


def shown(df: DataFrame) -> DataFrame:
    """The columns compared for scans of bars."""
    more = [c for c in ("effective_date", "is_trading_day", "fallback") if c in df.columns]
    return df.select("ticker", "date", r6("close").alias("close"), "total_volume", r2("total_value").alias("total_value"), *more)


SHOWN = "ticker, date, ROUND(close, 6) AS close, total_volume, ROUND(total_value, 2) AS total_value"


def bars(f):
    return lambda spark, d: f(bars_1d(spark, d))


def hours(f):
    return lambda spark, d: f(sessions.hourly_bars(snapshots(spark, d)))


HOURS = TICKS + """,
st AS (SELECT *, CASE WHEN CAST(timestamp AS TIME) >= TIME '09:00:00' AND CAST(timestamp AS TIME) < TIME '10:00:00' THEN 1
  WHEN CAST(timestamp AS TIME) >= TIME '10:00:00' AND CAST(timestamp AS TIME) <= TIME '11:30:00' THEN 2
  WHEN CAST(timestamp AS TIME) >= TIME '13:00:00' AND CAST(timestamp AS TIME) < TIME '14:00:00' THEN 3
  WHEN CAST(timestamp AS TIME) >= TIME '14:00:00' AND CAST(timestamp AS TIME) <= TIME '15:00:00' THEN 4 END AS s FROM ticks),
sb AS (SELECT ticker, date, s, FIRST(price ORDER BY timestamp, event_id) AS open, MAX(price) AS high, MIN(price) AS low, LAST(price ORDER BY timestamp, event_id) AS close,
  LAST(accumulated_volume ORDER BY timestamp, event_id) AS av, LAST(accumulated_value ORDER BY timestamp, event_id) AS am FROM st WHERE s IS NOT NULL GROUP BY ticker, date, s),
hours AS (SELECT ticker, date + CASE s WHEN 1 THEN TIME '09:00:00' WHEN 2 THEN TIME '10:00:00' WHEN 3 THEN TIME '13:00:00' ELSE TIME '14:00:00' END AS datetime, date, CAST(s AS INT) AS session_index, open, high, low, close,
  CAST(GREATEST(av - COALESCE(MAX(av) OVER (PARTITION BY ticker, date ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS BIGINT) AS volume,
  GREATEST(am - COALESCE(MAX(am) OVER (PARTITION BY ticker, date ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS value,
  s < MAX(s) OVER (PARTITION BY ticker, date) AS is_closed FROM sb)"""
H = "ticker, datetime, date, session_index, open, high, low, close, volume, ROUND(value, 2) AS value, is_closed"


def hour_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("value", r2("value"))


def raw_feed(spark, d: str) -> DataFrame:
    """Orders as a raw text feed with every kind of flaw, by order key."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda m, r, bad, ok: F.when(k % m == r, bad).otherwise(ok)
    day = F.col("o_orderdate").cast("date")
    return o.select(
        k.alias("seq"), pick(41, 3, F.lit(" "), F.concat(F.lit("sym"), (F.col("o_custkey") % 7).cast("string"))).alias("Symbol"),
        F.when(k % 5 == 0, F.date_format(day, "dd/MM/yyyy")).when(k % 5 == 1, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00"))).when(k % 97 == 3, F.lit("n/a")).otherwise(F.date_format(day, "yyyyMMdd")).alias("Date"),
        pick(53, 5, F.lit("-"), F.format_string("%d,%03d", (k % 90 + 10), (k % 1000))).alias("PricePreviousClose"),
        pick(59, 7, F.lit("0"), F.format_string("%d,%03d", (k % 80 + 10), (k % 999))).alias("PriceClose"),
        pick(3, 0, F.lit(""), F.format_string("%d", k % 500)).alias("PriceOpen"),
        pick(4, 0, F.lit("N/A"), F.format_string("%d", k % 300 + 5)).alias("Open"),
        pick(89, 9, F.lit("99999999999999999999"), F.format_string("%d", k % 2000)).alias("TotalVolume"), F.format_string("%d", k % 1200).alias("BuyQuantity"), pick(11, 2, F.lit("--"), F.format_string("%d", k % 800)).alias("SellQuantity"),
        F.format_string("%d", k % 30).alias("TotalTrade"), F.format_string("%d", k % 20).alias("BuyCount"), F.format_string("%d", k % 10).alias("SellCount"),
        F.format_string("%d.9", k % 700).alias("ForeignerBuyQuantity"), F.format_string("%d", k % 900).alias("ForeignerSellQuantity"), F.format_string("%d,%03d.5", (k % 90 + 1), (k % 1000)).alias("TotalValue"),
    )


RAW = """
raw AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 41 = 3 THEN ' ' ELSE 'sym' || CAST(o_custkey % 7 AS VARCHAR) END AS Symbol,
    CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00'
      WHEN o_orderkey % 97 = 3 THEN 'n/a' ELSE strftime(o_orderdate, '%Y%m%d') END AS Date,
    CASE WHEN o_orderkey % 53 = 5 THEN '-' ELSE printf('%d,%03d', o_orderkey % 90 + 10, o_orderkey % 1000) END AS PricePreviousClose,
    CASE WHEN o_orderkey % 59 = 7 THEN '0' ELSE printf('%d,%03d', o_orderkey % 80 + 10, o_orderkey % 999) END AS PriceClose,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey % 500 AS VARCHAR) END AS PriceOpen, CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 300 + 5 AS VARCHAR) END AS Open,
    CASE WHEN o_orderkey % 89 = 9 THEN '99999999999999999999' ELSE CAST(o_orderkey % 2000 AS VARCHAR) END AS TotalVolume, CAST(o_orderkey % 1200 AS VARCHAR) AS BuyQuantity, CASE WHEN o_orderkey % 11 = 2 THEN '--' ELSE CAST(o_orderkey % 800 AS VARCHAR) END AS SellQuantity,
    CAST(o_orderkey % 30 AS VARCHAR) AS TotalTrade, CAST(o_orderkey % 20 AS VARCHAR) AS BuyCount, CAST(o_orderkey % 10 AS VARCHAR) AS SellCount,
    CAST(o_orderkey % 700 AS VARCHAR) || '.9' AS ForeignerBuyQuantity, CAST(o_orderkey % 900 AS VARCHAR) AS ForeignerSellQuantity, printf('%d,%03d.5', o_orderkey % 90 + 1, o_orderkey % 1000) AS TotalValue
  FROM orders)"""


def _num(c: str) -> str:
    t = f"regexp_replace(trim({c}), '[,  ]', '', 'g')"
    return f"TRY_CAST(CASE WHEN {t} IN ('', '-', '--', 'N/A', 'n/a', 'null', 'NULL') THEN NULL ELSE {t} END AS DOUBLE)"


def _int(c: str) -> str:
    return f"COALESCE(TRY_CAST(TRUNC({_num(c)}) AS BIGINT), 0)"


_DAY = "split_part(split_part(trim(Date), 'T', 1), ' ', 1)"
PARSED = RAW + f""",
numbers AS (
  SELECT seq, CASE WHEN trim(Symbol) = '' THEN NULL ELSE UPPER(trim(Symbol)) END AS ticker,
    CAST(COALESCE({", ".join(f"TRY_STRPTIME({_DAY}, '{f}')" for f in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d-%m-%Y", "%Y%m%d", "%d/%m/%y"))}) AS DATE) AS date,
    {_num("PricePreviousClose")} AS prev_close, {_num("PriceClose")} AS close, COALESCE({_num("PriceOpen")}, {_num("Open")}) AS open,
    {_int("TotalTrade")} AS total_trade, {_int("TotalVolume")} AS total_volume, {_int("BuyCount")} AS buy_count, {_int("SellCount")} AS sell_count, {_int("BuyQuantity")} AS buy_volume, {_int("SellQuantity")} AS sell_volume,
    {_int("ForeignerBuyQuantity")} AS foreign_buy_volume, {_int("ForeignerSellQuantity")} AS foreign_sell_volume, COALESCE({_num("TotalValue")}, 0) AS total_value, length(TotalVolume) > 18 AS over_volume FROM raw),
parsed AS (SELECT *, CASE WHEN ticker IS NULL THEN 'missing ticker' WHEN date IS NULL THEN 'bad date' WHEN prev_close IS NULL OR prev_close <= 0 THEN 'bad prev_close'
  WHEN close IS NULL OR close <= 0 THEN 'bad close' WHEN open <= 0 THEN 'bad open' WHEN over_volume THEN 'bad total_volume' END AS reject_reason FROM numbers)"""


def feed(f):
    return lambda spark, d: f(raw_feed(spark, d))


def parsed(f):
    return lambda spark, d: f(ingest.parse(raw_feed(spark, d)))


def stamps(ticks: DataFrame) -> DataFrame:
    """Times as text in the four layouts, with T or a blank between, and two that are none."""
    t, k = F.col("timestamp"), F.col("event_id") % 7
    layouts = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "' 'yyyy/MM/dd HH:mm:ss' '", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss"]
    text = F
    for i, f in enumerate(layouts):
        text = text.when(k == i, F.date_format(t, f))
    return ticks.select("event_id", text.otherwise("soon").alias("stamp"))


def _upserted(spark, d):
    b = bars_1d(spark, d).select("ticker", "date", "close", "total_volume")
    new = b.where("year(date) = 1997").select("ticker", "date", (F.col("close") * 2).alias("close"), (F.col("total_volume") + 1).alias("total_volume"), F.lit(1).cast("bigint").alias("seq"))
    more = b.where("date = DATE'1997-05-05'").select("ticker", "date", (F.col("close") * 4).alias("close"), (F.col("total_volume") + 2).alias("total_volume"), F.lit(2).cast("bigint").alias("seq"))
    return scans.upsert(b, new.unionByName(more), "ticker", "date").select("ticker", "date", r6("close").alias("close"), "total_volume")


def traded(spark, d: str) -> DataFrame:
    """(ticker, date, n): how many lines of orders of each day name each ticker; days without bars, and before a ticker's first bar."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    days = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("date"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return line.join(days, "l_orderkey").join(names, "l_partkey").groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))


def _as_of(spark, d):
    return scans.as_of_join(traded(spark, d), bars_1d(spark, d), "close", "total_volume").withColumn("close", r6("close"))


def stored(spark, d: str) -> str:
    """The bars as a stored table under a name of its own, in the shared folder; its name."""
    name = f"candela_bars_{uuid.uuid4().hex}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = shared.rstrip("/") if shared else "file://" + tempfile.mkdtemp(prefix="candela-")
    store.create(bars_1d(spark, d), name, 4, f"{folder}/{name}")
    return name


def _stored_upsert(spark, d):
    name = stored(spark, d)
    day = bars_1d(spark, d).where("date = DATE'1997-05-05'").withColumn("total_volume", F.lit(0).cast("bigint"))
    store.upsert(day.withColumn("seq", F.lit(1)), name)
    store.append(day.withColumns({"date": F.lit("1997-06-30").cast("date"), "total_volume": F.lit(7).cast("bigint")}), name)
    store.compact(spark, name)
    return shown(store.read(spark, name, "1997-04-20", "1997-07-10"))


QUERIES = {
    "as_of_join": (
        _as_of,
        q(
            "SELECT t.ticker, t.date, t.n, b.date AS bar_date, ROUND(b.close, 6) AS close, b.total_volume FROM lines t ASOF LEFT JOIN bars b ON t.ticker = b.ticker AND t.date >= b.date",
            BARS, "lines AS (SELECT p_brand AS ticker, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
        ),
    ),
    "stored_range": (lambda spark, d: shown(store.read(spark, stored(spark, d), START, END)), q(f"SELECT {SHOWN} FROM bars WHERE date >= DATE '{START}' AND date <= DATE '{END}'", BARS)),
    "stored_upsert": (
        _stored_upsert,
        q(
            f"SELECT {SHOWN} FROM (SELECT * REPLACE (CASE WHEN date = DATE '1997-05-05' THEN 0 ELSE total_volume END AS total_volume) FROM bars WHERE date <> DATE '1997-06-30' OR ticker NOT IN (SELECT ticker FROM bars WHERE date = DATE '1997-05-05')"
            " UNION ALL SELECT * REPLACE (DATE '1997-06-30' AS date, 7 AS total_volume) FROM bars WHERE date = DATE '1997-05-05') WHERE date BETWEEN DATE '1997-04-20' AND DATE '1997-07-10'",
            BARS,
        ),
    ),
    "scan_range": (bars(lambda b: shown(scans.scan_range(b, START, END))), q(f"SELECT {SHOWN} FROM bars WHERE date >= DATE '{START}' AND date <= DATE '{END}'", BARS)),
    "scan_recent": (bars(lambda b: shown(scans.scan_recent(b, 30))), q(f"SELECT {SHOWN} FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30", BARS)),
    "scan_as_of": (
        bars(lambda b: shown(scans.scan_as_of(b, AS_OF, 20))),
        q(f"SELECT {SHOWN}, m AS effective_date, m = DATE '{AS_OF}' AS is_trading_day FROM (SELECT *, MAX(date) OVER (PARTITION BY ticker) AS m FROM bars WHERE date <= DATE '{AS_OF}') QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) <= 20", BARS),
    ),
    "list_tickers": (bars(scans.list_tickers), q("SELECT ticker FROM bars GROUP BY ticker", BARS)),
    "row_count": (bars(scans.row_count), q("SELECT ticker, COUNT(*) AS rows FROM bars GROUP BY ticker", BARS)),
    "date_bounds": (bars(scans.date_bounds), q("SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date FROM bars GROUP BY ticker", BARS)),
    "scan_hourly_recent": (hours(lambda h: hour_rows(scans.recent_hours(h, 10))), q(f"SELECT {H} FROM hours QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY datetime DESC) <= 10", HOURS)),
    "scan_hourly_range": (hours(lambda h: hour_rows(scans.hourly_range(h, "2024-01-03", "2024-01-09"))), q(f"SELECT {H} FROM hours WHERE datetime >= TIMESTAMP '2024-01-03 00:00:00' AND datetime <= TIMESTAMP '2024-01-09 23:59:59'", HOURS)),
    "hourly_point": (hours(lambda h: hour_rows(scans.hourly_point(h, "click", "2024-01-05 10:00:00"))), q(f"SELECT {H} FROM hours WHERE ticker = 'click' AND datetime = TIMESTAMP '2024-01-05 10:00:00'", HOURS)),
    "hourly_row_count": (hours(scans.row_count), q("SELECT ticker, COUNT(*) AS rows FROM hours GROUP BY ticker", HOURS)),
    "scan_snapshots": (lambda spark, d: snapshots(spark, d).where("date = DATE'2024-01-05'").select("ticker", "timestamp", "price", "accumulated_volume", r2("accumulated_value").alias("accumulated_value")), q("SELECT ticker, timestamp, price, accumulated_volume, ROUND(accumulated_value, 2) AS accumulated_value FROM ticks WHERE strftime(timestamp, '%Y-%m-%d') = '2024-01-05'", TICKS)),
    "index_range": (lambda spark, d: index_1d(spark, d).where("exchange = 'ASIA' AND date BETWEEN DATE'1996-01-01' AND DATE'1996-06-30'").select("exchange", "date", r6("index_current").alias("index_current"), "advances", "declines", "unchanged"), q("SELECT exchange, date, ROUND(index_current, 6) AS index_current, advances, declines, unchanged FROM idx WHERE exchange = 'ASIA' AND date >= DATE '1996-01-01' AND date <= DATE '1996-06-30'", INDEX)),
    "price_fallback": (
        bars(lambda b: shown(scans.price_fallback(b, LATE, "1998-12-31", 5))),
        q(f"SELECT {SHOWN}, NOT hit AS fallback FROM (SELECT *, BOOL_OR(date BETWEEN DATE '{LATE}' AND DATE '1998-12-31') OVER (PARTITION BY ticker) AS hit, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) WHERE CASE WHEN hit THEN date BETWEEN DATE '{LATE}' AND DATE '1998-12-31' ELSE k <= 5 END", BARS),
    ),
    "hourly_as_daily": (hours(lambda h: scans.hourly_as_daily(h).withColumn("total_value", r2("total_value"))), q(f"SELECT ticker, datetime, COALESCE({lag('close').replace('ORDER BY date', 'ORDER BY datetime')}, open) AS prev_close, open, high, low, close, ROUND(value, 2) AS total_value, volume AS total_volume, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in ('total_trade', 'buy_count', 'sell_count', 'buy_volume', 'sell_volume', 'foreign_buy_volume', 'foreign_sell_volume', 'foreign_room'))} FROM hours", HOURS)),
    "universe_filter": (bars(lambda b: scans.universe_filter(b, ["brand#33", "Brand#12", "ZZZ", "Brand#55"])), q("SELECT t AS ticker, CAST(pos AS BIGINT) AS pos, FALSE AS is_fallback FROM (VALUES ('BRAND#33', 0), ('BRAND#12', 1), ('BRAND#55', 3)) v(t, pos) WHERE t IN (SELECT ticker FROM bars) UNION ALL SELECT ticker, ROW_NUMBER() OVER (ORDER BY ticker) - 1, TRUE FROM (SELECT DISTINCT ticker FROM bars) WHERE NOT EXISTS (SELECT 1 FROM bars WHERE ticker IN ('BRAND#33', 'BRAND#12', 'ZZZ', 'BRAND#55'))", BARS)),
    "upsert_daily": (_upserted, q("SELECT ticker, date, ROUND(close * CASE WHEN date = DATE '1997-05-05' THEN 4 WHEN year(date) = 1997 THEN 2 ELSE 1 END, 6) AS close, total_volume + CASE WHEN date = DATE '1997-05-05' THEN 2 WHEN year(date) = 1997 THEN 1 ELSE 0 END AS total_volume FROM bars", BARS)),
    "derived_frame": (bars(scans.derived_frame), q(f"SELECT ticker, date, buy_volume - sell_volume AS net_volume, buy_count - sell_count AS net_count, ROUND(CASE WHEN buy_count > 0 THEN buy_volume / buy_count END, 6) AS avg_buy_size, ROUND(CASE WHEN sell_count > 0 THEN sell_volume / sell_count END, 6) AS avg_sell_size, ROUND(total_value / total_trade, 6) AS avg_trade_value, foreign_buy_volume - foreign_sell_volume AS foreign_net_volume, ROUND(foreign_buy_value - foreign_sell_value, 2) AS foreign_net_value, foreign_buy_volume + foreign_sell_volume AS foreign_total_volume, foreign_room - {lag('foreign_room')} AS room_change FROM bars", BARS)),
    "clean_numeric": (feed(lambda r: r.select("seq", ingest.clean(F.col("PricePreviousClose")).alias("prev_close"), ingest.clean(F.col("SellQuantity")).alias("sell"))), q("SELECT seq, NULLIF(replace(replace(PricePreviousClose, ',', ''), ' ', ''), '-') AS prev_close, NULLIF(SellQuantity, '--') AS sell FROM raw", RAW)),
    "cast_int": (feed(lambda r: r.select("seq", ingest.as_int(F.col("ForeignerBuyQuantity")).alias("x"), ingest.as_int(F.col("SellQuantity")).alias("y"))), q("SELECT seq, CAST(seq % 700 AS BIGINT) AS x, CAST(CASE WHEN seq % 11 = 2 THEN 0 ELSE seq % 800 END AS BIGINT) AS y FROM raw", RAW)),
    "cast_float": (feed(lambda r: r.select("seq", ingest.as_float(F.col("TotalValue")).alias("x"))), q("SELECT seq, CAST((seq % 90 + 1) * 1000 + seq % 1000 + 0.5 AS DOUBLE) AS x FROM raw", RAW)),
    "cast_price": (parsed(lambda p: p.select("seq", "prev_close", "close")), q("SELECT seq, prev_close, close FROM parsed", PARSED)),
    "cast_price_optional": (parsed(lambda p: p.select("seq", "open", F.coalesce(F.col("open") <= 0, F.lit(False)).alias("refused"))), q("SELECT seq, open, COALESCE(open <= 0, FALSE) AS refused FROM parsed", PARSED)),
    "parse_date": (parsed(lambda p: p.select("seq", "date")), q("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 > 2 AND o_orderkey % 97 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")[len("WITH RECURSIVE \n") :]),
    "field_map": (parsed(lambda p: p.select("seq", "ticker", "total_volume", "buy_volume", "foreign_sell_volume")), q("SELECT seq, ticker, total_volume, buy_volume, foreign_sell_volume FROM parsed", PARSED)),
    "reject_split": (parsed(ingest.rejected), q("SELECT seq, ticker, date, reject_reason FROM parsed WHERE reject_reason IS NOT NULL", PARSED)),
    "reconcile_warnings": (parsed(ingest.warnings), q("SELECT seq, ticker, date, 'volume' AS warning FROM parsed WHERE reject_reason IS NULL AND total_volume <> 0 AND buy_volume + sell_volume <> total_volume UNION ALL SELECT seq, ticker, date, 'trades' FROM parsed WHERE reject_reason IS NULL AND total_trade <> 0 AND buy_count + sell_count <> total_trade UNION ALL SELECT seq, ticker, date, 'foreign' FROM parsed WHERE reject_reason IS NULL AND total_volume <> 0 AND foreign_buy_volume + foreign_sell_volume > total_volume", PARSED)),
    "dedupe_last_wins": (parsed(lambda p: ingest.dedupe_last(ingest.good(p), "ticker", "date").select("ticker", "date", "seq", "close", "replaced")), q("SELECT ticker, date, MAX(seq) AS seq, ARG_MAX(close, seq) AS close, COUNT(*) - 1 AS replaced FROM parsed WHERE reject_reason IS NULL GROUP BY ticker, date", PARSED)),
    "ingest_summary": (parsed(ingest.summary), q("SELECT COUNT(*) AS records, COUNT(*) FILTER (reject_reason IS NULL) AS parsed, COUNT(*) FILTER (reject_reason IS NOT NULL) AS rejected, (SELECT COUNT(*) FROM (SELECT DISTINCT ticker, date FROM parsed WHERE reject_reason IS NULL)) AS written, STRING_AGG(DISTINCT ticker, ',' ORDER BY ticker) FILTER (reject_reason IS NULL) AS tickers FROM parsed", PARSED)),
    "rows_to_frame": (parsed(lambda p: ingest.dedupe_last(ingest.good(p), "ticker", "date").select("ticker", "date", "prev_close", "close", F.col("total_volume").cast("double").alias("total_volume"), "total_value")), q("SELECT ticker, date, ARG_MAX(prev_close, seq) AS prev_close, ARG_MAX(close, seq) AS close, CAST(ARG_MAX(total_volume, seq) AS DOUBLE) AS total_volume, ARG_MAX(total_value, seq) AS total_value FROM parsed WHERE reject_reason IS NULL GROUP BY ticker, date", PARSED)),
    "classify_session": (lambda spark, d: snapshots(spark, d).select("event_id", sessions.session_of(F.col("timestamp")).alias("session_index")), q("SELECT event_id, CAST(s AS INT) AS session_index FROM st", HOURS)),
    "parse_timestamp": (
        lambda spark, d: stamps(snapshots(spark, d)).select("event_id", sessions.parse_timestamp(F.col("stamp")).alias("parsed")),
        q("SELECT event_id, CASE event_id % 7 WHEN 3 THEN date_trunc('minute', timestamp) WHEN 4 THEN date_trunc('day', timestamp) WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE date_trunc('second', timestamp) END AS parsed FROM ticks", TICKS),
    ),
    "hourly_bars": (hours(hour_rows), q(f"SELECT {H} FROM hours", HOURS)),
    "session_volume": (hours(lambda h: h.select("ticker", "date", "session_index", "volume", r2("value").alias("value"))), q("SELECT ticker, date, session_index, volume, ROUND(value, 2) AS value FROM hours", HOURS)),
    "bar_closed": (hours(lambda h: h.select("ticker", "datetime", "is_closed")), q("SELECT ticker, datetime, session_index < (SELECT MAX(session_index) FROM hours x WHERE x.ticker = h.ticker AND x.date = h.date) AS is_closed FROM hours h", HOURS)),
}

