"""Pieces of the DuckDB SQL that the queries are held against.

Every piece is a common table expression; ``q(...)`` puts together those a query needs.
"""

from __future__ import annotations

BARS = """
trades AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS q,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS v, l_extendedprice / l_quantity AS px, l_linestatus AS ls, l_returnflag AS rf
  FROM lineitem JOIN part ON l_partkey = p_partkey),
days AS (
  SELECT ticker, date, CAST(COUNT(*) AS BIGINT) AS total_trade, CAST(SUM(q) AS BIGINT) AS total_volume,
    CAST(SUM(v) AS DOUBLE) AS total_value, CAST(SUM(v) AS DOUBLE) / CAST(SUM(q) AS DOUBLE) AS close, MAX(px) AS high, MIN(px) AS low,
    CAST(SUM(CASE WHEN ls = 'F' THEN v ELSE 0 END) AS DOUBLE) AS fv, CAST(SUM(CASE WHEN ls = 'F' THEN q ELSE 0 END) AS BIGINT) AS fq,
    CAST(SUM(CASE WHEN ls = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS buy_count, CAST(SUM(CASE WHEN ls = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS sell_count,
    CAST(SUM(CASE WHEN ls = 'O' THEN q ELSE 0 END) AS BIGINT) AS buy_volume, CAST(SUM(CASE WHEN ls = 'F' THEN q ELSE 0 END) AS BIGINT) AS sell_volume,
    CAST(SUM(CASE WHEN rf = 'R' AND ls = 'O' THEN q ELSE 0 END) AS BIGINT) AS foreign_buy_volume,
    CAST(SUM(CASE WHEN rf = 'R' AND ls = 'F' THEN q ELSE 0 END) AS BIGINT) AS foreign_sell_volume,
    CAST(SUM(CASE WHEN rf = 'R' AND ls = 'O' THEN v ELSE 0 END) AS DOUBLE) AS foreign_buy_value,
    CAST(SUM(CASE WHEN rf = 'R' AND ls = 'F' THEN v ELSE 0 END) AS DOUBLE) AS foreign_sell_value
  FROM trades GROUP BY ticker, date),
bars AS (
  SELECT ticker, date, COALESCE(LAG(close) OVER (PARTITION BY ticker ORDER BY date), close) AS prev_close,
    CASE WHEN fq > 0 THEN GREATEST(low, LEAST(high, fv / CAST(fq AS DOUBLE))) ELSE close END AS open,
    high, low, close, total_trade, total_value, total_volume, buy_count, sell_count, buy_volume, sell_volume,
    foreign_buy_volume, foreign_sell_volume, foreign_buy_value, foreign_sell_value,
    CAST(10000000 - SUM(foreign_buy_volume - foreign_sell_volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS foreign_room
  FROM days)"""

FLAWED = """
flawed AS (
  SELECT * REPLACE (CASE WHEN date_part('day', date) = 13 THEN prev_close * 1.0213131 ELSE prev_close END AS prev_close, CASE WHEN date_part('day', date) = 21 THEN 0 ELSE total_volume END AS total_volume,
    CASE date_part('month', date) % 2 WHEN 0 THEN foreign_room + 250000 ELSE foreign_room END AS foreign_room) FROM bars)"""

UNEVEN = """
uneven AS (
  SELECT * EXCLUDE (kk) REPLACE (CASE WHEN kk = 40 AND CAST(split_part(ticker, '#', 2) AS INT) % 3 = 0 THEN 0 ELSE close * (1 + (300 - kk) * 0.02::DOUBLE) END AS close)
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) AS kk FROM bars)
  WHERE kk <= CASE CAST(split_part(ticker, '#', 2) AS INT) % 5 WHEN 0 THEN 15 WHEN 1 THEN 45 WHEN 2 THEN 51 WHEN 3 THEN 52 ELSE 230 END)"""

TICKS = """
ticks AS (
  SELECT event_type AS ticker, ts AS timestamp, CAST(ts AS DATE) AS date, value AS price, event_id,
    CAST(100 * ROW_NUMBER() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS accumulated_volume,
    CAST(SUM(CAST(value AS DECIMAL(18,2)) * 100) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS accumulated_value
  FROM events)"""

INDEX = """
idx0 AS (
  SELECT r_name AS exchange, CAST(o_orderdate AS DATE) AS date, CAST(COUNT(*) AS BIGINT) AS total_trade,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS total_volume,
    CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INT) AS advances, CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS INT) AS declines,
    CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS INT) AS unchanged
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, CAST(o_orderdate AS DATE)),
idx1 AS (SELECT *, total_value / CAST(total_trade AS DOUBLE) AS index_current FROM idx0),
idx2 AS (SELECT *, LAG(index_current) OVER (PARTITION BY exchange ORDER BY date) AS p FROM idx1),
idx AS (SELECT exchange, date, index_current, COALESCE(index_current - p, 0::DOUBLE) AS index_change,
  COALESCE((index_current - p) / p * 100, 0::DOUBLE) AS index_percent_change, total_trade, total_value, total_volume, advances, declines, unchanged FROM idx2)"""


def back(n: int, name: str = "b", of: str = "bars") -> str:
    """The newest n rows of each ticker, numbered from the oldest (i) and the newest (k)."""
    return f"""
{name} AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS i, COUNT(*) OVER (PARTITION BY ticker) AS n
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM {of}) WHERE k <= {n})"""


def q(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def over(n: int, agg: str, full: bool = True, of: str = "close", prior: bool = False) -> str:
    """An aggregate over the last (or prior) n rows, null if one is missing."""
    frame = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if prior else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    w = f"OVER (PARTITION BY ticker ORDER BY date {frame})"
    value = f"{agg}({of}) {w}"
    return f"CASE WHEN COUNT({of}) {w} = {n} THEN {value} END" if full else value


def lag(x: str, n: int = 1) -> str:
    return f"LAG({x}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def r6(x: str) -> str:
    return f"ROUND({x}, 6)"


def r2(x: str) -> str:
    return f"ROUND({x}, 2)"


def recurrence(ns: tuple[int, ...], of: str = "b") -> str:
    """Exponential means e{n} by a recursion over rows: an independent form of the folds."""
    seeds = ", ".join(f"AVG(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s{n}" for n in ns)
    first = ", ".join(f"CASE WHEN {n} = 1 THEN close END AS e{n}" for n in ns)
    step = ", ".join(f"CASE WHEN s.i = {n} THEN s.s{n} WHEN s.i > {n} THEN s.close * (2::DOUBLE / {n + 1}) + r.e{n} * (1 - 2::DOUBLE / {n + 1}) END" for n in ns)
    names = ", ".join(f"e{n}" for n in ns)
    return f"""
seeded AS (SELECT ticker, date, i, n, close, {seeds} FROM {of}),
ema(ticker, date, i, n, close, {names}) AS (
  SELECT ticker, date, i, n, close, {first} FROM seeded WHERE i = 1
  UNION ALL
  SELECT s.ticker, s.date, s.i, s.n, s.close, {step} FROM ema r JOIN seeded s ON s.ticker = r.ticker AND s.i = r.i + 1)"""


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> str:
    """Needs recurrence((fast, slow, ..)): macd, signal, hist and previous hist (ph) of every row."""
    k = f"(2::DOUBLE / {signal + 1})"
    at = slow + signal - 1
    return f"""
line AS (SELECT ticker, date, i, n, close, e{fast} - e{slow} AS m FROM ema WHERE i >= {slow}),
lined AS (SELECT *, AVG(m) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN {signal - 1} PRECEDING AND CURRENT ROW) AS s FROM line),
sig(ticker, date, i, n, m, g) AS (
  SELECT ticker, date, i, n, m, s FROM lined WHERE i = {at}
  UNION ALL
  SELECT l.ticker, l.date, l.i, l.n, l.m, l.m * {k} + r.g * (1 - {k}) FROM sig r JOIN lined l ON l.ticker = r.ticker AND l.i = r.i + 1),
macd AS (SELECT ticker, date, i, n, m, g, m - g AS h, LAG(m - g) OVER (PARTITION BY ticker ORDER BY i) AS ph FROM sig)"""


def rsi(n: int = 14, of: str = "b") -> str:
    """The RSI of every row from row n + 1 on."""
    return f"""
moved AS (SELECT ticker, date, i, n, GREATEST(close - {lag("close")}, 0) AS g, GREATEST({lag("close")} - close, 0) AS l FROM {of}),
moves AS (SELECT *, AVG(g) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sg,
  AVG(l) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sl FROM moved WHERE i > 1),
wild(ticker, date, i, n, ag, al) AS (
  SELECT ticker, date, i, n, sg, sl FROM moves WHERE i = {n + 1}
  UNION ALL
  SELECT m.ticker, m.date, m.i, m.n, (r.ag * {n - 1} + m.g) / {n}, (r.al * {n - 1} + m.l) / {n} FROM wild r JOIN moves m ON m.ticker = r.ticker AND m.i = r.i + 1),
rsi AS (SELECT ticker, date, i, n, CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100::DOUBLE ELSE 50::DOUBLE END ELSE 100 - 100 / (1 + ag / al) END AS v FROM wild)"""


