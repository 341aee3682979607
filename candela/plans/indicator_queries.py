"""Indicator queries over the daily bars, each with its DuckDB SQL. Lookback: 300 rows of each ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recurrence as scan
from ..functions import sql as functions
from ..functions.exprs import recent
from ..operators import flow, momentum, trend, volatility, weekly
from ..sources.projections import bars_1d, flawed, index_1d, uneven
from .sql import BARS, FLAWED, INDEX, UNEVEN, back, lag, macd, over, q, r2, r6, recurrence, rsi

LOOKBACK = 300
AVG = "AVG"
B = back(LOOKBACK)
FLAWS = FLAWED + "," + back(LOOKBACK, of="flawed")
UNEVENS = UNEVEN + "," + back(LOOKBACK, of="uneven")
ALL = back(1_000_000_000)
r4 = "ROUND({}, 4)".format


def on_bars(operator, *args):
    return lambda spark, d: operator(recent(bars_1d(spark, d), LOOKBACK), *args)


def on_flawed(operator, *args):
    return lambda spark, d: operator(recent(flawed(bars_1d(spark, d)), LOOKBACK), *args)


def on_uneven(operator, *args):
    return lambda spark, d: operator(uneven(bars_1d(spark, d)), *args)


def all_bars(operator, *args):
    return lambda spark, d: operator(bars_1d(spark, d), *args)


def pct(now: str, past: str) -> str:
    return f"(CASE WHEN {past} <> 0 THEN ({now} - {past}) / {past} END * 100)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) END)"


def in_sql(columns: str, before: str = "c"):
    """A query in SQL text over the last 300 bars of each ticker, with the closes in date order as array c."""

    def run(spark, d):
        functions.register(spark)
        return spark.sql(
            f"SELECT ticker, date, {columns} FROM (SELECT ticker, date, {before} FROM (SELECT ticker, MAX(date) AS date, transform(array_sort(collect_list(struct(date, close))), x -> x.close) AS c FROM {{bars}} GROUP BY ticker))",
            bars=recent(bars_1d(spark, d), LOOKBACK),
        )

    return run


def rounded(df):
    """Numbers at four places, as long recurrences differ in their last bits; ranges at six."""
    return df.select("ticker", "date", *[F.round(c, 6 if c == "true_range" else 4).alias(c) for c in df.columns[2:]])


def names(template: str, values, sep: str = ", ") -> str:
    return sep.join(template.format(n=v) for v in values)


SMA, EMA, RET = trend.SMA_WINDOWS, trend.EMA_WINDOWS, trend.RETURN_WINDOWS


def _direction(n: int) -> str:
    past = "CASE LEAST(5, i - {n}) ".format(n=n) + " ".join(f"WHEN {k} THEN {lag(f'm{n}', k)}" for k in range(1, 6)) + " END"
    return f"CASE WHEN m{n} IS NULL OR ({past}) IS NULL THEN 'unknown' WHEN m{n} > ({past}) * 1.001::DOUBLE THEN 'rising' WHEN m{n} < ({past}) * 0.999::DOUBLE THEN 'falling' ELSE 'flat' END AS direction_{n}"


CROSSED = f"m AS (SELECT ticker, date, n, {', '.join(f'{over(n, AVG)} AS m{n}' for n in (20, 50, 200))} FROM b)"


def _cross(fast: int, slow: int) -> str:
    return f"""SELECT ticker, CAST({fast} AS BIGINT) AS fast, CAST({slow} AS BIGINT) AS slow,
  COALESCE(ARG_MAX(CASE WHEN a THEN 'golden_cross' ELSE 'death_cross' END, date) FILTER (a <> p AND n > {slow} + 1), 'none') AS crossover, MAX(date) FILTER (a <> p AND n > {slow} + 1) AS date
FROM (SELECT *, {lag("a")} AS p FROM (SELECT ticker, date, n, CASE WHEN m{slow} IS NOT NULL THEN m{fast} > m{slow} END AS a FROM m)) GROUP BY ticker"""


PCTL = "CASE WHEN {hi} IS NOT NULL THEN CASE WHEN {hi} > {lo} THEN (close - {lo}) / ({hi} - {lo}) ELSE 0.5::DOUBLE END END"


def _percentile(n: int) -> str:
    return PCTL.format(hi=f"({over(n, 'MAX')})", lo=f"({over(n, 'MIN')})")


BANDS = f"""
bm AS (SELECT *, {over(20, "AVG")} AS middle, {over(20, "STDDEV_POP")} AS sd FROM b),
bands AS (SELECT *, middle + 2 * sd AS upper, middle - 2 * sd AS lower FROM bm),
banded AS (SELECT *, upper - lower AS width, (upper - lower) / middle AS bandwidth, CASE WHEN upper - lower > 1e-12 THEN (close - lower) / (upper - lower) END AS pct_b FROM bands)"""
TRUE_RANGE = "GREATEST(high - low, ABS(high - prev_close), ABS(low - prev_close))"
IMB = "CASE WHEN buy_{x} + sell_{x} <> 0 THEN CAST(buy_{x} - sell_{x} AS DOUBLE) / (buy_{x} + sell_{x}) END"
OBV = f"""
steps AS (SELECT *, SIGN(close - prev_close) AS move, {lag("close")} AS prior FROM b),
gate AS (SELECT ticker, MAX(CASE WHEN prev_close <= 0 OR ABS(prev_close - prior) > 0.005 * prior THEN 1 ELSE 0 END) AS bad FROM steps GROUP BY ticker),
ob AS (SELECT s.*, CASE WHEN bad = 0 THEN CAST(SUM(move * total_volume) OVER (PARTITION BY s.ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS obv FROM steps s JOIN gate g ON s.ticker = g.ticker)"""
NET = "foreign_buy_value - foreign_sell_value"
NETV = "foreign_buy_volume - foreign_sell_volume"


def _divergence(n: int) -> str:
    p, o = f"({pct('close', lag('close', n))})", f"(obv - {lag('obv', n)})"
    return f"CASE WHEN {p} IS NULL OR {o} IS NULL THEN NULL WHEN {p} > 2 AND {o} < -1000000 THEN 'bearish_divergence' WHEN {p} < -2 AND {o} > 1000000 THEN 'bullish_divergence' ELSE 'in_sync' END AS divergence_{n}"


def _net(n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"{r2(f'SUM({NET}) {w}')} AS net_{n}, COUNT(*) FILTER ({NET} > 0) {w} AS buying_{n}, COUNT(*) FILTER ({NET} < 0) {w} AS selling_{n}, COUNT(*) {w} AS rows_{n}"


CANDLE = """
c0 AS (SELECT ticker, date, open, close, high - low AS span, prev_close,
  CASE WHEN high > low THEN CAST(ROUND(CAST(ABS(close - open) / (high - low) AS DECIMAL(28,8)), 4) AS DOUBLE) ELSE 0 END AS body_ratio,
  CASE WHEN high > low THEN CAST(ROUND(CAST(GREATEST(high - GREATEST(open, close), 0) / (high - low) AS DECIMAL(28,8)), 4) AS DOUBLE) ELSE 0 END AS upper_ratio,
  CASE WHEN high > low THEN CAST(ROUND(CAST(GREATEST(LEAST(open, close) - low, 0) / (high - low) AS DECIMAL(28,8)), 4) AS DOUBLE) ELSE 0 END AS lower_ratio
  FROM b WHERE k = 1)"""
WEEKS = f"""
w0 AS (SELECT ticker, isoyear(date) AS y, week(date) AS wk, MAX(date) AS date, ARG_MAX(close, date) AS close, ARG_MAX(foreign_room, date) AS foreign_room, COUNT(*) AS trading_days,
  {", ".join(f"CAST(SUM({c}) AS {'DOUBLE' if c.endswith('value') else 'BIGINT'}) AS {c}" for c in weekly.SUMMED)} FROM bars GROUP BY ticker, y, wk),
weeks AS (SELECT *, {lag("close")} AS prev_close FROM w0)"""
STATS = back(250) + """,
peaks AS (SELECT *, MAX(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM b)"""
GAPS = f"gaps AS (SELECT ticker, {lag('date')} AS previous, date, CAST(date - {lag('date')} AS BIGINT) AS days FROM b)"


WILDER = (
    f"tr AS (SELECT ticker, i, t, {over(14, 'AVG', of='t').replace('ORDER BY date', 'ORDER BY i')} AS s FROM (SELECT ticker, i, {TRUE_RANGE} AS t FROM b))",
    "wr(ticker, i, a) AS (SELECT ticker, i, s FROM tr WHERE i = 14 UNION ALL SELECT tr.ticker, tr.i, (wr.a * 13 + tr.t) / 14 FROM wr JOIN tr ON tr.ticker = wr.ticker AND tr.i = wr.i + 1)",
)
RSI = f"SELECT l.ticker, l.date, l.n AS available, CAST(15 AS BIGINT) AS required, {r6('v')} AS rsi, CASE WHEN v IS NULL THEN NULL WHEN v >= 70 THEN 'overbought' WHEN v <= 30 THEN 'oversold' ELSE 'neutral' END AS zone FROM b l LEFT JOIN rsi USING (ticker, date) WHERE l.k = 1"
SQUEEZE = f"""
SELECT ticker, MAX(date) AS date, {r6("ARG_MAX(bandwidth, date)")} AS width, {r6("CASE WHEN COUNT(bandwidth) = 20 THEN quantile_cont(bandwidth, 0.15) END")} AS quantile,
  COALESCE(ARG_MAX(bandwidth, date) <= CASE WHEN COUNT(bandwidth) = 20 THEN quantile_cont(bandwidth, 0.15) END, FALSE) AS squeeze
FROM (SELECT ticker, date, MAX(bandwidth) FILTER (k <= 20) AS bandwidth FROM banded WHERE k <= 20 GROUP BY ticker, date) GROUP BY ticker"""
C2C = f"""
SELECT ticker, MAX(date) AS date, {", ".join(f"ROUND(CASE WHEN COUNT(r) = 20 AND MIN(worst) > 0 THEN STDDEV_SAMP(r) * {x} END, 6) AS {n}" for n, x in (("daily_pct", "100"), ("annual_pct", "100 * SQRT(252)"), ("stop_pct", "200")))}
FROM (SELECT ticker, date, k, MIN(close) OVER (PARTITION BY ticker) AS worst, CASE WHEN close > 0 AND {lag("close")} > 0 THEN LN(close / {lag("close")}) END AS r FROM b) WHERE k <= 20 GROUP BY ticker"""
YEAR = f"""
SELECT ticker, date, window_sessions, CAST(200 AS BIGINT) AS required, COLUMNS(* EXCLUDE (ticker, date, window_sessions)) FROM (
  SELECT ticker, MAX(date) AS date, COUNT(*) AS window_sessions, {", ".join(f"CASE WHEN COUNT(*) >= 200 THEN {x} END AS {n}" for n, x in (
      ("is_full", "COUNT(*) >= 240"), ("high", r6("MAX(close)")), ("high_date", "FIRST(date ORDER BY close DESC, date)"), ("low", r6("MIN(close)")), ("low_date", "FIRST(date ORDER BY close, date)"),
      ("from_high_pct", r6("(ARG_MAX(close, date) - MAX(close)) / MAX(close) * 100")), ("from_low_pct", r6("CASE WHEN MIN(close) > 0 THEN (ARG_MAX(close, date) - MIN(close)) / MIN(close) * 100 ELSE 0 END")),
      ("max_drawdown_pct", r6("MIN(close / peak - 1) * 100")), ("return_pct", r6("(ARG_MAX(close, date) - ARG_MIN(close, date)) / ARG_MIN(close, date) * 100")), ("avg_volume", r2("AVG(total_volume)")), ("avg_value", r2("AVG(total_value)"))))}
  FROM peaks GROUP BY ticker)"""


def latest_of(columns: str, source: str, *parts: str) -> str:
    """Columns computed over all rows, for the newest row of each ticker."""
    return q(f"SELECT * EXCLUDE (k) FROM (SELECT ticker, date, k, {columns} FROM {source}) WHERE k = 1", *parts)


QUERIES = {
    "sma": (on_bars(trend.sma), q(f"SELECT ticker, date, {', '.join(f'{r6(over(n, AVG))} AS sma_{n}' for n in SMA)} FROM b", BARS, B)),
    "sma_direction": (on_bars(trend.sma_direction), latest_of("i AS available, " + ", ".join(_direction(n) for n in SMA), "m", BARS, B, f"m AS (SELECT *, {', '.join(f'{over(n, AVG)} AS m{n}' for n in SMA)} FROM b)")),
    "ema": (on_bars(trend.ema), q(f"SELECT ticker, date, {names('ROUND(e{n}, 6) AS ema_{n}', EMA)} FROM ema WHERE i = n", BARS, B, recurrence(EMA))),
    "ma_distance": (
        on_bars(trend.ma_distance),
        q(f"SELECT e.ticker, e.date, {', '.join(r6(f'CASE WHEN s.m{n} > 0 THEN (e.close - s.m{n}) / s.m{n} * 100 END') + f' AS dist_sma_{n}' for n in SMA)}, {', '.join(r6(f'CASE WHEN e{n} > 0 THEN (e.close - e{n}) / e{n} * 100 END') + f' AS dist_ema_{n}' for n in EMA)} FROM ema e JOIN s ON e.ticker = s.ticker AND e.date = s.date WHERE e.i = e.n", BARS, B, recurrence(EMA), f"s AS (SELECT ticker, date, {', '.join(f'{over(n, AVG)} AS m{n}' for n in SMA)} FROM b)"),
    ),
    "macd": (on_bars(trend.macd), q(f"SELECT l.ticker, l.date, l.n AS available, CAST(34 AS BIGINT) AS required, {r6('m')} AS macd, {r6('g')} AS signal, {r6('h')} AS histogram FROM b l LEFT JOIN macd USING (ticker, date) WHERE l.k = 1", BARS, B, recurrence((12, 26)), macd())),
    "macd_crossover": (on_bars(trend.macd_crossover), q("SELECT l.ticker, l.date, CASE WHEN h IS NULL OR ph IS NULL THEN 'unknown' WHEN ph <= 0 AND h > 0 THEN 'bullish_cross' WHEN ph >= 0 AND h < 0 THEN 'bearish_cross' ELSE 'none' END AS crossover FROM b l LEFT JOIN macd USING (ticker, date) WHERE l.k = 1", BARS, B, recurrence((12, 26)), macd())),
    "returns_by_window": (on_bars(trend.returns_by_window), latest_of(", ".join(f"{r6(pct('close', lag('close', n)))} AS return_{n}" for n in RET), "b", BARS, B)),
    "sma_crossover": (on_bars(trend.sma_crossover), q(" UNION ALL ".join(_cross(*p) for p in trend.CROSS_PAIRS), BARS, B, CROSSED)),
    "candlestick": (
        on_bars(trend.candlestick),
        q(f"SELECT ticker, date, body_ratio, upper_ratio, lower_ratio, {r6('CASE WHEN prev_close > 0 THEN (open - prev_close) / prev_close * 100 END')} AS gap_pct, CASE WHEN span = 0 OR body_ratio <= 0.10 THEN 'doji' WHEN close > open AND body_ratio >= 0.85 THEN 'bullish_marubozu' WHEN close < open AND body_ratio >= 0.85 THEN 'bearish_marubozu' WHEN lower_ratio >= 0.55 AND upper_ratio <= 0.15 AND body_ratio <= 0.35 THEN 'hammer' WHEN upper_ratio >= 0.55 AND lower_ratio <= 0.15 AND body_ratio <= 0.35 THEN 'shooting_star' ELSE 'standard' END AS pattern FROM c0", BARS, B, CANDLE),
    ),
    "trend_alignment": (
        on_bars(trend.trend_alignment),
        latest_of("CASE WHEN m50 IS NULL THEN NULL WHEN m200 IS NOT NULL THEN CASE WHEN close > m20 AND m20 > m50 AND m50 > m200 THEN 'aligned_uptrend' WHEN close < m20 AND m20 < m50 AND m50 < m200 THEN 'aligned_downtrend' WHEN close > m200 THEN 'above_sma200_transitional' ELSE 'below_sma200_transitional' END WHEN close > m20 AND m20 > m50 THEN 'short_term_uptrend' WHEN close < m20 AND m20 < m50 THEN 'short_term_downtrend' ELSE 'transitional' END AS alignment", "m", BARS, B, f"m AS (SELECT *, {', '.join(f'{over(n, AVG)} AS m{n}' for n in (20, 50, 200))} FROM b)"),
    ),
    "rsi": (on_bars(momentum.rsi), q(RSI, BARS, B, rsi())),
    "z_score": (
        on_bars(momentum.z_score),
        q("SELECT ticker, date, z_score, CASE WHEN z_score IS NULL THEN NULL WHEN z_score >= 2 THEN 'extreme_high' WHEN z_score >= 1.5 THEN 'elevated' WHEN z_score <= -2 THEN 'extreme_low' WHEN z_score <= -1.5 THEN 'depressed' ELSE 'normal' END AS flag FROM z", BARS, B, f"r AS (SELECT *, close / {lag('close')} - 1 AS ret FROM b)", f"z AS (SELECT ticker, date, {r6('CASE WHEN n >= 22 THEN CASE WHEN s > 1e-15 THEN (ret - m) / s ELSE 0 END END')} AS z_score FROM (SELECT *, {over(20, 'AVG', of='ret')} AS m, {over(20, 'STDDEV_SAMP', of='ret')} AS s FROM r) WHERE k = 1)"),
    ),
    "close_percentile": (on_bars(momentum.close_percentile), q(f"SELECT ticker, date, {r6('p')} AS percentile, CASE WHEN p IS NULL THEN NULL WHEN p >= 0.8 THEN 'near_high' WHEN p <= 0.2 THEN 'near_low' ELSE 'middle' END AS zone FROM (SELECT *, {_percentile(20)} AS p FROM b) WHERE k = 1", BARS, B)),
    "close_percentile_by_window": (on_bars(momentum.close_percentile_by_window), latest_of(", ".join(f"{r6(_percentile(n))} AS percentile_{n}" for n in (20, 60, 126)), "b", BARS, B)),
    "return_streak": (
        on_bars(momentum.return_streak),
        q("SELECT ticker, MAX(date) AS date, CAST(ARG_MAX(s, date) * COUNT(*) FILTER (date > brk OR brk IS NULL) AS BIGINT) AS streak, CASE WHEN COUNT(*) FILTER (date > brk OR brk IS NULL) >= 5 AND ARG_MAX(s, date) <> 0 THEN 'extended' WHEN COUNT(*) FILTER (date > brk OR brk IS NULL) >= 3 AND ARG_MAX(s, date) <> 0 THEN 'notable' ELSE 'normal' END AS flag FROM (SELECT *, MAX(CASE WHEN s <> e THEN date END) OVER (PARTITION BY ticker) AS brk FROM (SELECT *, LAST_VALUE(s) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM c)) GROUP BY ticker", BARS, B, f"c AS (SELECT * FROM (SELECT ticker, date, SIGN(close - {lag('close')}) AS s FROM b) WHERE s IS NOT NULL)"),
    ),
    "stochastic": (
        on_bars(momentum.stochastic),
        q(f"SELECT ticker, date, {r6('CASE WHEN d IS NOT NULL THEN x END')} AS k, {r6('d')} AS d, CASE WHEN d IS NULL THEN NULL WHEN x > 80 THEN 'overbought' WHEN x < 20 THEN 'oversold' ELSE 'neutral' END AS zone, CASE WHEN px <= pd AND x > d THEN 'bullish_crossover' WHEN px >= pd AND x < d THEN 'bearish_crossover' END AS crossover FROM t2 WHERE k = 1", BARS, B, f"t0 AS (SELECT ticker, date, k, CASE WHEN hi IS NOT NULL THEN CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END END AS x FROM (SELECT *, {over(14, 'MAX', of='high')} AS hi, {over(14, 'MIN', of='low')} AS lo FROM b))", f"t1 AS (SELECT *, {over(3, 'AVG', of='x')} AS d FROM t0)", f"t2 AS (SELECT *, {lag('x')} AS px, {lag('d')} AS pd FROM t1)"),
    ),
    "bollinger": (on_bars(volatility.bollinger), q(f"SELECT ticker, date, {r6('middle')} AS middle, {r6('upper')} AS upper, {r6('lower')} AS lower, {r6('pct_b')} AS pct_b, {r6('width / middle * 100')} AS bandwidth FROM banded WHERE middle IS NOT NULL", BARS, B, BANDS)),
    "bollinger_position": (on_bars(volatility.bollinger_position), q("SELECT ticker, date, CASE WHEN middle IS NULL THEN NULL WHEN pct_b IS NULL THEN 'middle' WHEN pct_b >= 1 THEN 'above_upper' WHEN pct_b >= 0.8 THEN 'near_upper' WHEN pct_b <= 0 THEN 'below_lower' WHEN pct_b <= 0.2 THEN 'near_lower' ELSE 'inside_band' END AS position FROM banded WHERE k = 1", BARS, B, BANDS)),
    "bollinger_squeeze": (on_bars(volatility.bollinger_squeeze), q(SQUEEZE, BARS, B, BANDS)),
    "c2c_volatility": (on_bars(volatility.c2c_volatility), q(C2C, BARS, B)),
    "true_range": (on_bars(lambda b: volatility.true_range(b).selectExpr("ticker", "date", "round(true_range, 6) AS true_range")), q(f"SELECT ticker, date, {r6(TRUE_RANGE)} AS true_range FROM b", BARS, B)),
    "atr": (
        on_bars(volatility.atr),
        q(f"SELECT l.ticker, l.date, l.n AS available, {r6('a')} AS atr, {r6('a / l.close * 100')} AS atr_pct, {r6('a * 2')} AS stop FROM b l LEFT JOIN wr ON l.ticker = wr.ticker AND l.i = wr.i WHERE l.k = 1", BARS, B, *WILDER),
    ),
    "volume_imbalance": (on_bars(flow.volume_imbalance), q(f"SELECT ticker, date, {r6('x')} AS imbalance, {r6('m')} AS mean, CASE WHEN m IS NULL THEN 'unknown' WHEN m > 0.05 THEN 'buy_side' WHEN m < -0.05 THEN 'sell_side' ELSE 'balanced' END AS bias FROM (SELECT *, {over(5, 'AVG', of='x')} AS m FROM (SELECT ticker, date, k, {IMB.format(x='volume')} AS x FROM b)) WHERE k = 1", BARS, B)),
    "count_imbalance": (on_bars(flow.count_imbalance), q(f"SELECT ticker, date, {r6('x')} AS imbalance, {r6('m')} AS mean FROM (SELECT *, {over(5, 'AVG', of='x')} AS m FROM (SELECT ticker, date, k, {IMB.format(x='count')} AS x FROM b)) WHERE k = 1", BARS, B)),
    "prev_close_mismatch": (on_flawed(flow.prev_close_mismatch), q("SELECT ticker, date, ROUND(prev_close, 6) AS prev_close, ROUND(p, 6) AS prior_close, ROUND(p / prev_close, 6) AS ratio FROM (SELECT *, " + lag("close") + " AS p FROM b) WHERE ABS(prev_close - p) / p > 0.005", BARS, FLAWS)),
    "obv": (on_bars(flow.obv), q("SELECT a.ticker, a.date, a.obv, a.obv - c.obv AS change FROM ob a JOIN ob c ON a.ticker = c.ticker AND c.i = a.n - LEAST(a.n - 1, 20) WHERE a.k = 1 AND a.n >= 2", BARS, B, OBV)),
    "obv_direction_counts": (on_bars(flow.obv_direction_counts), q("SELECT ticker, COUNT(*) FILTER (close > prev_close) AS up, COUNT(*) FILTER (close < prev_close) AS down, COUNT(*) FILTER (close = prev_close) AS flat FROM b GROUP BY ticker", BARS, B)),
    "obv_divergence": (on_bars(flow.obv_divergence), latest_of(f"{_divergence(20)}, {_divergence(60)}", "ob", BARS, B, OBV)),
    "volume_ratio": (on_bars(flow.volume_ratio), q(f"SELECT ticker, date, {r6('x')} AS ratio, CASE WHEN x IS NULL THEN NULL WHEN x >= 2 THEN 'very_high' WHEN x >= 1.5 THEN 'elevated' WHEN x <= 0.5 THEN 'very_low' WHEN x <= 0.7 THEN 'low' ELSE 'normal' END AS flag FROM (SELECT *, total_volume / ({over(20, 'AVG', of='total_volume', prior=True)}) AS x FROM b) WHERE k = 1", BARS, B)),
    "volume_spikes": (
        on_bars(flow.volume_spikes),
        q("SELECT ticker, " + ", ".join(f"COUNT(*) FILTER (k <= {n} AND spike{m}) AS spikes_{n}_{x}" for n in (20, 60) for x, m in (("up", " AND move > 0"), ("down", " AND move < 0"), ("all", ""))) + " FROM s GROUP BY ticker", BARS, B, f"s AS (SELECT ticker, k, total_volume > 1.5 * ({over(20, 'AVG', of='total_volume', prior=True)}) AS spike, close - {lag('close')} AS move FROM b)"),
    ),
    "trade_size_by_side": (
        on_bars(flow.trade_size_by_side),
        q(f"SELECT ticker, date, {r6('bs / 100')} AS buy_lots, {r6('ss / 100')} AS sell_lots, {r6('br')} AS buy_ratio, {r6('sr')} AS sell_ratio, {r6(div('bs', 'ss'))} AS buy_vs_sell, CASE WHEN br IS NULL OR sr IS NULL THEN 'unknown' WHEN LEAST(br, sr) >= 1.3::DOUBLE THEN 'larger_tickets_both_sides' WHEN br >= 1.3::DOUBLE THEN 'larger_buy_tickets' WHEN sr >= 1.3::DOUBLE THEN 'larger_sell_tickets' ELSE 'ordinary_ticket_sizes' END AS reading FROM (SELECT *, {div('bs', over(20, 'AVG', of='bs', prior=True))} AS br, {div('ss', over(20, 'AVG', of='ss', prior=True))} AS sr FROM (SELECT *, {div('buy_volume', 'buy_count')} AS bs, {div('sell_volume', 'sell_count')} AS ss FROM b)) WHERE k = 1", BARS, B),
    ),
    "avg_trade_value": (on_bars(flow.avg_trade_value), q(f"SELECT ticker, date, {r2('v')} AS value, {r6('x')} AS ratio, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 1.5 THEN 'unusually_large_tickets' WHEN x <= 0.66 THEN 'unusually_small_tickets' ELSE 'normal' END AS reading FROM (SELECT *, v / ({over(20, 'AVG', of='v', prior=True)}) AS x FROM (SELECT *, total_value / total_trade AS v FROM b)) WHERE k = 1", BARS, B)),
    "value_spike": (on_bars(flow.value_spike), q(f"SELECT ticker, date, {r6('x')} AS ratio, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 2 THEN 'value_spike' WHEN x >= 1.5 THEN 'elevated_value' WHEN x <= 0.5 THEN 'value_drought' ELSE 'normal' END AS flag FROM (SELECT *, total_value / ({over(20, 'AVG', of='total_value', prior=True)}) AS x FROM b) WHERE k = 1", BARS, B)),
    "prior_average": (on_bars(flow.prior_average), q(f"SELECT ticker, date, {r2('a')} AS prior_average, {r6('total_volume / a')} AS ratio FROM (SELECT *, {over(20, 'AVG', of='total_volume', prior=True)} AS a FROM b)", BARS, B)),
    "foreign_net_volume": (on_bars(flow.foreign_net_volume), q(f"SELECT ticker, date, {NETV} AS net_volume, CAST(SUM({NETV}) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM b", BARS, B)),
    "foreign_net_value": (on_bars(flow.foreign_net_value), latest_of(f"{r2(NET)} AS net, {r2(f'SUM({NET}) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS cumulative, CASE SIGN(SUM({NET}) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) WHEN 1 THEN 'net_buying' WHEN -1 THEN 'net_selling' ELSE 'flat' END AS stance, {', '.join(_net(n) for n in (20, 60, 120))}", "b", BARS, B)),
    "foreign_participation": (on_bars(flow.foreign_participation), q(f"SELECT ticker, date, {r6('x')} AS participation, {r6('m')} AS mean FROM (SELECT *, {over(20, 'AVG', of='x')} AS m FROM (SELECT *, {div('foreign_buy_volume + foreign_sell_volume', 'total_volume')} AS x FROM b)) WHERE k = 1", BARS, B)),
    "foreign_room_trend": (on_bars(flow.foreign_room_trend), q("SELECT ticker, date, foreign_room, x AS change, CASE WHEN x IS NULL THEN 'unknown' WHEN x < 0 THEN 'room_shrinking_foreign_accumulation' WHEN x > 0 THEN 'room_growing_foreign_divestment' ELSE 'room_unchanged' END AS reading FROM (SELECT *, foreign_room - " + lag("foreign_room", 20) + " AS x FROM b) WHERE k = 1", BARS, B)),
    "room_structural": (on_flawed(flow.room_structural), q(f"SELECT ticker, date, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS ordinal, u AS unexplained FROM (SELECT *, foreign_room - {lag('foreign_room')} + {NETV} AS u FROM b) WHERE ABS(u) > GREATEST(0.05 * total_volume, 1000) QUALIFY ordinal <= 10", BARS, FLAWS)),
    "zero_foreign_days": (on_bars(flow.zero_foreign_days), q("SELECT ticker, COUNT(*) FILTER (foreign_buy_volume + foreign_sell_volume = 0) AS days, COUNT(*) AS rows FROM b GROUP BY ticker", BARS, B)),
    "flow_summary": (
        on_bars(flow.flow_summary),
        q(f"SELECT ticker, date, {r6('v')} AS volume_imbalance, {r6('c')} AS count_imbalance, {r2('cum')} AS foreign_net_value_cum, {r2('m')} AS foreign_net_value, {r6('p')} AS foreign_participation, room AS room_change, COALESCE(cum > 0 AND v < -0.05 OR cum < 0 AND v > 0.05, FALSE) AS flow_against_foreign, COALESCE(SIGN(v) * SIGN(c) = -1, FALSE) AS volume_against_count, LEAST(10, moves) AS structural_moves FROM (SELECT *, {over(20, 'AVG', of='vi')} AS v, {over(20, 'AVG', of='ci')} AS c, {over(20, 'AVG', of='fp')} AS p, {over(20, 'SUM', False, NET)} AS m, SUM({NET}) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum, foreign_room - {lag('foreign_room', 20)} AS room, COUNT(*) FILTER (ABS(du) > 0.05 * total_volume AND ABS(du) > 1000) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS moves FROM (SELECT *, {IMB.format(x='volume')} AS vi, {IMB.format(x='count')} AS ci, CASE WHEN total_volume <> 0 THEN CAST(foreign_buy_volume + foreign_sell_volume AS DOUBLE) / total_volume END AS fp, foreign_room - {lag('foreign_room')} + {NETV} AS du FROM b)) WHERE k = 1", BARS, B),
    ),
    "latest_session": (on_bars(flow.latest_session), q(f"SELECT ticker, date, {r6('close')} AS close, {r6(pct('close', 'prev_close'))} AS change_pct, {r6('total_volume / 1e6')} AS volume_mil, {r6('total_value / 1e9')} AS value_bil, {r6(f'({NET}) / 1e9')} AS foreign_net_bil FROM b WHERE k = 1", BARS, B)),
    "recent_history": (on_bars(flow.recent_history), q(f"SELECT ticker, date, {r6('close')} AS close, {r6(pct('close', 'prev_close'))} AS change_pct, {r6('total_volume / 1e6')} AS volume_mil, {r6(f'({NET}) / 1e9')} AS foreign_net_bil FROM b WHERE k <= 5", BARS, B)),
    "price_limit_flag": (on_bars(flow.price_limit_flag), q("SELECT ticker, date, x AS change_pct, CASE WHEN x >= 6.5 THEN 'near_ceiling' WHEN x <= -6.5 THEN 'near_floor' END AS flag FROM (SELECT *, CAST(ROUND(CAST((close - prev_close) / prev_close * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS x FROM b WHERE k = 1)", BARS, B)),
    "calendar_gaps": (on_bars(flow.calendar_gaps), q("SELECT ticker, previous, date, days, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS ordinal, COUNT(*) OVER (PARTITION BY ticker) AS gaps FROM gaps WHERE days > 5 QUALIFY ordinal <= 10", BARS, B, GAPS)),
    "zero_volume_days": (on_flawed(flow.zero_volume_days), q("SELECT ticker, date FROM b WHERE NOT COALESCE(total_volume > 0, FALSE)", BARS, FLAWS)),
    "corporate_action_suspects": (on_flawed(flow.prev_close_mismatch), q("SELECT a.ticker, a.date, ROUND(a.prev_close, 6) AS prev_close, ROUND(p.close, 6) AS prior_close, ROUND(p.close / a.prev_close, 6) AS ratio FROM b a JOIN b p ON a.ticker = p.ticker AND p.i = a.i - 1 WHERE ABS(a.prev_close - p.close) > 0.005 * p.close", BARS, FLAWS)),
    "data_quality": (
        on_flawed(flow.data_quality),
        q(f"SELECT ticker, COUNT(*) AS rows, COUNT(*) FILTER (date - p > 5) AS gaps, COUNT(*) FILTER (total_volume <= 0) AS halts, COUNT(*) FILTER (ABS(prev_close - pc) > 0.005 * pc) AS actions, COUNT(*) FILTER (date - p > 5) > 0 AS warn_gap, COUNT(*) FILTER (total_volume <= 0) > 0 AS warn_halt, COUNT(*) FILTER (ABS(prev_close - pc) > 0.005 * pc) > 0 AS warn_action FROM (SELECT *, {lag('date')} AS p, {lag('close')} AS pc FROM b) GROUP BY ticker", BARS, FLAWS),
    ),
    "weekly_bars": (all_bars(weekly.weekly_bars_view), q(f"SELECT ticker, date, {r6('prev_close')} AS prev_close, {r6('close')} AS close, {', '.join((r2(c) if c.endswith('value') else c) + f' AS {c}' for c in weekly.SUMMED)}, foreign_room, trading_days FROM weeks", BARS, WEEKS)),
    "thin_weeks": (all_bars(weekly.thin_weeks), q("SELECT ticker, date, trading_days FROM weeks WHERE trading_days < 3", BARS, WEEKS)),
    "stats_52w": (all_bars(weekly.stats_52w), q(YEAR, BARS, STATS)),
    "normalized_100": (all_bars(weekly.normalized_100), q(f"SELECT a.ticker, a.date, {r6('a.close / f.close * 100')} AS normalized FROM b a JOIN b f ON a.ticker = f.ticker AND f.i = 1", BARS, back(250))),
    "index_latest": (
        lambda spark, d: weekly.index_latest(index_1d(spark, d)).selectExpr("exchange", "date", "round(index_current, 6) AS index_current", "round(index_change, 6) AS index_change", "total_trade", "round(total_value, 2) AS total_value", "total_volume", "advances", "declines", "unchanged"),
        q("SELECT exchange, date, ROUND(index_current, 6) AS index_current, ROUND(index_change, 6) AS index_change, total_trade, ROUND(total_value, 2) AS total_value, total_volume, advances, declines, unchanged FROM idx o WHERE date = (SELECT MAX(date) FROM idx x WHERE x.exchange = o.exchange)", INDEX),
    ),
    "market_breadth": (
        lambda spark, d: weekly.market_breadth(index_1d(spark, d)),
        q("SELECT exchange, date, advances, declines, unchanged, ROUND(index_current, 6) AS index_current, ROUND(index_percent_change, 6) AS index_percent_change, ad AS ad_ratio, CASE WHEN ad IS NULL THEN CASE WHEN advances > 0 THEN 'strongly_bullish' ELSE 'neutral' END WHEN ad >= 2 THEN 'strongly_bullish' WHEN ad >= 1.2 THEN 'bullish' WHEN ad >= 0.8 THEN 'neutral' WHEN ad >= 0.5 THEN 'bearish' ELSE 'strongly_bearish' END AS regime FROM (SELECT *, CASE WHEN declines > 0 THEN CAST(ROUND(CAST(CAST(advances AS DOUBLE) / declines AS DECIMAL(28,8)), 2) AS DOUBLE) END AS ad FROM idx QUALIFY ROW_NUMBER() OVER (PARTITION BY exchange ORDER BY date DESC) = 1)", INDEX),
    ),
    "ema_series": (lambda spark, d: rounded(scan.ema_series(bars_1d(spark, d))), q(f"SELECT ticker, date, {r4('e12')} AS ema_12, {r4('e26')} AS ema_26 FROM ema", BARS, ALL, recurrence((12, 26)))),
    "macd_series": (lambda spark, d: rounded(scan.macd_series(bars_1d(spark, d))), q(f"SELECT e.ticker, e.date, {r4('e12 - e26')} AS macd, {r4('g')} AS signal, {r4('h')} AS histogram FROM ema e LEFT JOIN macd m ON e.ticker = m.ticker AND e.i = m.i", BARS, ALL, recurrence((12, 26)), macd())),
    "rsi_series": (lambda spark, d: rounded(scan.rsi_series(bars_1d(spark, d))), q(f"SELECT l.ticker, l.date, {r4('v')} AS rsi FROM b l LEFT JOIN rsi USING (ticker, date)", BARS, ALL, rsi())),
    "atr_series": (lambda spark, d: rounded(scan.atr_series(bars_1d(spark, d))), q(f"SELECT l.ticker, l.date, {r6(TRUE_RANGE)} AS true_range, {r4('a')} AS atr, {r4('a / l.close * 100')} AS atr_pct FROM b l LEFT JOIN wr ON l.ticker = wr.ticker AND l.i = wr.i", BARS, ALL, *WILDER)),
    "uneven_bollinger_squeeze": (on_uneven(volatility.bollinger_squeeze), q(SQUEEZE.replace("SELECT ticker, date, MAX(bandwidth)", "SELECT ticker, date, MAX(CASE WHEN middle <> 0 THEN bandwidth END)"), BARS, UNEVENS, BANDS)),
    "uneven_c2c_volatility": (on_uneven(volatility.c2c_volatility), q(C2C, BARS, UNEVENS)),
    "uneven_stats_52w": (on_uneven(weekly.stats_52w), q(YEAR, BARS, UNEVEN, STATS.replace("FROM bars", "FROM uneven"))),
    "uneven_sma_crossover": (on_uneven(trend.sma_crossover), q(" UNION ALL ".join(_cross(*p) for p in trend.CROSS_PAIRS), BARS, UNEVENS, CROSSED)),
    "uneven_rsi": (on_uneven(momentum.rsi), q(RSI, BARS, UNEVENS, rsi())),
    "sql_ema": (in_sql(", ".join(f"round(candela_ema(c, {n}), 6) AS ema_{n}" for n in EMA)), q(f"SELECT ticker, date, {names('ROUND(e{n}, 6) AS ema_{n}', EMA)} FROM ema WHERE i = n", BARS, B, recurrence(EMA))),
    "sql_rsi": (in_sql("round(candela_rsi(c, 14), 6) AS rsi"), q(f"SELECT l.ticker, l.date, {r6('v')} AS rsi FROM b l LEFT JOIN rsi USING (ticker, date) WHERE l.k = 1", BARS, B, rsi())),
    "sql_macd": (
        in_sql("round(m.macd, 6) AS macd, round(m.signal, 6) AS signal, round(m.histogram, 6) AS histogram", "candela_macd(c, 12, 26, 9) AS m"),
        q(f"SELECT l.ticker, l.date, {r6('m')} AS macd, {r6('g')} AS signal, {r6('h')} AS histogram FROM b l LEFT JOIN macd USING (ticker, date) WHERE l.k = 1", BARS, B, recurrence((12, 26)), macd()),
    ),
}
