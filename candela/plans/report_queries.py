"""Level, horizon, comparison and screening queries, each with its DuckDB SQL."""

from __future__ import annotations

import weakref

from ..functions import labels
from ..functions.exprs import recent
from ..operators import levels, momentum, trend, volatility
from ..sources.projections import bars_1d, snapshots
from ..streaming import sessions
from . import report, scoring
from .indicator_queries import QUERIES as INDICATORS
from .indicator_queries import BANDS, LOOKBACK, NET, OBV, B, _percentile
from .scan_queries import HOURS
from .sql import BARS, back, lag, macd, over, q, recurrence, rsi

AVG = "AVG"
EMAS = (12, 20, 26, 50, 200)


def on(n: int, f):
    """``f`` of the newest n bars of each ticker. Many branches read them, so they are made once and kept (memory, then disk) as long as the result."""

    def run(spark, d):
        rows = recent(bars_1d(spark, d), n).cache()
        out = f(rows)
        weakref.finalize(out, rows.unpersist).atexit = False
        return out

    return run


def on_levels(f):
    return on(LOOKBACK, f)


def renamed(sql: str, **names: str) -> str:
    """The SQL with names of its tables replaced."""
    import re

    for k, v in names.items():
        sql = re.sub(rf"\b{k}\b", v, sql)
    return sql


SWINGS = """
sw AS (SELECT ticker, date, close, COUNT(*) OVER w AS c, MAX(close) OVER w AS hi, MIN(close) OVER w AS lo FROM b WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
swings AS (SELECT ticker, CASE WHEN close = hi THEN 'high' ELSE 'low' END AS kind, date, ROUND(close, 0) AS level FROM sw WHERE c = 11 AND hi > lo AND (close = hi OR close = lo)),
swing AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, kind ORDER BY date DESC) AS ordinal FROM swings)"""
EXTREMES = "ext AS (" + " UNION ALL ".join(f"SELECT ticker, CAST({w} AS BIGINT) AS win, ROUND(MAX(close), 0) AS high, FIRST(date ORDER BY close DESC, date) AS high_date, ROUND(MIN(close), 0) AS low, FIRST(date ORDER BY close, date) AS low_date FROM b WHERE k <= {w} GROUP BY ticker HAVING COUNT(*) = {w}" for w in levels.EXTREMES) + ")"
MEANS = f"""
means AS (SELECT b.ticker, {", ".join(f"({over(n, AVG)}) AS m{n}".replace("PARTITION BY ticker", "PARTITION BY b.ticker").replace("ORDER BY date", "ORDER BY b.date") for n in (5, 10, 20, 50, 100, 200))}, b.date, b.k, b.close FROM b),
avgs AS (SELECT m.*, e12, e20, e26, e50, e200 FROM means m JOIN ema e ON m.ticker = e.ticker AND m.date = e.date WHERE m.k = 1),
mal AS ({" UNION ALL ".join(f"SELECT ticker, 'SMA{n}' AS basis, ROUND(m{n}, 0) AS level FROM avgs WHERE m{n} > 0" for n in (5, 10, 20, 50, 100, 200))} UNION ALL {" UNION ALL ".join(f"SELECT ticker, 'EMA{n}', ROUND(e{n}, 0) FROM avgs WHERE e{n} > 0" for n in EMAS)}),
bbl AS (SELECT ticker, 'BB upper' AS basis, ROUND(upper, 0) AS level FROM banded WHERE k = 1 AND middle IS NOT NULL UNION ALL SELECT ticker, 'BB lower', ROUND(lower, 0) FROM banded WHERE k = 1 AND middle IS NOT NULL)"""
CANDIDATES = """
every AS (SELECT ticker, 'swing ' || CAST(date AS VARCHAR) AS basis, level FROM swing WHERE ordinal <= 3
  UNION ALL SELECT ticker, 'high ' || win || 'd ' || CAST(high_date AS VARCHAR), high FROM ext UNION ALL SELECT ticker, 'low ' || win || 'd ' || CAST(low_date AS VARCHAR), low FROM ext
  UNION ALL SELECT * FROM mal UNION ALL SELECT * FROM bbl),
cand AS (SELECT e.ticker, CASE WHEN level < close THEN 'support' ELSE 'resistance' END AS side, basis, level, close FROM every e JOIN b ON e.ticker = b.ticker AND b.k = 1 WHERE level <> close)"""
ZONES = """
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, side ORDER BY level, basis) AS rn FROM cand),
walk(ticker, side, basis, level, close, rn, anchor, z) AS (
  SELECT ticker, side, basis, level, close, rn, level, 1 FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.ticker, r.side, r.basis, r.level, r.close, r.rn, CASE WHEN w.anchor > 0 AND (r.level - w.anchor) / w.anchor * 100 <= 0.75 THEN w.anchor ELSE r.level END, CASE WHEN w.anchor > 0 AND (r.level - w.anchor) / w.anchor * 100 <= 0.75 THEN w.z ELSE w.z + 1 END
  FROM walk w JOIN ranked r ON r.ticker = w.ticker AND r.side = w.side AND r.rn = w.rn + 1),
z0 AS (SELECT ticker, side, z, ROUND(SUM(level) / COUNT(*), 0) AS level, COUNT(DISTINCT basis) AS confluence, MAX(close) AS close FROM walk GROUP BY ticker, side, z),
zb AS (SELECT ticker, side, z, STRING_AGG(basis, ' + ' ORDER BY f) AS basis FROM (SELECT ticker, side, z, basis, MIN(rn) AS f FROM walk GROUP BY ticker, side, z, basis) GROUP BY ticker, side, z),
zones AS (SELECT z0.ticker, z0.side, z0.level, confluence, basis, CAST(ROUND(CAST(ABS(z0.level - close) / close * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS distance_pct FROM z0 JOIN zb USING (ticker, side, z))"""
POSITION = """
sr AS (SELECT b.ticker, b.date, b.close, MAX(level) FILTER (side = 'support') AS support, MIN(level) FILTER (side = 'resistance') AS resistance FROM b LEFT JOIN zones z ON b.ticker = z.ticker WHERE b.k = 1 GROUP BY ALL),
pos AS (SELECT *, CASE WHEN resistance > support THEN CAST(ROUND(CAST((close - support) / (resistance - support) * 100 AS DECIMAL(28,8)), 1) AS DOUBLE) END AS pct_in_band FROM sr),
placed AS (SELECT ticker, date, ROUND(close, 6) AS close, support, resistance, pct_in_band, CASE WHEN support IS NULL AND resistance IS NULL THEN 'no_levels' WHEN resistance IS NULL THEN 'above_all_levels' WHEN support IS NULL THEN 'below_all_levels'
  WHEN pct_in_band IS NULL THEN 'degenerate_band' WHEN pct_in_band >= 75 THEN 'testing_resistance' WHEN pct_in_band <= 25 THEN 'testing_support' ELSE 'mid_band' END AS reading FROM pos)"""
LEVELS = (recurrence(EMAS), SWINGS, EXTREMES, BANDS, MEANS, CANDIDATES, ZONES)


def level_sql(select: str, n: int = LOOKBACK, *more: str) -> str:
    return q(select, BARS, back(n), *LEVELS, *more)


# horizons

WEEKLY = f"""
w0 AS (SELECT ticker, date_trunc('week', date) AS wk, MAX(date) AS date, ARG_MAX(close, date) AS close FROM b GROUP BY ticker, wk),
w1 AS (SELECT ticker, date, close, {lag("close")} AS p FROM w0),
wb AS (SELECT ticker, date, close, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS i, COUNT(*) OVER (PARTITION BY ticker) AS n FROM w1 WHERE p IS NOT NULL),
wm AS (SELECT ticker, w20, w50 FROM (SELECT ticker, i, n, {over(20, AVG)} AS w20, {over(50, AVG)} AS w50 FROM wb) WHERE i = n)"""
W_EMA = renamed(recurrence((12, 26), "wb"), seeded="wseeded", ema="wema", r="wr_")
W_MACD = renamed(macd(), line="wline", lined="wlined", sig="wsig", macd="wmacd", ema="wema")
W_RSI = renamed(rsi(14, "wb"), moved="wmoved", moves="wmoves", wild="wwild", rsi="wrsi")
_FOREIGN = ", ".join(f"CAST(ROUND(CAST(SUM({NET}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / 1e9 AS DECIMAL(28,8)), 2) AS DOUBLE) AS f{n}" for n in (20, 60, 120))
FEATURES = f"""
d0 AS (SELECT ticker, date, k, close, {", ".join(f"{over(n, AVG)} AS sma_{n}" for n in (20, 50, 100, 200))}, {", ".join(f"{_percentile(n)} AS p{n}" for n in (20, 60, 126))}, {_FOREIGN}, {over(5, AVG, of="imb")} AS imb, SIGN(close - {lag("close")}) AS last_move,
  (close - {lag("close", 60)}) / {lag("close", 60)} * 100 AS p60c, obv - {lag("obv", 60)} AS o60, close / {lag("close", 120)} - 1 AS r120, close / {lag("close", 250)} - 1 AS r250
  FROM (SELECT *, CASE WHEN buy_volume + sell_volume <> 0 THEN CAST(buy_volume - sell_volume AS DOUBLE) / (buy_volume + sell_volume) END AS imb FROM ob)),
cx AS (SELECT ticker, date, sma_20, sma_50, sma_200, CASE WHEN sma_50 IS NOT NULL THEN sma_20 > sma_50 END AS a1, CASE WHEN sma_200 IS NOT NULL THEN sma_50 > sma_200 END AS a2 FROM d0),
cy AS (SELECT *, {lag("a1")} AS q1, {lag("a2")} AS q2 FROM cx),
cross_ AS (SELECT ticker, ARG_MAX(CASE WHEN a1 THEN 1 ELSE -1 END, date) FILTER (a1 <> q1) AS c1, ARG_MAX(CASE WHEN a2 THEN 1 ELSE -1 END, date) FILTER (a2 <> q2) AS c2 FROM cy GROUP BY ticker),
feat AS (SELECT d.*, e.e12 AS ema_12, rsi.v AS rsi, macd.h AS macd, c1, c2, w20, w50, wrsi.v AS w_rsi, wmacd.h AS w_macd
  FROM d0 d JOIN ema e ON d.ticker = e.ticker AND d.date = e.date LEFT JOIN rsi ON rsi.ticker = d.ticker AND rsi.date = d.date LEFT JOIN macd ON macd.ticker = d.ticker AND macd.date = d.date
  LEFT JOIN cross_ x ON x.ticker = d.ticker LEFT JOIN wm ON wm.ticker = d.ticker LEFT JOIN wrsi ON wrsi.ticker = d.ticker AND wrsi.i = wrsi.n LEFT JOIN wmacd ON wmacd.ticker = d.ticker AND wmacd.i = wmacd.n WHERE d.k = 1)"""


def _structure(*m: str) -> str:
    have = " + ".join(f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END" for x in m)
    above = " + ".join(f"CASE WHEN close > {x} THEN 1 ELSE 0 END" for x in m)
    return f"CASE WHEN {have} = 0 THEN NULL WHEN {above} = {have} THEN 1 WHEN {above} = 0 THEN -1 ELSE 0 END"


def _rsi(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 70 OR {x} <= 30 THEN 0 WHEN {x} >= 55 THEN 1 WHEN {x} <= 45 THEN -1 ELSE 0 END"


def _pct3(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN ROUND(CAST({x} AS DECIMAL(28,8)), 3) >= 0.7 THEN 1 WHEN ROUND(CAST({x} AS DECIMAL(28,8)), 3) <= 0.3 THEN -1 ELSE 0 END"


def _sign(x: str) -> str:
    return f"CAST(SIGN({x}) AS INT)"


_SQL = {
    "short_term": {"structure": _structure("ema_12", "sma_20"), "rsi": _rsi("rsi"), "macd": _sign("macd"), "percentile_20": _pct3("p20"), "foreign_20": _sign("f20"), "imbalance": "CASE WHEN imb IS NULL THEN NULL WHEN imb > 0.05 THEN 1 WHEN imb < -0.05 THEN -1 ELSE 0 END", "streak": _sign("last_move")},
    "mid_term": {"structure": _structure("sma_20", "sma_50", "sma_100"), "cross_20_50": "c1", "rsi": _rsi("rsi"), "macd": _sign("macd"), "percentile_60": _pct3("p60"), "foreign_60": _sign("f60"), "obv_60": "CASE WHEN p60c IS NULL OR o60 IS NULL THEN NULL WHEN p60c > 2 AND o60 < -1000000 THEN -1 WHEN p60c < -2 AND o60 > 1000000 THEN 1 ELSE 0 END", "weekly_sma20": "CASE WHEN w20 IS NULL THEN NULL WHEN close > w20 THEN 1 ELSE -1 END"},
    "long_term": {"structure": _structure("w20", "w50"), "sma200": "CASE WHEN sma_200 IS NULL THEN NULL WHEN close > sma_200 THEN 1 ELSE -1 END", "cross_50_200": "c2", "weekly_rsi": _rsi("w_rsi"), "weekly_macd": _sign("w_macd"), "percentile_126": _pct3("p126"), "foreign_120": _sign("f120"), "return": _sign("COALESCE(r250, r120)")},
}
#: Written out here and not taken from the library, so that a wrong weight there shows.
_WEIGHTS = {
    "short_term": [("structure", 1.0), ("rsi", 0.8), ("macd", 0.8), ("percentile_20", 0.5), ("foreign_20", 0.6), ("imbalance", 0.6), ("streak", 0.3)],
    "mid_term": [("structure", 1.0), ("cross_20_50", 0.6), ("rsi", 0.6), ("macd", 0.6), ("percentile_60", 0.5), ("foreign_60", 0.7), ("obv_60", 0.4), ("weekly_sma20", 0.6)],
    "long_term": [("structure", 1.0), ("sma200", 0.9), ("cross_50_200", 0.7), ("weekly_rsi", 0.6), ("weekly_macd", 0.6), ("percentile_126", 0.5), ("foreign_120", 0.7), ("return", 0.4)],
}
COMPS = "comps AS (" + " UNION ALL ".join(f"SELECT ticker, '{h}' AS horizon, CAST({i + 1} AS BIGINT) AS ordinal, '{name}' AS component, CAST({w} AS DOUBLE) AS weight, CAST({_SQL[h][name]} AS INT) AS direction FROM feat" for h, parts in _WEIGHTS.items() for i, (name, w) in enumerate(parts)) + ")"
_BANDS = "WHEN score >= 0.5 THEN 'strong_bullish' WHEN score >= 0.25 THEN 'moderate_bullish' WHEN score >= 0.1 THEN 'lean_bullish' WHEN score >= -0.1 THEN 'neutral' WHEN score >= -0.25 THEN 'lean_bearish' WHEN score >= -0.5 THEN 'moderate_bearish'"
VERDICT = f"""
vs AS (SELECT ticker, horizon, SUM(CAST(weight AS DECIMAL(9,1))) AS allw, SUM(CAST(weight AS DECIMAL(9,1))) FILTER (direction IS NOT NULL) AS have, SUM(CAST(weight AS DECIMAL(9,1))) FILTER (direction <> 0) AS aimed, SUM(CAST(weight AS DECIMAL(9,1)) * direction) AS net,
  COUNT(*) FILTER (direction > 0) AS bullish, COUNT(*) FILTER (direction < 0) AS bearish, COUNT(*) FILTER (direction = 0) AS neutral, COUNT(*) FILTER (direction IS NULL) AS missing FROM comps GROUP BY ticker, horizon),
vt AS (SELECT *, CAST(net AS DOUBLE) / CAST(have AS DOUBLE) AS score, COALESCE(CAST(have AS DOUBLE) / CAST(allw AS DOUBLE), 0) AS coverage, COALESCE(ABS(CAST(net AS DOUBLE) / CAST(aimed AS DOUBLE)), 0) AS agreement FROM vs),
verdict AS (SELECT ticker, horizon, CASE WHEN score IS NULL THEN 'insufficient_data' {_BANDS} ELSE 'strong_bearish' END AS strength, ROUND(score, 6) AS score, ROUND(coverage, 6) AS coverage, ROUND(agreement, 6) AS agreement,
  CASE WHEN coverage >= 0.75 AND agreement >= 0.60 THEN 'cao' WHEN coverage >= 0.50 AND agreement >= 0.40 THEN 'trung bình' ELSE 'thấp' END AS confidence, bullish, bearish, neutral, missing FROM vt)"""
H500 = (BARS, back(500), recurrence((12, 26)), macd(), rsi(), OBV, WEEKLY, W_EMA, W_MACD, W_RSI, FEATURES)
BIAS = "CASE WHEN strength LIKE '%bullish' THEN 1 WHEN strength LIKE '%bearish' THEN -1 WHEN strength = 'insufficient_data' THEN NULL ELSE 0 END"


def feats(f):
    return on(500, lambda b: f(scoring.features(b)))


def comps(f):
    return feats(lambda x: f(scoring.components(x)))


def _one(horizon: str, *names: str):
    keep = ", ".join(f"'{n}'" for n in names)
    return comps(lambda c: c.where(f"horizon = '{horizon}' AND component IN ({keep})").select("ticker", "component", "direction")), q(f"SELECT ticker, component, direction FROM comps WHERE horizon = '{horizon}' AND component IN ({keep})", *H500, COMPS)


def _invalidation(b):
    v = scoring.verdicts(scoring.components(scoring.features(b)))
    return scoring.invalidation(v, levels.level_position(levels.level_clusters(levels.level_candidates(b)), b))


H_LEVELS = (BARS, back(500), recurrence(EMAS), macd(), rsi(), OBV, WEEKLY, W_EMA, W_MACD, W_RSI, FEATURES, COMPS, VERDICT, SWINGS, EXTREMES, BANDS, MEANS, CANDIDATES, ZONES, POSITION)

# comparison and screening

COMPARE = f"""
cm AS (SELECT m.ticker, m.close, {", ".join(f"m{n}" for n in (20, 50, 100, 200))}, e20, e50, e200, v AS rsi, x.m, g, h FROM means m JOIN ema e USING (ticker, date) LEFT JOIN rsi USING (ticker, date) LEFT JOIN macd x USING (ticker, date) WHERE m.k = 1),
cma AS (SELECT ticker, {", ".join(f"ROUND((close - m{n}) / m{n} * 100, 6) AS vs_sma_{n}_pct" for n in (20, 50, 100, 200))}, {", ".join(f"ROUND((close - e{n}) / e{n} * 100, 6) AS vs_ema_{n}_pct" for n in (20, 50, 200))}, ROUND(rsi, 6) AS rsi, ROUND(m, 6) AS macd, ROUND(g, 6) AS macd_signal, ROUND(h, 6) AS macd_hist, ROUND(h / close * 100, 6) AS macd_hist_pct_of_close FROM cm)"""
C250 = (BARS, back(250), recurrence(EMAS), macd(), rsi(), BANDS, MEANS, COMPARE)
S250 = """
peaks AS (SELECT *, MAX(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM b),
s52 AS (SELECT ticker, CASE WHEN COUNT(*) >= 200 THEN (ARG_MAX(close, date) - ARG_MIN(close, date)) / ARG_MIN(close, date) * 100 END AS return_pct, CASE WHEN COUNT(*) >= 200 THEN MIN(close / peak - 1) * 100 END AS max_drawdown_pct,
  CASE WHEN COUNT(*) >= 200 THEN (ARG_MAX(close, date) - MIN(close)) / MIN(close) * 100 END AS from_low_pct, CASE WHEN COUNT(*) >= 200 THEN ROUND(AVG(total_value), 2) END AS avg_value FROM peaks GROUP BY ticker)"""
_RANKS = " UNION ALL ".join(f"SELECT ticker, '{f}' AS metric, ROUND(v, 6) AS value, ROW_NUMBER() OVER (ORDER BY v DESC, ticker) AS rank, MAX(v) OVER () - MIN(v) OVER () >= {gap} AS material FROM (SELECT ticker, {'ABS' if a else ''}({f}) AS v FROM {'s52' if f in ('return_pct', 'max_drawdown_pct', 'from_low_pct') else 'cma'}) WHERE v IS NOT NULL QUALIFY COUNT(*) OVER () > 1" for f, gap, a in (("return_pct", 3, False), ("max_drawdown_pct", 3, True), ("from_low_pct", 5, False), ("vs_sma_200_pct", 2, False), ("rsi", 5, True)))
_SPLITS = " UNION ALL ".join(f"SELECT '{n}' AS metric, COALESCE(STRING_AGG(ticker, ',' ORDER BY ticker) FILTER ({c} > 0), '') AS above, COALESCE(STRING_AGG(ticker, ',' ORDER BY ticker) FILTER ({c} <= 0), '') AS below FROM cma" for n, c in (("sma_20", "vs_sma_20_pct"), ("sma_50", "vs_sma_50_pct"), ("sma_200", "vs_sma_200_pct"), ("macd_hist", "macd_hist")))
SHORT = renamed(recurrence((8, 17)), seeded="sseeded", ema="sema", r="sr_")
SHORT_MACD = renamed(macd(8, 17, 9), line="sline", lined="slined", sig="ssig", macd="smacd", ema="sema")
ONE = "CAST(ROUND(CAST({x} AS DECIMAL(28,8)), 1) AS DOUBLE)"
MOMENTUM = f"""
mo AS (SELECT b.ticker, b.n, rsi.v AS r, macd.h, macd.ph, smacd.h AS sh, d, x FROM (SELECT *, CASE WHEN m > 0 THEN (close - m) / m * 100 END AS d, CASE WHEN i > 20 THEN total_volume / av END AS x FROM (SELECT *, {over(20, AVG)} AS m, {over(20, AVG, of="total_volume", prior=True)} AS av FROM b)) b
  LEFT JOIN rsi USING (ticker, date) LEFT JOIN macd USING (ticker, date) LEFT JOIN smacd USING (ticker, date) WHERE b.k = 1),
smo AS (SELECT ticker, CASE WHEN n < 20 THEN 0 ELSE {ONE.format(x='''CASE WHEN d > 0 THEN LEAST(25, 20 + LEAST(5, d)) ELSE 0 END + CASE WHEN r BETWEEN 50 AND 70 THEN 25 WHEN r > 70 AND r <= 80 THEN 15 WHEN r >= 45 AND r < 50 THEN 10 ELSE 0 END
  + CASE WHEN x >= 1.5 THEN 25 WHEN x >= 1.2 THEN 20 WHEN x >= 1 THEN 10 ELSE 0 END + CASE WHEN n >= 34 THEN CASE WHEN ph <= 0 AND h > 0 THEN 25 WHEN h > 0 THEN 20 ELSE 0 END WHEN sh > 0 THEN 20 ELSE 0 END''')} END AS score FROM mo)"""
M100 = (BARS, back(100), recurrence((12, 26)), macd(), SHORT, SHORT_MACD, rsi(), MOMENTUM)
OVERSOLD = f"""
os AS (SELECT b.ticker, n, v AS r, close AS c, open AS o, high AS h, low AS l, bottom, po, c1, c2 FROM (SELECT *, MIN(close) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS bottom, {lag("open")} AS po, {lag("close")} AS c1, {lag("close", 2)} AS c2 FROM b) b LEFT JOIN rsi USING (ticker, date, n) WHERE k = 1)"""
SCAN5 = """
sc AS (SELECT ticker, COUNT(*) AS sessions, ROUND(SUM(foreign_buy_value) - SUM(foreign_sell_value), 2) AS net_value, CAST(SUM(foreign_buy_volume) - SUM(foreign_sell_volume) AS BIGINT) AS net_volume,
  CAST(ROUND(CAST(SUM(foreign_buy_value) / SUM(total_value) * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS buy_participation_pct, CAST(ROUND(CAST(SUM(foreign_sell_value) / SUM(total_value) * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS sell_participation_pct, ARG_MAX(foreign_room, date) AS room FROM b WHERE k <= 5 GROUP BY ticker)"""


def scan5(f):
    return on(20, lambda b: f(scoring.foreign_scan(b, 5)))


TREND = "CASE WHEN sma_20 IS NULL OR sma_50 IS NULL THEN 'insufficient_data' WHEN close > sma_20 AND sma_20 > sma_50 AND (sma_200 IS NULL OR sma_50 > sma_200) THEN IF(sma_200 IS NULL, 'bullish', 'strong_bullish') WHEN close < sma_20 AND sma_20 < sma_50 AND (sma_200 IS NULL OR sma_50 < sma_200) THEN IF(sma_200 IS NULL, 'bearish', 'strong_bearish') WHEN sma_200 IS NULL THEN IF(close > sma_50, 'weak_bullish', 'weak_bearish') WHEN close > sma_200 THEN IF(close > sma_20, 'moderate_bullish', 'weak_bullish') ELSE IF(close < sma_20, 'moderate_bearish', 'weak_bearish') END"
MOMENTUM_CLASS = "CASE WHEN rsi IS NULL THEN 'insufficient_data' WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE CASE WHEN rsi > 60 THEN 'bullish' WHEN rsi < 40 THEN 'bearish' ELSE 'neutral' END || CASE WHEN macd > 0 THEN '_macd_positive' WHEN macd IS NOT NULL THEN '_macd_negative' ELSE '' END END"
# values the oracles hold the package against, written out here and not taken from its tables
SCORES = """('strong_bullish', 2), ('moderate_bullish', 1), ('bullish', 1), ('weak_bullish', 0.5), ('above_long_term_ma', 0.5), ('overbought', 0.5), ('neutral', 0),
  ('insufficient_data', 0), ('oversold', -0.5), ('weak_bearish', -0.5), ('below_long_term_ma', -0.5), ('moderate_bearish', -1), ('bearish', -1), ('strong_bearish', -2)"""
COARSE = f"""
coarse AS (SELECT ticker, {TREND} AS trend, {MOMENTUM_CLASS} AS momentum, CASE WHEN imb IS NULL THEN 'unknown' WHEN imb > 0.05 THEN 'buy_side' WHEN imb < -0.05 THEN 'sell_side' ELSE 'balanced' END AS bias, CASE SIGN(f20) WHEN 1 THEN 'net_buying' WHEN -1 THEN 'net_selling' WHEN 0 THEN 'flat' ELSE 'unknown' END AS stance FROM feat),
points AS (SELECT trend, CAST(worth AS DOUBLE) AS worth FROM (VALUES {SCORES}) t(trend, worth))"""
_TOTAL = "(COALESCE(worth, 0::DOUBLE) + COALESCE((SELECT MAX(m.worth) FROM points m WHERE m.trend = split_part(momentum, '_macd_', 1)), 0::DOUBLE) * 0.6::DOUBLE + CASE WHEN ends_with(momentum, '_macd_positive') THEN 0.3::DOUBLE WHEN ends_with(momentum, '_macd_negative') THEN -0.3::DOUBLE ELSE 0::DOUBLE END + CASE bias WHEN 'buy_side' THEN 0.4::DOUBLE WHEN 'sell_side' THEN -0.4::DOUBLE ELSE 0::DOUBLE END + CASE stance WHEN 'net_buying' THEN 0.4::DOUBLE WHEN 'net_selling' THEN -0.4::DOUBLE ELSE 0::DOUBLE END)"
STRENGTH = f"CASE WHEN {_TOTAL} >= 2.0::DOUBLE THEN 'strong_bullish' WHEN {_TOTAL} >= 1.0::DOUBLE THEN 'moderate_bullish' WHEN {_TOTAL} >= 0.3::DOUBLE THEN 'lean_bullish' WHEN {_TOTAL} > -0.3::DOUBLE THEN 'neutral' WHEN {_TOTAL} > -1.0::DOUBLE THEN 'lean_bearish' WHEN {_TOTAL} > -2.0::DOUBLE THEN 'moderate_bearish' ELSE 'strong_bearish' END"
WORDS = """(VALUES ('aligned_uptrend', 'xu hướng tăng đồng thuận (giá trên SMA20 trên SMA50 trên SMA200)'),
  ('aligned_downtrend', 'xu hướng giảm đồng thuận (giá dưới SMA20 dưới SMA50 dưới SMA200)'), ('above_sma200_transitional', 'đã vượt lên trên đường trung bình 200 phiên'),
  ('below_sma200_transitional', 'vẫn nằm dưới đường trung bình 200 phiên'), ('short_term_uptrend', 'xu hướng tăng ngắn hạn'), ('short_term_downtrend', 'xu hướng giảm ngắn hạn'),
  ('transitional', 'chuyển tiếp'), ('overbought', 'vùng quá mua'), ('oversold', 'vùng quá bán'), ('bullish', 'tích cực'), ('bearish', 'tiêu cực'), ('neutral', 'trung tính')) {0}(label, vi)"""


OWN_LEVELS = """
own AS (SELECT ticker, close, unnest([{'h': 'short_term', 'b': 'EMA12', 'o': 1, 'v': ema_12}, {'h': 'short_term', 'b': 'SMA20', 'o': 2, 'v': sma_20}, {'h': 'short_term', 'b': 'SMA50', 'o': 3, 'v': sma_50},
  {'h': 'mid_term', 'b': 'SMA20', 'o': 1, 'v': sma_20}, {'h': 'mid_term', 'b': 'SMA50', 'o': 2, 'v': sma_50}, {'h': 'mid_term', 'b': 'SMA100', 'o': 3, 'v': sma_100}, {'h': 'mid_term', 'b': 'SMA200', 'o': 4, 'v': sma_200},
  {'h': 'long_term', 'b': 'SMA200_daily', 'o': 1, 'v': sma_200}, {'h': 'long_term', 'b': 'SMA20_weekly', 'o': 2, 'v': w20}, {'h': 'long_term', 'b': 'SMA50_weekly', 'o': 3, 'v': w50}], recursive := true) FROM feat),
os AS (SELECT ticker, h, FIRST(ROUND(v, 0) ORDER BY ROUND(v, 0) DESC, o) AS l, FIRST(b ORDER BY ROUND(v, 0) DESC, o) AS b FROM own WHERE v > 0 AND v < close GROUP BY ticker, h),
orr AS (SELECT ticker, h, FIRST(ROUND(v, 0) ORDER BY ROUND(v, 0), o) AS l, FIRST(b ORDER BY ROUND(v, 0), o) AS b FROM own WHERE v > 0 AND v >= close GROUP BY ticker, h),
zs AS (SELECT ticker, MAX(level) AS l, ARG_MAX(basis, level) AS b FROM zones WHERE side = 'support' GROUP BY ticker),
zr AS (SELECT ticker, MIN(level) AS l, ARG_MIN(basis, level) AS b FROM zones WHERE side = 'resistance' GROUP BY ticker),
views AS (SELECT v.ticker, v.horizon, strength, confidence, missing, COALESCE(os.l, zs.l) AS support, COALESCE(os.b, zs.b) AS support_basis, COALESCE(orr.l, zr.l) AS resistance, COALESCE(orr.b, zr.b) AS resistance_basis,
  CAST(CAST(zs.l AS BIGINT) AS VARCHAR) || ' (' || zs.b || ')' AS zst, CAST(CAST(zr.l AS BIGINT) AS VARCHAR) || ' (' || zr.b || ')' AS zrt
  FROM verdict v LEFT JOIN os ON os.ticker = v.ticker AND os.h = v.horizon LEFT JOIN orr ON orr.ticker = v.ticker AND orr.h = v.horizon LEFT JOIN zs ON zs.ticker = v.ticker LEFT JOIN zr ON zr.ticker = v.ticker)"""
TO_WATCH = """
SELECT ticker, horizon, side, ROW_NUMBER() OVER (PARTITION BY ticker, horizon, side ORDER BY IF(side = 'support', -level, level), o) AS ordinal, basis, level, distance_pct
FROM (SELECT ticker, h AS horizon, IF(v < close, 'support', 'resistance') AS side, o, b AS basis, ROUND(v, 0) AS level, CAST(ROUND(CAST(ABS(v - close) / close * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS distance_pct FROM own WHERE v > 0)"""
PERSPECTIVES = f"""
SELECT ticker, horizon, replace(strength, '_', ' ') || ', confidence ' || confidence AS state, support, support_basis, resistance, resistance_basis,
  CASE WHEN bias > 0 THEN COALESCE('close above ' || r, 'above all levels') WHEN bias < 0 THEN COALESCE('close back above ' || r, 'no level above') ELSE COALESCE(r || ' or ' || s, 'no levels on both sides') END AS confirmation,
  COALESCE(CASE WHEN bias > 0 THEN 'close below ' || zst WHEN bias < 0 THEN 'close above ' || zrt END, CASE WHEN bias <> 0 THEN 'close below ' || s END, 'no direction') AS risk, missing
FROM (SELECT *, COALESCE({BIAS}, 0) AS bias, CAST(CAST(support AS BIGINT) AS VARCHAR) || ' (' || support_basis || ')' AS s, CAST(CAST(resistance AS BIGINT) AS VARCHAR) || ' (' || resistance_basis || ')' AS r FROM views)"""


QUERIES = {
    "swing_points": (on_levels(levels.swing_points), q("SELECT ticker, kind, ordinal, date, level FROM swing", BARS, B, SWINGS)),
    "close_extremes": (on_levels(levels.close_extremes), q('SELECT ticker, win AS "window", high, high_date, low, low_date FROM ext', BARS, B, EXTREMES)),
    "ma_levels": (on_levels(levels.ma_levels), q("SELECT * FROM mal", BARS, B, recurrence(EMAS), BANDS, MEANS)),
    "bollinger_levels": (on_levels(levels.bollinger_levels), q("SELECT * FROM bbl", BARS, B, recurrence(EMAS), BANDS, MEANS)),
    "level_candidates": (on_levels(lambda b: levels.level_candidates(b).drop("close")), level_sql("SELECT ticker, side, basis, level FROM cand")),
    "level_clusters": (on_levels(lambda b: levels.level_clusters(levels.level_candidates(b)).drop("close")), level_sql("SELECT * FROM zones")),
    "nearest_levels": (on_levels(lambda b: levels.nearest_levels(levels.level_clusters(levels.level_candidates(b)))), level_sql("SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, side ORDER BY CASE WHEN side = 'support' THEN -level ELSE level END) AS ordinal FROM zones QUALIFY ordinal <= 6")),
    "level_position": (on_levels(lambda b: levels.level_position(levels.level_clusters(levels.level_candidates(b)), b)), level_sql("SELECT * FROM placed", LOOKBACK, POSITION)),
    "horizon_ma_levels": (
        on_levels(levels.horizon_ma_levels),
        level_sql("SELECT ticker, side, basis, ROUND(v, 0) AS level, p AS distance_pct, ROW_NUMBER() OVER (PARTITION BY ticker, side ORDER BY p, basis) AS ordinal FROM (SELECT ticker, basis, v, CASE WHEN v < close THEN 'support' ELSE 'resistance' END AS side, CAST(ROUND(CAST(ABS(v - close) / close * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS p FROM (SELECT ticker, close, 'EMA12' AS basis, e12 AS v FROM avgs UNION ALL SELECT ticker, close, 'SMA20', m20 FROM avgs UNION ALL SELECT ticker, close, 'SMA50', m50 FROM avgs UNION ALL SELECT ticker, close, 'BB lower', lower FROM banded WHERE k = 1 AND lower < close UNION ALL SELECT ticker, close, 'BB upper', upper FROM banded WHERE k = 1 AND upper > close) WHERE v <> close) QUALIFY ordinal <= 4"),
    ),
    "daily_weekly_join": (feats(lambda f: f.selectExpr("ticker", "round(close, 6) AS close", "round(sma_20, 6) AS sma_20", "round(w_sma_20, 6) AS w_sma_20", "round(w_sma_50, 6) AS w_sma_50", "round(w_rsi, 6) AS w_rsi", "round(w_macd, 6) AS w_macd")), q("SELECT ticker, ROUND(close, 6) AS close, ROUND(sma_20, 6) AS sma_20, ROUND(w20, 6) AS w_sma_20, ROUND(w50, 6) AS w_sma_50, ROUND(w_rsi, 6) AS w_rsi, ROUND(w_macd, 6) AS w_macd FROM feat", *H500)),
    "comp_structure": (comps(lambda c: c.where("component = 'structure'").select("ticker", "horizon", "direction")), q("SELECT ticker, horizon, direction FROM comps WHERE component = 'structure'", *H500, COMPS)),
    "comp_rsi": _one("short_term", "rsi"),
    "comp_macd": _one("short_term", "macd"),
    "comp_percentile": (comps(lambda c: c.where("component LIKE 'percentile%'").select("ticker", "component", "direction")), q("SELECT ticker, component, direction FROM comps WHERE starts_with(component, 'percentile')", *H500, COMPS)),
    "comp_foreign": (comps(lambda c: c.where("component LIKE 'foreign%'").select("ticker", "component", "direction")), q("SELECT ticker, component, direction FROM comps WHERE starts_with(component, 'foreign')", *H500, COMPS)),
    "comp_crossover": (comps(lambda c: c.where("component LIKE 'cross%'").select("ticker", "component", "direction")), q("SELECT ticker, component, direction FROM comps WHERE starts_with(component, 'cross')", *H500, COMPS)),
    "comp_misc": (comps(lambda c: c.where("component IN ('imbalance', 'streak', 'obv_60', 'weekly_sma20', 'sma200', 'return')").select("ticker", "component", "direction")), q("SELECT ticker, component, direction FROM comps WHERE component IN ('imbalance', 'streak', 'obv_60', 'weekly_sma20', 'sma200', 'return')", *H500, COMPS)),
    "horizon_verdict": (comps(scoring.verdicts), q("SELECT * FROM verdict", *H500, COMPS, VERDICT)),
    "horizon_conflicts": (comps(scoring.conflicts), q("SELECT u.ticker, u.horizon, ROW_NUMBER() OVER (PARTITION BY u.ticker, u.horizon ORDER BY u.weight + d.weight DESC, u.ordinal, d.ordinal) AS ordinal, u.component AS bullish, d.component AS bearish, ROUND(u.weight + d.weight, 2) AS combined_weight FROM comps u JOIN comps d ON u.ticker = d.ticker AND u.horizon = d.horizon WHERE u.direction = 1 AND d.direction = -1 AND u.weight >= 0.5 AND d.weight >= 0.5 QUALIFY ROW_NUMBER() OVER (PARTITION BY u.ticker, u.horizon ORDER BY ROUND(u.weight + d.weight, 2) DESC, u.ordinal, d.ordinal) <= 3", *H500, COMPS).replace("ORDER BY u.weight + d.weight DESC", "ORDER BY ROUND(u.weight + d.weight, 2) DESC")),
    "invalidation": (on(500, _invalidation), q(f"SELECT v.ticker, horizon, CASE WHEN bias > 0 THEN support WHEN bias < 0 THEN resistance END AS level, CASE WHEN bias = 0 THEN resistance END AS upper_level, CASE WHEN bias = 0 THEN support END AS lower_level FROM (SELECT *, COALESCE({BIAS}, 0) AS bias FROM verdict) v JOIN placed p ON v.ticker = p.ticker", *H_LEVELS)),
    "horizon_alignment": (
        comps(lambda c: scoring.alignment(scoring.verdicts(c))),
        q(f"SELECT ticker, CASE WHEN scored = 0 THEN 'insufficient_data' WHEN bulls = scored THEN 'all_bullish' WHEN bears = scored THEN 'all_bearish' WHEN bulls > 0 AND bears > 0 THEN 'conflicting' WHEN bulls > 0 THEN 'mostly_bullish' WHEN bears > 0 THEN 'mostly_bearish' ELSE 'all_neutral' END AS label, bulls, bears, neutrals, scored, CASE COALESCE(CASE WHEN bulls > bears THEN ru WHEN bears > bulls THEN rd ELSE rn END, ra) WHEN 2 THEN 'cao' WHEN 1 THEN 'trung bình' ELSE 'thấp' END AS confidence FROM (SELECT ticker, COUNT(*) FILTER (s = 1) AS bulls, COUNT(*) FILTER (s = -1) AS bears, COUNT(*) FILTER (s = 0) AS neutrals, COUNT(s) AS scored, MIN(r) AS ra, MIN(r) FILTER (s = 1) AS ru, MIN(r) FILTER (s = -1) AS rd, MIN(r) FILTER (s = 0) AS rn FROM (SELECT ticker, {BIAS} AS s, CASE confidence WHEN 'cao' THEN 2 WHEN 'trung bình' THEN 1 ELSE 0 END AS r FROM verdict) GROUP BY ticker)", *H500, COMPS, VERDICT),
    ),
    "classify_trend": (feats(scoring.classify_trend), q(f"SELECT ticker, {TREND} AS trend FROM feat", *H500)),
    "classify_momentum": (feats(scoring.classify_momentum), q(f"SELECT ticker, {MOMENTUM_CLASS} AS momentum FROM feat", *H500)),
    "signal_strength": (feats(scoring.signal_strength), q(f"SELECT ticker, trend, momentum, bias, stance, {STRENGTH} AS signal_strength FROM (SELECT * FROM coarse LEFT JOIN points p USING (trend))", *H500, COARSE)),
    "label_wording": (
        on_levels(lambda b: labels.with_wording(trend.trend_alignment(b).join(momentum.rsi(b).select("ticker", "zone"), "ticker").join(volatility.bollinger_squeeze(b).select("ticker", "squeeze"), "ticker").drop("date"))),
        f"SELECT a.ticker, alignment, zone, squeeze, w.vi AS alignment_vi, v.vi AS zone_vi, CASE WHEN squeeze THEN 'dải Bollinger đang co hẹp' WHEN NOT squeeze THEN 'dải Bollinger nới rộng bình thường' END AS squeeze_vi FROM ({INDICATORS['trend_alignment'][1]}) a JOIN ({INDICATORS['rsi'][1]}) r USING (ticker) JOIN ({INDICATORS['bollinger_squeeze'][1]}) s USING (ticker) LEFT JOIN {WORDS.format('w')} ON w.label = alignment LEFT JOIN {WORDS.format('v')} ON v.label = zone",
    ),
    "compare_52w": (
        lambda spark, d: scoring.compare_52w(bars_1d(spark, d)).select("ticker", "window_sessions", "excluded", "return_pct", "max_drawdown_pct", "from_low_pct"),
        q("SELECT ticker, n AS window_sessions, n < 10 AS excluded, ROUND(return_pct, 6) AS return_pct, ROUND(max_drawdown_pct, 6) AS max_drawdown_pct, ROUND(from_low_pct, 6) AS from_low_pct FROM s52 JOIN (SELECT ticker, COUNT(*) AS n FROM b GROUP BY ticker) USING (ticker)", BARS, back(250), S250),
    ),
    "compare_ma": (on(250, scoring.compare_ma), q("SELECT * FROM cma", *C250)),
    "compare_levels": (on(250, scoring.compare_levels), level_sql("SELECT * EXCLUDE (date) FROM placed", 250, POSITION)),
    "rank_observation": (on(250, scoring.rank_observations), q(_RANKS, *C250, S250)),
    "relative_assessment": (on(250, scoring.relative_assessment), q(f"SELECT * FROM ({_SPLITS}) WHERE above <> '' AND below <> '' UNION ALL SELECT 'turnover', CASE WHEN MAX(avg_value) >= 1.3 * MIN(avg_value) THEN LAST(ticker ORDER BY avg_value, ticker) ELSE '' END, CASE WHEN MAX(avg_value) >= 1.3 * MIN(avg_value) THEN FIRST(ticker ORDER BY avg_value, ticker) ELSE '' END FROM s52", *C250, S250)),
    "screen_momentum": (on(100, scoring.screen_momentum), q("SELECT * FROM smo", *M100)),
    "screen_oversold": (
        on(100, scoring.screen_oversold),
        q("SELECT ticker, CASE WHEN n < 15 THEN 0 ELSE CASE WHEN r < 30 THEN 35 WHEN r < 35 THEN 25 WHEN r < 40 THEN 15 ELSE 0 END + CASE WHEN (c - bottom) / bottom * 100 <= 2.5 THEN 35 WHEN (c - bottom) / bottom * 100 <= 5 THEN 20 ELSE 0 END + CASE WHEN h > l THEN CASE WHEN LEAST(o, c) - l >= 2 * ABS(c - o) AND h - GREATEST(o, c) <= 0.25 * (h - l) AND LEAST(o, c) - l > 0.4 * (h - l) THEN 30 WHEN po IS NOT NULL AND c1 < po AND c > o AND o <= c1 AND c >= po THEN 30 WHEN ABS(c - o) / (h - l) <= 0.1 THEN 20 WHEN po IS NOT NULL AND c > o THEN 10 ELSE 0 END WHEN c1 < c2 AND c > c1 THEN CASE WHEN (c - c1) / c1 * 100 >= 1 THEN 25 ELSE 10 END ELSE 0 END END::DOUBLE AS score FROM os", BARS, back(100), rsi(), OVERSOLD),
    ),
    "screen_foreign": (on(100, scoring.screen_foreign), q("SELECT ticker, CASE WHEN sessions < 5 THEN 0 ELSE CASE WHEN net_value <= 0 THEN 0 WHEN ROUND(net_value / 1e9, 2) >= 50 THEN 40 WHEN ROUND(net_value / 1e9, 2) >= 10 THEN 30 ELSE 20 END + CASE WHEN buy_participation_pct >= 25 THEN 35 WHEN buy_participation_pct >= 15 THEN 25 WHEN buy_participation_pct >= 8 THEN 15 ELSE 0 END + CASE WHEN room > 1000000 THEN 25 WHEN room > 200000 THEN 15 WHEN room > 0 THEN 5 ELSE 0 END END::DOUBLE AS score FROM sc", BARS, back(100), SCAN5)),
    "screen_intraday": (
        lambda spark, d: scoring.screen_intraday(sessions.hourly_bars(snapshots(spark, d))),
        q(f"SELECT ticker, CASE WHEN n < 2 THEN 0 ELSE {ONE.format(x='CASE WHEN c > top THEN LEAST(45, 35 + LEAST(10, (c - top) / top * 500)) ELSE 0 END + CASE WHEN v / mv >= 1.5 OR mv = 0 AND FALSE THEN 35 WHEN v / mv >= 1.2 THEN 25 WHEN COALESCE(v / NULLIF(mv, 0), 1) >= 1 THEN 10 ELSE 0 END + CASE WHEN c > o THEN 20 ELSE 0 END')} END AS score FROM (SELECT ticker, MAX(n) AS n, MAX(high) FILTER (i <= LEAST(2, n - 1)) AS top, AVG(volume) FILTER (i <= LEAST(2, n - 1)) AS mv, ARG_MAX(close, i) AS c, ARG_MAX(volume, i) AS v, ARG_MIN(open, i) AS o FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY datetime) AS i, COUNT(*) OVER (PARTITION BY ticker) AS n FROM hours h WHERE date = (SELECT MAX(date) FROM hours x WHERE x.ticker = h.ticker)) GROUP BY ticker)", HOURS),
    ),
    "screen_details": (
        on(100, scoring.screen_details),
        q(f"SELECT ticker, date, total_volume, ROUND(total_value, 2) AS total_value, ROUND(COALESCE((buy_volume - sell_volume) / NULLIF(CAST(buy_volume + sell_volume AS DOUBLE), 0), 0), 6) AS imbalance, ROUND({NET}, 2) AS foreign_net_value, ROUND(net5, 2) AS foreign_net_value_5d, foreign_room, ROUND(lo, 6) AS support, ROUND(hi, 6) AS resistance, ROUND((close - lo) / lo * 100, 6) AS to_support_pct, ROUND((hi - close) / hi * 100, 6) AS to_resistance_pct, ROUND(v, 6) AS volatility_pct, ROUND(v / 8, 6) AS stop_pct FROM (SELECT *, CASE WHEN n >= 10 AND sd IS NOT NULL THEN sd * 100 * SQRT(252) ELSE 25 END AS v FROM (SELECT *, MIN(close) OVER w AS lo, MAX(close) OVER w AS hi, STDDEV_SAMP(r) OVER w AS sd, SUM({NET}) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) AS net5 FROM (SELECT *, LN(close / {lag('close')}) AS r FROM b) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING))) WHERE k = 1", BARS, back(100)),
    ),
    "screen_and_rank": (on(100, lambda b: scoring.screen_and_rank(scoring.screen_momentum(b), b, 5)), q("SELECT ROW_NUMBER() OVER (ORDER BY score DESC, change_pct DESC, ticker) AS rank, ticker, score, change_pct FROM (SELECT s.ticker, score, CAST(ROUND(CAST((close - prev_close) / prev_close * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) AS change_pct FROM smo s JOIN b ON s.ticker = b.ticker AND b.k = 1) QUALIFY rank <= 5", *M100)),
    "foreign_scan_agg": (scan5(lambda s: s), q("SELECT * FROM sc", BARS, back(20), SCAN5)),
    "foreign_top_buyers": (scan5(lambda s: scoring.foreign_top(s, 5, True)), q("SELECT ROW_NUMBER() OVER (ORDER BY net_value DESC, ticker) AS rank, ticker, net_value, net_volume, room FROM sc WHERE net_value > 0 OR (SELECT MAX(net_value) FROM sc) <= 0 QUALIFY rank <= 5", BARS, back(20), SCAN5)),
    "foreign_top_sellers": (scan5(lambda s: scoring.foreign_top(s, 5, False)), q("SELECT ROW_NUMBER() OVER (ORDER BY net_value, ticker) AS rank, ticker, net_value, net_volume, room FROM sc WHERE net_value < 0 OR (SELECT MIN(net_value) FROM sc) >= 0 QUALIFY rank <= 5", BARS, back(20), SCAN5)),
    "room_warnings": (scan5(lambda s: scoring.room_warnings(s, 9_999_990)), q("SELECT ticker, room FROM sc WHERE room < 9999990", BARS, back(20), SCAN5)),
    "multi_horizon": (on(500, report.multi_horizon), q("SELECT * FROM verdict JOIN placed USING (ticker)", *H_LEVELS)),
    "perspectives": (on(500, report.perspectives), q(PERSPECTIVES, *H_LEVELS, OWN_LEVELS)),
    "levels_to_watch": (feats(report.levels_to_watch), q(TO_WATCH, *H_LEVELS, OWN_LEVELS)),
    "compare_pivot": (on(250, report.compare_pivot), q("SELECT c.*, FALSE AS excluded, ROUND(return_pct, 6) AS return_pct, ROUND(max_drawdown_pct, 6) AS max_drawdown_pct, ROUND(from_low_pct, 6) AS from_low_pct, p.close, support, resistance, pct_in_band, reading FROM cma c JOIN s52 ON c.ticker = s52.ticker JOIN placed p ON c.ticker = p.ticker", *C250, S250, SWINGS, EXTREMES, CANDIDATES, ZONES, POSITION)),
}
