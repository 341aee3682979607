"""Indicators against plain Python formulas and small literal series."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from candela.operators import flow, levels, momentum, trend, volatility, weekly
from candela.plans import report, scoring

FIELDS = "ticker string, date date, prev_close double, open double, high double, low double, close double, total_trade long, total_value double, total_volume long, buy_count long, sell_count long, buy_volume long, sell_volume long, foreign_buy_volume long, foreign_sell_volume long, foreign_buy_value double, foreign_sell_value double, foreign_room long"


def bars(spark, closes, ticker="T", **more):
    """Daily bars of a series of closes; keyword lists replace other columns."""
    rows = []
    for i, c in enumerate(closes):
        row = {
            "ticker": ticker, "date": datetime.date(2024, 1, 1) + datetime.timedelta(days=i), "prev_close": closes[i - 1] if i else c, "open": c, "high": c + 1, "low": c - 1, "close": c, "total_trade": 10,
            "total_value": c * 100, "total_volume": 100, "buy_count": 6, "sell_count": 4, "buy_volume": 60, "sell_volume": 40, "foreign_buy_volume": 5, "foreign_sell_volume": 3,
            "foreign_buy_value": 5 * c, "foreign_sell_value": 3 * c, "foreign_room": 1000 - 2 * i,
        }
        rows.append(tuple((row | {k: v[i] for k, v in more.items()}).values()))
    return spark.createDataFrame(rows, FIELDS)


def py_ema(x, n):
    if len(x) < n:
        return []
    out = [sum(x[:n]) / n]
    for v in x[n:]:
        out.append(v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
    return out


def py_wilder(x, n):
    a = sum(x[:n]) / n
    for v in x[n:]:
        a = (a * (n - 1) + v) / n
    return a


@pytest.fixture(scope="module")
def walk():
    rng = random.Random(11)
    x = [100.0]
    for _ in range(299):
        x.append(max(20.0, x[-1] + rng.gauss(0, 2)))
    return x


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_recurrences(spark, walk):
    b = bars(spark, walk)
    e = one(trend.ema(b))
    assert all(math.isclose(e[f"ema_{n}"], py_ema(walk, n)[-1], abs_tol=1e-6) for n in trend.EMA_WINDOWS)
    line = [a - c for a, c in zip(py_ema(walk, 12)[14:], py_ema(walk, 26))]
    signal = py_ema(line, 9)
    m = one(trend.macd(b))
    assert math.isclose(m.macd, line[-1], abs_tol=1e-6) and math.isclose(m.signal, signal[-1], abs_tol=1e-6) and math.isclose(m.histogram, line[-1] - signal[-1], abs_tol=1e-6)
    d = [b_ - a for a, b_ in zip(walk, walk[1:])]
    gain, loss = py_wilder([max(x, 0) for x in d], 14), py_wilder([max(-x, 0) for x in d], 14)
    assert math.isclose(one(momentum.rsi(b)).rsi, 100 - 100 / (1 + gain / loss), abs_tol=1e-6)
    tr = [max(2, abs(c + 1 - p), abs(c - 1 - p)) for c, p in zip(walk, [walk[0], *walk])]
    assert math.isclose(one(volatility.atr(b)).atr, py_wilder(tr, 14), abs_tol=1e-6)


def test_flat_series(spark):
    b = bars(spark, [50.0] * 25)
    assert one(momentum.rsi(b)).rsi == 50 and one(momentum.close_percentile(b)).percentile == 0.5 and one(volatility.bollinger_position(b)).position == "middle"
    assert one(momentum.return_streak(b)).streak == 0 and levels.swing_points(b).count() == 0


def test_rising_series(spark):
    b = bars(spark, [float(i) for i in range(1, 41)])
    assert one(momentum.rsi(b)).rsi == 100 and one(momentum.return_streak(b)).streak == 39 and one(trend.macd(b)).macd > 0


@pytest.mark.parametrize("n,there,cross", [(33, False, "unknown"), (34, True, "unknown"), (35, True, None)])
def test_macd_needs_34_rows(spark, walk, n, there, cross):
    b = bars(spark, walk[:n])
    m = one(trend.macd(b))
    assert (m.macd is not None) == there and m.required == 34 and m.available == n
    assert cross is None or one(trend.macd_crossover(b)).crossover == cross


def test_insufficient_rows_give_nulls(spark, walk):
    b = bars(spark, walk[:3])
    assert one(momentum.rsi(b)).rsi is None and one(volatility.atr(b)).atr is None and one(momentum.stochastic(b)).k is None
    assert all(v is None for k, v in one(trend.ema(b)).asDict().items() if k.startswith("ema"))
    assert levels.close_extremes(b).count() == 0


def test_ties_take_the_earliest_date(spark):
    b = bars(spark, [5.0, 9.0, 3.0, 9.0, 3.0] * 4)
    x = one(levels.close_extremes(b, (20,)))
    assert (x.high_date.day, x.low_date.day) == (2, 3)
    s = one(weekly.stats_52w(b, required=20))
    assert (s.high_date.day, s.low_date.day) == (2, 3) and not s.is_full


def test_unadjusted_split_refuses_obv(spark, walk):
    prev = [walk[0], *walk[:-1]]
    prev[20] *= 2
    b = bars(spark, walk[:40], prev_close=prev)
    assert one(flow.obv(b)).obv is None and flow.prev_close_mismatch(b).count() == 1 and one(flow.data_quality(b)).warn_action
    assert one(flow.obv(bars(spark, walk[:40]))).obv is not None


def test_halted_days(spark, walk):
    zero = [0 if 10 <= i < 12 else 60 for i in range(30)]
    b = bars(spark, walk[:30], buy_volume=zero, sell_volume=zero, total_volume=[2 * z for z in zero])
    assert flow.zero_volume_days(b).count() == 2 and one(flow.volume_imbalance(b)).imbalance == 0


def test_missing_high_makes_atr_insufficient(spark, walk):
    high = [c + 1 for c in walk[:30]]
    high[16] = None
    assert one(volatility.atr(bars(spark, walk[:30], high=high))).atr is None


def test_clusters_are_anchored(spark):
    rows = [("T", "resistance", f"b{i}", x, 90.0) for i, x in enumerate([100.0, 100.5, 100.9, 101.6, 102.0])]
    zones = levels.level_clusters(spark.createDataFrame(rows, "ticker string, side string, basis string, level double, close double")).collect()
    assert sorted((z.level, z.confluence) for z in zones) == [(100.0, 2), (101.0, 2), (102.0, 1)]


def test_verdict_counts_missing_components(spark):
    rows = [("T", "short_term", i, f"c{i}", w, d) for i, (w, d) in enumerate([(1.0, 1), (0.5, None), (0.5, -1)])]
    v = one(scoring.verdicts(spark.createDataFrame(rows, "ticker string, horizon string, ordinal long, component string, weight double, direction int")))
    assert v.strength == "moderate_bullish" and v.coverage == 0.75 and math.isclose(v.agreement, 1 / 3, abs_tol=1e-6) and v.confidence == scoring.LOW and v.missing == 1


def test_screen_ties_keep_universe_order(spark):
    b = bars(spark, [10.0] * 30, "B").unionByName(bars(spark, [10.0] * 30, "A"))
    s = scoring.screen_momentum(b)
    assert [r.ticker for r in scoring.screen_and_rank(s, b, 2).orderBy("rank").collect()] == ["A", "B"]


def test_one_exchange_serves_all_windows(spark, walk):
    df = bars(spark, walk[:50]).repartition(3)
    out = trend.sma(df).withColumn("k", F.lit(1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1


def test_signal_strength_of_all_combinations(spark):
    import itertools

    def expected(trend_, momentum_, side, stance):
        base = momentum_.split("_macd_")[0]
        total = scoring.POINTS.get(trend_, 0) + scoring.POINTS.get(base, 0) * 0.6
        total += 0.3 if momentum_.endswith("_positive") else -0.3 if momentum_.endswith("_negative") else 0
        total += {"buy_side": 0.4, "sell_side": -0.4}.get(side, 0)
        total += {"net_buying": 0.4, "net_selling": -0.4}.get(stance, 0)
        up = [(2.0, "strong_bullish"), (1.0, "moderate_bullish"), (0.3, "lean_bullish")]
        down = [(-2.0, "strong_bearish"), (-1.0, "moderate_bearish"), (-0.3, "lean_bearish")]
        return next((name for limit, name in up if total >= limit), None) or next((name for limit, name in down if total <= limit), "neutral")

    moments = [m + s for m in ("bullish", "neutral", "bearish") for s in ("", "_macd_positive", "_macd_negative")] + ["overbought", "oversold", "insufficient_data"]
    rows = list(itertools.product([*scoring.POINTS, "unheard_of"], moments, ["buy_side", "sell_side", "balanced", None], ["net_buying", "net_selling", "flat", None]))
    df = spark.createDataFrame(rows, "t string, m string, b string, s string")
    got = df.select("*", scoring.strength_of(*(F.col(c) for c in "tmbs")).alias("x")).collect()
    assert len(got) == len(rows) and all(r.x == expected(r.t, r.m, r.b, r.s) for r in got)


def test_wording_beside_labels(spark):
    from candela.functions import labels

    df = spark.createDataFrame([("flat", "flat", True, True), ("A", "no such label", False, None), ("B", None, None, None)], "ticker string, zone string, squeeze boolean, other boolean")
    out = labels.with_wording(df)
    assert out.columns == ["ticker", "zone", "squeeze", "other", "zone_vi", "squeeze_vi"]
    yes, no = labels.SWITCHES["squeeze"]
    assert [(r.zone_vi, r.squeeze_vi) for r in out.collect()] == [(labels.WORDING["flat"], yes), (None, no), (None, None)]
    assert labels.with_wording(out).columns == out.columns


def test_large_tickets_are_read_from_each_side_against_its_own_past(spark):
    days = [(i, 100, 100, 1, 1) for i in range(20)]
    for buy, sell, reading in ((130, 100, "larger_buy_tickets"), (100, 130, "larger_sell_tickets"), (140, 150, "larger_tickets_both_sides"), (120, 100, "ordinary_ticket_sizes")):
        df = spark.createDataFrame([("T", *r) for r in [*days, (20, buy, sell, 1, 1)]], "ticker string, date int, buy_volume long, sell_volume long, buy_count long, sell_count long")
        assert flow.trade_size_by_side(df).first().reading == reading


def test_levels_to_watch_by_hand(spark):
    cols = ("ticker", "close", "ema_12", "sma_20", "sma_50", "sma_100", "sma_200", "w_sma_20", "w_sma_50")
    feats = spark.createDataFrame([("A", 100.0, 99.4, 99.2, 100.0, None, 0.0, 120.0, 98.4), ("B", 10.0, *[None] * 7)], "ticker string, " + ", ".join(f"{c} double" for c in cols[1:]))
    got = sorted(tuple(r) for r in report.levels_to_watch(feats).collect())
    assert got == [
        ("A", "long_term", "resistance", 1, "SMA20_weekly", 120.0, 20.0),
        ("A", "long_term", "support", 1, "SMA50_weekly", 98.0, 1.6),
        ("A", "mid_term", "resistance", 1, "SMA50", 100.0, 0.0),
        ("A", "mid_term", "support", 1, "SMA20", 99.0, 0.8),
        ("A", "short_term", "resistance", 1, "SMA50", 100.0, 0.0),
        ("A", "short_term", "support", 1, "EMA12", 99.0, 0.6),
        ("A", "short_term", "support", 2, "SMA20", 99.0, 0.8),
    ], "equal rounded levels keep the order of the averages; null and zero averages give none"
    assert "Exchange" not in report.levels_to_watch(feats)._jdf.queryExecution().executedPlan().toString()
