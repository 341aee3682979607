"""Requests: arguments as text, fallback of the universe, hourly rows, weekly refusal, windows, series, rows in the call."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from candela import arguments
from candela.api import BARS, Engine, RequestError
from candela.functions import recurrence
from candela.operators import trend, volatility, weekly
from candela.plans import scoring
from candela.sources.projections import bars_1d, index_1d, snapshots
from candela.streaming import sessions

DAY = datetime.date(2022, 1, 3)


def bars(spark, ticker, closes, **more):
    rows = [{"ticker": ticker, "date": str(DAY + datetime.timedelta(days=i)), "close": float(c), "prev_close": float(closes[max(0, i - 1)]), "high": c + 1.0, "low": c - 1.0, "open": float(c), "total_volume": 1000, "total_value": 5.0} | {k: v[i] for k, v in more.items()} for i, c in enumerate(closes)]
    return Engine.of_rows(spark, json.dumps(rows)).bars


@pytest.mark.parametrize(
    "value,expected",
    [("trend", ["trend"]), ("trend, momentum", ["trend", "momentum"]), ('["trend", "momentum"]', ["trend", "momentum"]), ("('trend','trend')", ["trend"]), (["a", "a", " b "], ["a", "b"]), ("", None), ("[]", None), (None, None), (5, ["5"])],
)
def test_lists_as_text(value, expected):
    assert arguments.names(value) == expected


def test_scopes_and_words():
    assert [arguments.scope(x) for x in ("All", " 'short' ", "Medium-Term", "dai han", "support resistance", "levels", "x")] == ["full", "short_term", "mid_term", "long_term", "levels", "levels", "x"]
    assert arguments.word(' "FULL" ') == "full" and arguments.word("", "compact") == "compact"
    assert arguments.rows('[{"a": 1}]') == [{"a": 1}]
    with pytest.raises(ValueError):
        arguments.rows('{"a": 1}')


def test_squeeze_compares_bandwidths(spark):
    """A steadily rising price: the bands widen in money while they narrow against their middle."""
    closes = [100 + 5 * i + (0.1 if i % 2 else -0.1) * i for i in range(60)]

    def bandwidth(i):
        w = closes[i - 19 : i + 1]
        m = sum(w) / 20
        return 4 * math.sqrt(sum((x - m) ** 2 for x in w) / 20) / m

    last = [bandwidth(i) for i in range(40, 60)]
    ordered = sorted(last)
    cut = ordered[2] + 0.85 * (ordered[3] - ordered[2])
    got = volatility.bollinger_squeeze(bars(spark, "A", closes)).first()
    assert got.squeeze == (last[-1] <= cut) and abs(got.width - last[-1]) < 1e-6 and abs(got.quantile - cut) < 1e-6
    spans = [bandwidth(i) * sum(closes[i - 19 : i + 1]) / 20 for i in range(40, 60)]
    assert got.squeeze and spans[-1] == max(spans), "by the span of the bands it would be none"


def test_52_week_figures_of_short_histories(spark):
    s = lambda n: weekly.stats_52w(bars(spark, "A", [float(i + 1) for i in range(n)])).first()
    assert (s(199).high, s(199).is_full, s(199).window_sessions, s(199).required) == (None, None, 199, 200)
    assert (s(200).high, s(200).is_full) == (200.0, False) and s(239).is_full is False and s(240).is_full is True
    assert weekly.stats_52w(bars(spark, "A", [2.0] * 20), required=20).first().high == 2.0


def test_any_bad_close_refuses_volatility(spark):
    good = [10 + (i % 3) for i in range(60)]
    assert volatility.c2c_volatility(bars(spark, "A", good)).first().daily_pct is not None
    assert volatility.c2c_volatility(bars(spark, "A", [*good[:5], 0, *good[6:]])).first().daily_pct is None


def test_crossover_needs_two_rows_more_than_the_slow_mean(spark):
    closes = [100.0] * 40 + [90.0] * 10 + [400.0, 400.0]
    assert trend.sma_crossover(bars(spark, "A", closes[:51]), ((20, 50),)).first().crossover == "none"
    assert trend.sma_crossover(bars(spark, "A", closes), ((20, 50),)).first().crossover == "golden_cross"


def test_one_ticker_has_no_rank(spark):
    one = bars(spark, "A", [1.0, 2.0]).select("ticker", F.col("close").alias("x")).limit(1)
    assert scoring.rank_observation(one, "x", 1.0).count() == 0


def loop(values, n, alpha):
    out, s = [None] * len(values), None
    for i, x in enumerate(values):
        s = sum(values[:n]) / n if i == n - 1 else None if i < n else s + alpha * (x - s)
        out[i] = s
    return out


def near(a, b):
    return all((x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1, abs(y))) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("n", [1, 3, 13, 14, 1500])
def test_series_equal_a_loop_over_rows(spark, n):
    """Several blocks a year, many years, short histories, flat prices."""
    closes = [100 + 10 * math.sin(i / 5) + i % 7 for i in range(1200)] if n < 1500 else [7.0] * 1500
    df = bars(spark, "A", closes).unionByName(bars(spark, "B", closes[:n])).unionByName(bars(spark, "C", closes[: n - 1]) if n > 1 else bars(spark, "C", [1.0]))
    for t, x in (("A", closes), ("B", closes[:n])):
        rows = recurrence.ema_series(df, (n,)).where(F.col("ticker") == t).orderBy("date").collect()
        assert near([r[2] for r in rows], loop(x, n, 2 / (n + 1)))
        moves = [b - a for a, b in zip(x, x[1:])]
        up, down = (loop([max(s * m, 0.0) for m in moves], n, 1 / n) for s in (1, -1))
        want = [None] + [None if g is None else (100.0 if g > 0 else 50.0) if l == 0 else 100 - 100 / (1 + g / l) for g, l in zip(up, down)]
        assert near([r.rsi for r in recurrence.rsi_series(df, n).where(F.col("ticker") == t).orderBy("date").collect()], want)


def test_series_end_at_a_missing_value_and_split_a_ticker(spark):
    df = bars(spark, "A", [float(i % 9) for i in range(900)])
    broken = df.withColumn("high", F.when(F.col("date") == F.lit(str(DAY + datetime.timedelta(days=500))).cast("date"), None).otherwise(F.col("high")))
    got = [r.atr for r in recurrence.atr_series(broken).orderBy("date").collect()]
    assert got[12] is None and None not in got[13:500] and set(got[500:]) == {None}
    plan = recurrence.ema_series(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "hashpartitioning(ticker" in plan and "year" in plan
    sizes = recurrence.numbered(df, "close").groupBy("ticker", "year", "part").count()
    assert sizes.agg(F.max("count")).first()[0] <= recurrence.PART


def test_engine_over_rows_given_in_the_call(spark):
    e = Engine.of_rows(spark, [{"ticker": "A", "date": "2024-01-02", "close": 5}, {"ticker": "A", "date": "2024-01-03", "close": 6, "prev_close": 5}, {"date": "2024-01-03"}])
    assert e.prices(lookback=5).count() == 2 and set(e.bars.columns) == {c.split()[0] for c in BARS.split(", ")}
    with pytest.raises(RequestError):
        Engine.of_rows(spark, '"x"')


def test_universe_weekly_hours_and_windows(spark, data):
    d = f"{data}/sf0.001"
    e = Engine(bars_1d(spark, d).where("ticker IN ('Brand#1', 'Brand#2', 'Brand#3')").cache(), index_1d(spark, d), sessions.hourly_bars(snapshots(spark, d)))
    assert e.screen(universe="nope, none", top_n=10).count() == e.screen(top_n=10).count() == 3
    assert {r.ticker for r in e.screen(universe="['brand#2', 'x']").collect()} == {"Brand#2"}
    assert e.screen(universe=["click"], timeframe="1h").count() > 0
    all_ = e.foreign_scan(universe=["nope"])["buyers"].count()
    assert all_ == e.foreign_scan()["buyers"].count()
    hourly = e.indicators("momentum,trend", timeframe="1h", series_tail=1)
    assert hourly["momentum.rsi"].count() == e.hours.select("ticker").distinct().count() and hourly["trend.ema_series"].count() == hourly["momentum.rsi"].count()
    few = Engine(e.bars.where("ticker <> 'Brand#1'").unionByName(e.bars.where("ticker = 'Brand#1'").orderBy("date").limit(12)))
    week = few.weekly(groups="momentum", series_tail=2)
    refused = {r.ticker for r in week["weeks"].collect() if r.refused}
    assert refused == {r.ticker for r in week["weeks"].collect() if r.available < 10} and not refused & {r.ticker for r in week["momentum.rsi"].collect()}
    assert week["momentum.rsi_series"].count() == 2 * week["momentum.rsi"].count() and week["thin"].columns == ["ticker", "date", "trading_days"]
    own = e.indicators(["trend", "momentum", "volatility", "volume_flow"], params={"return_windows": [3], "crossover_pairs": [(5, 10)], "percentile_windows": [7], "percentile_window": 9, "z_score_window": 15, "stochastic_k_window": 5, "stochastic_d_window": 2, "atr_window": 5, "volume_ratio_window": 4, "prev_close_tolerance": 0.9})
    assert own["trend.returns"].columns[-1] == "return_3" and own["trend.sma_crossover"].first().slow == 10 and own["momentum.percentile"].columns[-1] == "percentile_7"
    assert own["volatility.atr"].first().atr != e.indicators(["volatility"])["volatility.atr"].first().atr
    for call in (lambda: Engine(e.bars).breadth(), lambda: e.compare(["Brand#1", "Brand#2"], 19), lambda: e.indicators(timeframe="5m"), lambda: Engine(e.bars).indicators(timeframe="1h"), lambda: e.indicators(params={"crossover_pairs": [(9, 3)]}), lambda: Engine(e.bars).screen("intraday_breakout")):
        with pytest.raises(RequestError):
            call()


def test_report_is_one_document_a_ticker(spark, data):
    e = Engine(bars_1d(spark, f"{data}/sf0.001").where("ticker IN ('Brand#1', 'Brand#2')").cache())
    for scope in ("levels", "mid_term"):
        parts = e.multi_horizon(scope=scope)
        got = {r.ticker: json.loads(r.report) for r in e.report(scope=scope).collect()}
        assert set(got) == {"Brand#1", "Brand#2"} and all(set(r) == set(parts) for r in got.values())
        for name in ("position", "verdict") if scope == "mid_term" else ("position",):
            want = {r.ticker: r.asDict() for r in parts[name].collect()}
            assert all(len(got[t][name]) == 1 and got[t][name][0].get("reading") == want[t].get("reading") for t in got)
    size = lambda scope: e.report(scope=scope)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size("levels") < size("short_term") / 3


def test_runs_are_logged_with_rows_time_and_failure(spark, tmp_path):
    e = Engine(bars(spark, "A", [float(i + 1) for i in range(40)]), audit=str(tmp_path / "audit"), audit_every=100)
    assert len(e.run(e.prices(lookback=7))["rows"]) == 7
    assert e.run({"prices": e.prices(lookback=9)}, str(tmp_path / "out")) == {"prices": 9} and spark.read.parquet(str(tmp_path / "out" / "prices")).count() == 9
    with pytest.raises(Exception, match="broken"):
        e.run(e.prices(lookback=3).select(F.raise_error(F.lit("broken"))))
    assert not (tmp_path / "audit").exists()
    e.flush()
    e.flush()
    log = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    runs = [r for r in log if "run" in r]
    assert len(log) == 6 and [r.get("rows") for r in runs] == [7, 9, None] and runs[2]["result"].startswith("failed") and all(r["seconds"] >= 0 for r in runs)
    assert len(list((tmp_path / "audit").glob("part-*"))) == 1
