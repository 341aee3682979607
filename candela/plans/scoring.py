"""Multi-horizon verdicts, comparison of tickers, and screening, for all tickers in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import folds
from ..functions.exprs import W, cases, cents, full_avg, lag, latest, pct, ratio, recent
from ..operators import flow, levels, momentum, trend, weekly

#: The components of each horizon and their weights, in order.
COMPONENTS = {
    "short_term": [("structure", 1.0), ("rsi", 0.8), ("macd", 0.8), ("percentile_20", 0.5), ("foreign_20", 0.6), ("imbalance", 0.6), ("streak", 0.3)],
    "mid_term": [("structure", 1.0), ("cross_20_50", 0.6), ("rsi", 0.6), ("macd", 0.6), ("percentile_60", 0.5), ("foreign_60", 0.7), ("obv_60", 0.4), ("weekly_sma20", 0.6)],
    "long_term": [("structure", 1.0), ("sma200", 0.9), ("cross_50_200", 0.7), ("weekly_rsi", 0.6), ("weekly_macd", 0.6), ("percentile_126", 0.5), ("foreign_120", 0.7), ("return", 0.4)],
}
BANDS = [(0.50, "strong_bullish"), (0.25, "moderate_bullish"), (0.10, "lean_bullish"), (-0.10, "neutral"), (-0.25, "lean_bearish"), (-0.50, "moderate_bearish")]
#: The words for the confidence of a verdict.
HIGH, MEDIUM, LOW = "cao", "trung bình", "thấp"
#: Points of the labels that signal_strength adds up.
POINTS = {
    "strong_bullish": 2.0, "moderate_bullish": 1.0, "bullish": 1.0,
    "weak_bullish": 0.5, "above_long_term_ma": 0.5,
    "overbought": 0.5, "neutral": 0.0, "insufficient_data": 0.0,
    "oversold": -0.5, "weak_bearish": -0.5, "below_long_term_ma": -0.5,
    "moderate_bearish": -1.0, "bearish": -1.0, "strong_bearish": -2.0,
}


def daily_features(bars: DataFrame) -> DataFrame:
    """One row per ticker: what the components are made of."""
    net = F.col("foreign_buy_value") - F.col("foreign_sell_value")
    df = flow.obv_rows(bars).withColumn("net", net).withColumn("imb", flow.imbalance("buy_volume", "sell_volume"))
    p60, o60 = pct("close", lag("close", 60)), F.col("obv") - lag("obv", 60)
    div = cases((p60.isNull() | o60.isNull(), None), ((p60 > 2) & (o60 < -1_000_000), -1), ((p60 < -2) & (o60 > 1_000_000), 1), otherwise=0)
    df = df.select(
        "ticker", "date", "close", *[full_avg("close", n).alias(f"sma_{n}") for n in (20, 50, 100, 200)], *[momentum.percentile(n).alias(f"p{n}") for n in (20, 60, 126)],
        *[cents(F.sum("net").over(W().rowsBetween(-(n - 1), 0)) / 1e9).alias(f"f{n}") for n in (20, 60, 120)], full_avg("imb", 5).alias("imb"), div.alias("obv_60"), F.signum(F.col("close") - lag("close")).alias("last_move"),
        pct("close", lag("close", 120)).alias("r120"), pct("close", lag("close", 250)).alias("r250"),
    )
    s = folds.series(bars, c="close").select("ticker", folds.ema(F.col("c"), 12).alias("ema_12"), folds.rsi(F.col("c")).alias("rsi"), folds.macd(F.col("c"))["hist"].alias("macd"))
    cross = trend.sma_crossover(bars).withColumn("d", cases((F.col("crossover") == "golden_cross", 1), (F.col("crossover") == "death_cross", -1)))
    cross = cross.groupBy("ticker").agg(F.max(F.when(F.col("fast") == 20, F.col("d"))).alias("cross_20_50"), F.max(F.when(F.col("fast") == 50, F.col("d"))).alias("cross_50_200"))
    return latest(df).join(s, "ticker").join(cross, "ticker")


def weekly_features(bars: DataFrame) -> DataFrame:
    """The same of weekly bars: the first week has no previous close and does not count."""
    w = weekly.weekly_bars(bars).where("prev_close IS NOT NULL")
    m = latest(w.select("ticker", "date", full_avg("close", 20).alias("w_sma_20"), full_avg("close", 50).alias("w_sma_50"))).drop("date")
    s = folds.series(w, c="close").select("ticker", folds.rsi(F.col("c")).alias("w_rsi"), folds.macd(F.col("c"))["hist"].alias("w_macd"))
    return m.join(s, "ticker")


def features(bars: DataFrame) -> DataFrame:
    """Daily features with the weekly ones of the same ticker, where there are any."""
    return daily_features(bars).join(weekly_features(bars), "ticker", "left")


def comp_structure(*means: str) -> Column:
    """+1 above all means there are, -1 above none of them, else 0; null without any."""
    have = F.array_compact(F.array(*[F.col(m) for m in means]))
    above = F.size(F.filter(have, lambda m: F.col("close") > m))
    return cases((F.size(have) == 0, None), (above == F.size(have), 1), (above == 0, -1), otherwise=0)


def comp_rsi(v: Column) -> Column:
    return cases((v.isNull(), None), ((v >= 70) | (v <= 30), 0), (v >= 55, 1), (v <= 45, -1), otherwise=0)


def comp_sign(v: Column) -> Column:
    return F.signum(v).cast("int")


def comp_percentile(v: Column) -> Column:
    p = F.round(v.cast("decimal(28,8)"), 3)
    return cases((v.isNull(), None), (p >= 0.7, 1), (p <= 0.3, -1), otherwise=0)


def component_columns() -> dict[str, dict[str, Column]]:
    c = F.col
    above = lambda m: cases((c(m).isNull(), None), (c("close") > c(m), 1), otherwise=-1)
    imbalance = cases((c("imb").isNull(), None), (c("imb") > 0.05, 1), (c("imb") < -0.05, -1), otherwise=0)
    common = {"rsi": comp_rsi(c("rsi")), "macd": comp_sign(c("macd"))}
    return {
        "short_term": common | {"structure": comp_structure("ema_12", "sma_20"), "percentile_20": comp_percentile(c("p20")), "foreign_20": comp_sign(c("f20")), "imbalance": imbalance, "streak": comp_sign(c("last_move"))},
        "mid_term": common | {"structure": comp_structure("sma_20", "sma_50", "sma_100"), "cross_20_50": c("cross_20_50"), "percentile_60": comp_percentile(c("p60")), "foreign_60": comp_sign(c("f60")), "obv_60": c("obv_60"), "weekly_sma20": above("w_sma_20")},
        "long_term": {"structure": comp_structure("w_sma_20", "w_sma_50"), "sma200": above("sma_200"), "cross_50_200": c("cross_50_200"), "weekly_rsi": comp_rsi(c("w_rsi")), "weekly_macd": comp_sign(c("w_macd")), "percentile_126": comp_percentile(c("p126")), "foreign_120": comp_sign(c("f120")), "return": comp_sign(F.coalesce(c("r250"), c("r120")))},
    }


def components(feats: DataFrame) -> DataFrame:
    """(ticker, horizon, ordinal, component, weight, direction): direction is null where data are missing."""
    cols = component_columns()
    rows = [F.struct(F.lit(h).alias("horizon"), F.lit(i + 1).cast("bigint").alias("ordinal"), F.lit(name).alias("component"), F.lit(w).alias("weight"), cols[h][name].cast("int").alias("direction")) for h, parts in COMPONENTS.items() for i, (name, w) in enumerate(parts)]
    return feats.select("ticker", F.explode(F.array(*rows)).alias("x")).select("ticker", "x.*")


def verdicts(comps: DataFrame) -> DataFrame:
    """Score, coverage, agreement and confidence of each ticker and horizon."""
    tenths = lambda c: F.sum((c * 10).cast("bigint"))  # noqa: E731  weights are tenths: sums of them are exact
    d, w = F.col("direction"), F.col("weight")
    g = comps.groupBy("ticker", "horizon").agg(tenths(w).alias("all"), tenths(F.when(d.isNotNull(), w)).alias("have"), tenths(F.when(d != 0, w)).alias("aimed"), tenths(w * d).alias("net"), F.count_if(d > 0).alias("bullish"), F.count_if(d < 0).alias("bearish"), F.count_if(d == 0).alias("neutral"), F.count_if(d.isNull()).alias("missing"))
    score, coverage, agreement = ratio("net", "have"), F.coalesce(ratio("have", "all"), F.lit(0.0)), F.coalesce(F.abs(ratio("net", "aimed")), F.lit(0.0))
    df = g.withColumn("score", score).withColumn("coverage", coverage).withColumn("agreement", agreement)
    s = F.col("score")
    strength = cases((s.isNull(), "insufficient_data"), *[(s >= limit, name) for limit, name in BANDS], otherwise="strong_bearish")
    confidence = cases(((F.col("coverage") >= 0.75) & (F.col("agreement") >= 0.60), HIGH), ((F.col("coverage") >= 0.50) & (F.col("agreement") >= 0.40), MEDIUM), otherwise=LOW)
    r = lambda c: F.round(c, 6).alias(c)
    return df.select("ticker", "horizon", strength.alias("strength"), r("score"), r("coverage"), r("agreement"), confidence.alias("confidence"), "bullish", "bearish", "neutral", "missing")


def conflicts(comps: DataFrame) -> DataFrame:
    """The three heaviest pairs of opposing components of weight 0.5 or more; equal pairs in component order."""
    heavy = comps.where("weight >= 0.5 AND direction <> 0")
    up = heavy.where("direction > 0").select("ticker", "horizon", F.col("ordinal").alias("u"), F.col("component").alias("bullish"), F.col("weight").alias("uw"))
    down = heavy.where("direction < 0").select("ticker", "horizon", F.col("ordinal").alias("d"), F.col("component").alias("bearish"), F.col("weight").alias("dw"))
    df = up.join(down, ["ticker", "horizon"]).withColumn("combined_weight", F.round(F.col("uw") + F.col("dw"), 2))
    order = Window.partitionBy("ticker", "horizon").orderBy(F.desc("combined_weight"), "u", "d")
    return df.withColumn("ordinal", F.row_number().over(order).cast("bigint")).where("ordinal <= 3").select("ticker", "horizon", "ordinal", "bullish", "bearish", "combined_weight")


def bias_of(strength: Column) -> Column:
    return cases((strength.contains("bullish"), 1), (strength.contains("bearish"), -1), (strength == "insufficient_data", None), otherwise=0)


def invalidation(verdict: DataFrame, position: DataFrame) -> DataFrame:
    """The level that would overturn the verdict: support below a bullish one, resistance above a bearish one, both for a neutral one."""
    b = F.coalesce(bias_of(F.col("strength")), F.lit(0))
    df = verdict.select("ticker", "horizon", b.alias("bias")).join(position.select("ticker", "support", "resistance"), "ticker")
    return df.select("ticker", "horizon", cases((F.col("bias") > 0, F.col("support")), (F.col("bias") < 0, F.col("resistance"))).alias("level"), F.when(F.col("bias") == 0, F.col("resistance")).alias("upper_level"), F.when(F.col("bias") == 0, F.col("support")).alias("lower_level"))


def alignment(verdict: DataFrame) -> DataFrame:
    """Agreement of the horizons of each ticker, with the weakest confidence among those of the majority."""
    rank = cases((F.col("confidence") == HIGH, 2), (F.col("confidence") == MEDIUM, 1), otherwise=0)
    df = verdict.select("ticker", bias_of(F.col("strength")).alias("b"), rank.alias("r"))
    weakest = {k: F.min(F.when(F.col("b") == k, F.col("r"))).alias(f"r{i}") for i, k in enumerate((-1, 0, 1))}
    g = df.groupBy("ticker").agg(F.count_if(F.col("b") > 0).alias("bulls"), F.count_if(F.col("b") < 0).alias("bears"), F.count_if(F.col("b") == 0).alias("neutrals"), F.count("b").alias("scored"), F.min("r").alias("any"), *weakest.values())
    u, d, n = F.col("bulls"), F.col("bears"), F.col("scored")
    label = cases((n == 0, "insufficient_data"), (u == n, "all_bullish"), (d == n, "all_bearish"), ((u > 0) & (d > 0), "conflicting"), (u > 0, "mostly_bullish"), (d > 0, "mostly_bearish"), otherwise="all_neutral")
    basis = F.coalesce(cases((u > d, F.col("r2")), (d > u, F.col("r0")), otherwise=F.col("r1")), F.col("any"))
    return g.select("ticker", label.alias("label"), "bulls", "bears", "neutrals", "scored", F.element_at(F.array(F.lit(LOW), F.lit(MEDIUM), F.lit(HIGH)), basis + 1).alias("confidence"))


def trend_class() -> Column:
    """Class of the order of close, SMA20, SMA50 and, where there is one, SMA200."""
    c, a, b, d = F.col("close"), F.col("sma_20"), F.col("sma_50"), F.col("sma_200")
    up, down = (c > a) & (a > b), (c < a) & (a < b)
    two = cases((up, "bullish"), (down, "bearish"), (c > b, "weak_bullish"), otherwise="weak_bearish")
    three = cases((up & (b > d), "strong_bullish"), (down & (b < d), "strong_bearish"), (c > d, F.when(c > a, "moderate_bullish").otherwise("weak_bullish")), (c < a, "moderate_bearish"), otherwise="weak_bearish")
    return cases((c.isNull() | a.isNull() | b.isNull(), "insufficient_data"), (d.isNull(), two), otherwise=three)


def momentum_class() -> Column:
    """Band of the RSI, with the side of the MACD histogram unless overbought or oversold."""
    r, h = F.col("rsi"), F.col("macd")
    band = cases((r > 60, "bullish"), (r < 40, "bearish"), otherwise="neutral")
    return cases((r.isNull(), "insufficient_data"), (r > 70, "overbought"), (r < 30, "oversold"), (h.isNull(), band), otherwise=F.concat(band, F.when(h > 0, "_macd_positive").otherwise("_macd_negative")))


def classify_trend(feats: DataFrame) -> DataFrame:
    return feats.select("ticker", trend_class().alias("trend"))


def classify_momentum(feats: DataFrame) -> DataFrame:
    return feats.select("ticker", momentum_class().alias("momentum"))


def strength_of(trend: Column, momentum: Column, side: Column, stance: Column) -> Column:
    """One label of four coarse ones: trend and momentum class, side of the volume, stance of foreign money."""
    points = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    of = lambda label: F.coalesce(F.try_element_at(points, label), F.lit(0.0))
    signed = lambda size, plus, minus: F.when(plus, F.lit(size)).when(minus, F.lit(-size)).otherwise(F.lit(0.0))
    # added in this order in doubles, as the limits are compared with rounded sums
    total = of(trend) + of(F.substring_index(momentum, "_macd_", 1)) * 0.6 + signed(0.3, momentum.contains("_macd_positive"), momentum.contains("_macd_negative"))
    total = total + signed(0.4, side == "buy_side", side == "sell_side") + signed(0.4, stance == "net_buying", stance == "net_selling")
    return cases((total >= 2.0, "strong_bullish"), (total >= 1.0, "moderate_bullish"), (total >= 0.3, "lean_bullish"), (total > -0.3, "neutral"), (total > -1.0, "lean_bearish"), (total > -2.0, "moderate_bearish"), otherwise="strong_bearish")


def signal_strength(feats: DataFrame) -> DataFrame:
    """Trend, momentum, volume bias of five rows and foreign stance of twenty, and the label they give together."""
    df = feats.select("ticker", trend_class().alias("trend"), momentum_class().alias("momentum"), flow.bias(F.col("imb")).alias("bias"), flow.stance_of(F.col("f20")).alias("stance"))
    return df.withColumn("signal_strength", strength_of(F.col("trend"), F.col("momentum"), F.col("bias"), F.col("stance")))


# comparison


def compare_ma(bars: DataFrame) -> DataFrame:
    """Distances to seven means, RSI, MACD and its histogram in percent of the close."""
    m = trend.moving_averages(bars)
    s = folds.series(bars, c="close").select("ticker", folds.rsi(F.col("c")).alias("rsi"), folds.macd(F.col("c")).alias("m"))
    names = ("sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_200")
    r = lambda x: F.round(x, 6)
    return m.join(s, "ticker").select("ticker", *[r(pct("close", n)).alias(f"vs_{n}_pct") for n in names], r("rsi").alias("rsi"), r("m.macd").alias("macd"), r("m.signal").alias("macd_signal"), r("m.hist").alias("macd_hist"), r(ratio("m.hist", "close") * 100).alias("macd_hist_pct_of_close"))


def compare_52w(bars: DataFrame, least: int = 10) -> DataFrame:
    """52-week rows; a ticker with too few rows is shown as excluded, not dropped."""
    s = weekly.stats_52w(bars)
    ok = F.col("window_sessions") >= least
    show = [c for c in s.columns if c not in ("ticker", "date", "window_sessions", "required", "is_full")]
    return s.select("ticker", "window_sessions", (~ok).alias("excluded"), *[F.when(ok, F.col(c)).alias(c) for c in show])


def rank_observation(table: DataFrame, field: str, gap: float, absolute: bool = False) -> DataFrame:
    """Tickers by a metric, and whether its spread is material; nothing for a single one."""
    v = F.abs(field) if absolute else F.col(field)
    df = table.select("ticker", v.alias("value")).where("value IS NOT NULL")
    spread = df.agg((F.max("value") - F.min("value")).alias("spread"), F.count(F.lit(1)).alias("compared")).where("compared > 1")
    # ranks need one order of all compared tickers, of which a request has five at most
    rank = F.row_number().over(Window.orderBy(F.desc("value"), "ticker")).cast("bigint")
    return df.withColumn("rank", rank).crossJoin(F.broadcast(spread)).select("ticker", F.lit(field).alias("metric"), F.round("value", 6).alias("value"), "rank", (F.col("spread") >= gap).alias("material"))


#: Differences from which tickers count as unlike.
GAPS = {"return_pct": (3.0, False), "max_drawdown_pct": (3.0, True), "from_low_pct": (5.0, False), "vs_sma_200_pct": (2.0, False), "rsi": (5.0, True)}
LIQUIDITY = 1.3


def rank_observations(bars: DataFrame) -> DataFrame:
    stats, ma = weekly.stats_52w(bars), compare_ma(bars)
    parts = [rank_observation(stats if f in stats.columns else ma, f, gap, a) for f, (gap, a) in GAPS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relative_assessment(bars: DataFrame) -> DataFrame:
    """(metric, above, below): who is on which side of the means and of the MACD, and who leads in turnover."""
    ma = compare_ma(bars)
    sides = ma.select("ticker", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("v")) for n, c in (("sma_20", "vs_sma_20_pct"), ("sma_50", "vs_sma_50_pct"), ("sma_200", "vs_sma_200_pct"), ("macd_hist", "macd_hist"))])).alias("x")).select("ticker", "x.*").where("v IS NOT NULL")
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("ticker")))), ",")
    split = sides.groupBy("metric").agg(names(F.col("v") > 0).alias("above"), names(F.col("v") <= 0).alias("below")).where("above <> '' AND below <> ''")
    t = weekly.stats_52w(bars).where("avg_value > 0").agg(F.max(F.struct("avg_value", "ticker")).alias("hi"), F.min(F.struct("avg_value", "ticker")).alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    turnover = t.select(F.lit("turnover").alias("metric"), F.when(F.col("hi.avg_value") >= LIQUIDITY * F.col("lo.avg_value"), F.col("hi.ticker")).otherwise("").alias("above"), F.when(F.col("hi.avg_value") >= LIQUIDITY * F.col("lo.avg_value"), F.col("lo.ticker")).otherwise("").alias("below"))
    return split.unionByName(turnover)


def compare_levels(bars: DataFrame) -> DataFrame:
    return levels.level_position(levels.level_clusters(levels.level_candidates(bars)), bars).drop("date")


# screening


def screen_momentum(bars: DataFrame) -> DataFrame:
    """Breakout score of 0 to 100: distance to SMA20, RSI, volume, MACD."""
    vol = ratio("total_volume", F.avg("total_volume").over(W().rowsBetween(-20, -1)))
    last = latest(bars.select("ticker", "date", "close", "total_volume", F.count(F.lit(1)).over(W()).alias("n"), full_avg("close", 20).alias("m"), F.when(F.count(F.lit(1)).over(W()) > 20, vol).alias("v")))
    s = folds.series(bars, c="close").select("ticker", folds.rsi(F.col("c")).alias("rsi"), folds.macd(F.col("c")).alias("a"), folds.macd(F.col("c"), 8, 17, 9)["hist"].alias("short_hist"))
    df = last.join(s, "ticker").withColumn("dist", F.when(F.col("m") > 0, pct("close", "m")))
    d, r, v, h, p = F.col("dist"), F.col("rsi"), F.col("v"), F.col("a.hist"), F.col("a.prev")
    sma = F.when(d > 0, F.least(F.lit(25.0), 20 + F.least(F.lit(5.0), d))).otherwise(0.0)
    rsi = cases((r.between(50, 70), 25.0), ((r > 70) & (r <= 80), 15.0), ((r >= 45) & (r < 50), 10.0), otherwise=0.0)
    volume = cases((v >= 1.5, 25.0), (v >= 1.2, 20.0), (v >= 1.0, 10.0), otherwise=0.0)
    long = cases(((p <= 0) & (h > 0), 25.0), (h > 0, 20.0), otherwise=0.0)
    macd = cases((F.col("n") >= 34, long), ((F.col("n") >= 20) & (F.col("short_hist") > 0), 20.0), otherwise=0.0)
    return scored(df, 20, sma + rsi + volume + macd)


def screen_oversold(bars: DataFrame) -> DataFrame:
    """Reversal score: RSI, distance to the lowest close of 20 rows, candle."""
    df = latest(bars.select("ticker", "date", "open", "high", "low", "close", F.count(F.lit(1)).over(W()).alias("n"), F.min("close").over(W().rowsBetween(-19, 0)).alias("bottom"), lag("open").alias("po"), lag("close").alias("c1"), lag("close", 2).alias("c2")))
    df = df.join(folds.series(bars, c="close").select("ticker", folds.rsi(F.col("c")).alias("rsi")), "ticker")
    r, c, o, c1 = F.col("rsi"), F.col("close"), F.col("open"), F.col("c1")
    body, span = F.abs(c - o), F.col("high") - F.col("low")
    upper, lower = F.col("high") - F.greatest(o, c), F.least(o, c) - F.col("low")
    rsi = cases((r < 30, 35.0), (r < 35, 25.0), (r < 40, 15.0), otherwise=0.0)
    dist = F.when(F.col("bottom") > 0, pct("close", "bottom")).otherwise(0.0)
    support = cases((dist.between(0, 2.5), 35.0), (dist <= 5, 20.0), otherwise=0.0)
    doji = body / span <= 0.1
    engulfing = (c1 < F.col("po")) & (c > o) & (o <= c1) & (c >= F.col("po"))
    with_previous = cases((engulfing, 30.0), (doji, 20.0), (c > o, 10.0), otherwise=0.0)
    full = cases(((lower >= 2 * body) & (upper <= 0.25 * span) & (lower > 0.4 * span), 30.0), (F.col("po").isNotNull(), with_previous), (doji, 20.0), otherwise=0.0)
    bounce = F.when((c1 < F.col("c2")) & (c > c1), F.when(pct("close", "c1") >= 1, 25.0).otherwise(10.0)).otherwise(0.0)
    candle = F.when(o.isNotNull() & (F.coalesce(span, F.lit(0.0)) > 0), full).otherwise(bounce)
    return scored(df, 15, rsi + support + candle)


def screen_foreign(bars: DataFrame, n: int = 5) -> DataFrame:
    """Accumulation score: net foreign value of n rows, its share of buying, room left."""
    g = foreign_scan(bars, n)
    x, p, room = cents(F.col("net_value") / 1e9), F.col("buy_participation_pct"), F.col("room")
    net = cases((F.col("net_value") <= 0, 0.0), (x >= 50, 40.0), (x >= 10, 30.0), otherwise=20.0)
    part = cases((p >= 25, 35.0), (p >= 15, 25.0), (p >= 8, 15.0), otherwise=0.0)
    left = cases((room > 1_000_000, 25.0), (room > 200_000, 15.0), (room > 0, 5.0), otherwise=0.0)
    return scored(g.withColumn("n", F.col("sessions")), 5, net + part + left)


def scored(df: DataFrame, least: int, score: Column) -> DataFrame:
    """(ticker, score): to one decimal, 0 below ``least`` rows."""
    one = F.round(score.cast("decimal(28,8)"), 1).cast("double")
    return df.select("ticker", F.when(F.col("n") >= least, one).otherwise(0.0).alias("score"))


def screen_intraday(hours: DataFrame) -> DataFrame:
    """Breakout of the newest day's last hourly bar over the first two: price, volume, direction."""
    day = Window.partitionBy("ticker", "date")
    newest = F.max("date").over(Window.partitionBy("ticker"))
    df = hours.withColumn("newest", newest).where("date = newest").withColumn("i", F.row_number().over(day.orderBy("datetime"))).withColumn("n", F.count(F.lit(1)).over(day))
    morning = F.col("i") <= F.least(F.lit(2), F.col("n") - 1)
    g = df.groupBy("ticker").agg(F.max("n").alias("n"), F.max(F.when(morning, F.col("high"))).alias("top"), F.avg(F.when(morning, F.col("volume"))).alias("mv"), F.max_by("close", "i").alias("c"), F.max_by("volume", "i").alias("v"), F.min_by("open", "i").alias("o"))
    dist = F.when(F.col("top") > 0, (F.col("c") - F.col("top")) / F.col("top") * 100).otherwise(0.0)
    price = F.when(F.col("c") > F.col("top"), F.least(F.lit(45.0), 35 + F.least(F.lit(10.0), dist * 5))).otherwise(0.0)
    x = F.when(F.col("mv") > 0, F.col("v") / F.col("mv")).otherwise(1.0)
    volume = cases((x >= 1.5, 35.0), (x >= 1.2, 25.0), (x >= 1.0, 10.0), otherwise=0.0)
    return scored(g, 2, price + volume + F.when(F.col("c") > F.col("o"), 20.0).otherwise(0.0))


def screen_details(bars: DataFrame) -> DataFrame:
    """What a screened ticker is shown with: flows of the last row, extremes of 20 rows, volatility and stop."""
    net = F.col("foreign_buy_value") - F.col("foreign_sell_value")
    df = bars.select("*", net.alias("net")).withColumn("n", F.count(F.lit(1)).over(W())).withColumn("r", F.ln(F.col("close") / lag("close")))
    w20, w5 = W().rowsBetween(-19, 0), W().rowsBetween(-4, 0)
    df = latest(df.withColumn("lo", F.min("close").over(w20)).withColumn("hi", F.max("close").over(w20)).withColumn("net5", F.sum("net").over(w5)).withColumn("sd", F.stddev_samp("r").over(w20)))
    vol = F.when((F.col("n") >= 10) & F.col("sd").isNotNull(), F.col("sd") * 100 * F.sqrt(F.lit(252.0))).otherwise(25.0)
    r = lambda x, n=6: F.round(x, n)
    return df.select("ticker", "date", "total_volume", r("total_value", 2).alias("total_value"), r(F.coalesce(flow.imbalance("buy_volume", "sell_volume"), F.lit(0.0))).alias("imbalance"), r("net", 2).alias("foreign_net_value"), r("net5", 2).alias("foreign_net_value_5d"), "foreign_room", r("lo").alias("support"), r("hi").alias("resistance"), r(pct("close", "lo")).alias("to_support_pct"), r((F.col("hi") - F.col("close")) / F.col("hi") * 100).alias("to_resistance_pct"), r(vol).alias("volatility_pct"), r(vol / 8).alias("stop_pct"))


def screen_and_rank(scores: DataFrame, bars: DataFrame, n: int = 5, universe: DataFrame | None = None) -> DataFrame:
    """The n best scores; equal ones by the change of the last row, then in the order of the universe (ticker, pos), or of the tickers."""
    change = latest(bars).select("ticker", cents(pct("close", "prev_close")).alias("change_pct"))
    df = scores.join(change, "ticker")
    df = df.withColumn("pos", F.lit(0)) if universe is None else df.join(universe.select("ticker", "pos"), "ticker", "left")
    order = [F.desc("score"), F.desc("change_pct"), F.asc_nulls_last("pos"), F.asc("ticker")]
    # the window has no partition, but n rows only
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return df.orderBy(*order).limit(n).withColumn("rank", rank).select("rank", "ticker", "score", "change_pct")


def foreign_scan(bars: DataFrame, n: int = 5) -> DataFrame:
    """Sums of the last n rows of each ticker: net foreign value and volume, participation, room."""
    g = recent(bars, n).groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"), F.sum("foreign_buy_value").alias("b"), F.sum("foreign_sell_value").alias("s"), F.sum("total_value").alias("t"), (F.sum("foreign_buy_volume") - F.sum("foreign_sell_volume")).alias("net_volume"), F.max_by("foreign_room", "date").alias("room"))
    part = lambda c: F.when(F.col("t") > 0, cents(F.col(c) / F.col("t") * 100)).otherwise(0.0)
    return g.select("ticker", "sessions", F.round(F.col("b") - F.col("s"), 2).alias("net_value"), "net_volume", part("b").alias("buy_participation_pct"), part("s").alias("sell_participation_pct"), "room")


def foreign_top(scan: DataFrame, n: int = 5, buyers: bool = True) -> DataFrame:
    """The n largest net buyers (or sellers); if there is none, of all tickers."""
    sign = F.col("net_value") > 0 if buyers else F.col("net_value") < 0
    key = F.desc("net_value") if buyers else F.asc("net_value")
    # tickers on the right side come first; the rest only counts where that side is empty
    top = scan.withColumn("side", sign.cast("int")).orderBy(F.desc("side"), key, "ticker").limit(n)
    top = top.withColumn("best", F.max("side").over(Window.partitionBy(F.lit(1)))).where("side = best")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(key, "ticker")).cast("bigint")).select("rank", "ticker", "net_value", "net_volume", "room")


def room_warnings(scan: DataFrame, least: int = 500_000) -> DataFrame:
    return scan.where(F.col("room") < least).select("ticker", "room")
