"""Support and resistance: swing points, extremes, averages and bands, merged into zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import folds
from ..functions.exprs import NEWEST, W, cases, cents, latest, r6, recent
from . import trend, volatility

EXTREMES = (20, 60, 120, 250)
CLUSTER_PCT, MOST = 0.75, 6


def swing_points(bars: DataFrame, look: int = 5) -> DataFrame:
    """Closes that lead their neighbours on both sides, newest first; a flat stretch has none."""
    w = W().rowsBetween(-look, look)
    df = bars.select("ticker", "date", "close", F.count("close").over(w).alias("n"), F.max("close").over(w).alias("hi"), F.min("close").over(w).alias("lo")).where((F.col("n") == 2 * look + 1) & (F.col("hi") > F.col("lo")))
    kind = cases((F.col("close") == F.col("hi"), "high"), (F.col("close") == F.col("lo"), "low"))
    df = df.withColumn("kind", kind).where("kind IS NOT NULL")
    order = Window.partitionBy("ticker", "kind").orderBy(F.desc("date"))
    return df.select("ticker", "kind", F.row_number().over(order).cast("bigint").alias("ordinal"), "date", F.round("close", 0).alias("level"))


def close_extremes(bars: DataFrame, windows=EXTREMES) -> DataFrame:
    """Highest and lowest close of the last n rows with their earliest dates; left out where there are fewer rows."""
    df = recent(bars, max(windows)).withColumn("k", F.row_number().over(NEWEST())).withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    df = df.withColumn("w", F.explode(F.array(*[F.lit(n).cast("bigint") for n in windows]))).where("k <= w")
    g = df.groupBy("ticker", "w").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("close", (-F.col("day")).alias("back"))).alias("h"), F.min(F.struct("close", "day")).alias("l")).where("n = w")
    as_date = lambda d: F.date_add(F.lit("1970-01-01").cast("date"), d.cast("int"))
    return g.select("ticker", F.col("w").alias("window"), F.round("h.close", 0).alias("high"), as_date(-F.col("h.back")).alias("high_date"), F.round("l.close", 0).alias("low"), as_date(F.col("l.day")).alias("low_date"))


def ma_levels(bars: DataFrame) -> DataFrame:
    m = trend.moving_averages(bars)
    names = [c for c in m.columns if c.startswith(("sma_", "ema_"))]
    df = m.select("ticker", F.explode(F.array(*[F.struct(F.lit(c.upper().replace("_", "")).alias("basis"), F.col(c).alias("v")) for c in names])).alias("x"))
    return df.where("x.v > 0").select("ticker", "x.basis", F.round("x.v", 0).alias("level"))


def bollinger_levels(bars: DataFrame) -> DataFrame:
    df = latest(volatility.bands(bars)).where("middle IS NOT NULL")
    df = df.select("ticker", F.explode(F.array(F.struct(F.lit("BB upper").alias("basis"), F.col("upper").alias("v")), F.struct(F.lit("BB lower").alias("basis"), F.col("lower").alias("v")))).alias("x"))
    return df.select("ticker", "x.basis", F.round("x.v", 0).alias("level"))


def level_candidates(bars: DataFrame, look: int = 5, newest: int = 3) -> DataFrame:
    """(ticker, side, basis, level, close): all levels strictly below (support) or above (resistance) the latest close.

    The same levels as of the operators above, but from one array of (date, close) for each ticker: one aggregation and one
    explode, however many kinds of levels there are. The lookback of the caller bounds the array.
    """
    a, c, n = F.col("a"), F.col("c"), F.size("a")
    df = bars.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("a")).withColumn("c", F.transform("a", lambda x: x["close"]))
    last = lambda k: F.slice(c, -k, k)
    item = lambda basis, level: F.struct(basis.alias("basis"), F.round(level, 0).alias("level"))
    near = lambda i: F.slice(c, i - look, 2 * look + 1)
    places = F.when(n > 2 * look, F.sequence(F.lit(look + 1), n - look)).otherwise(F.array().cast("array<int>"))

    def swings(leads) -> Column:
        found = F.filter(places, lambda i: (F.array_max(near(i)) > F.array_min(near(i))) & leads(F.get(c, i - 1), near(i)))
        kept = F.slice(found, F.greatest(F.size(found) - newest + 1, F.lit(1)), newest)
        return F.transform(kept, lambda i: item(F.concat(F.lit("swing "), F.get(a, i - 1)["date"].cast("string")), F.get(c, i - 1)))

    def extreme(name: str, k: int) -> Column:
        rows = F.slice(a, -k, k)
        top = F.array_max(F.transform(rows, lambda x: x["close"])) if name == "high" else F.array_min(F.transform(rows, lambda x: x["close"]))
        first = F.get(F.filter(rows, lambda x: x["close"] == top), 0)["date"]
        return F.when(n >= k, item(F.concat(F.lit(f"{name} {k}d "), first.cast("string")), top))

    means = [(f"SMA{k}", F.when(n >= k, folds.total(last(k)) / k)) for k in trend.SMA_WINDOWS] + [(f"EMA{k}", folds.ema(c, k)) for k in trend.EMA_WINDOWS]
    df = df.withColumn("middle", F.when(n >= 20, folds.total(last(20)) / 20))
    df = df.withColumn("sd", F.sqrt(folds.total(F.transform(last(20), lambda x: (x - F.col("middle")) * (x - F.col("middle")))) / 20))
    single = [extreme(name, k) for k in EXTREMES for name in ("high", "low")] + [F.when(v > 0, item(F.lit(name), v)) for name, v in means]
    single += [F.when(F.col("middle").isNotNull(), item(F.lit(f"BB {name}"), F.col("middle") + sign * 2.0 * F.col("sd"))) for name, sign in (("upper", 1), ("lower", -1))]
    # a close that leads on both sides counts as high
    every = F.concat(swings(lambda x, w: x == F.array_max(w)), swings(lambda x, w: (x == F.array_min(w)) & (x < F.array_max(w))), F.array_compact(F.array(*single)))
    df = df.select("ticker", F.element_at(c, -1).alias("close"), F.explode(every).alias("x")).select("ticker", "close", "x.basis", "x.level").where("level <> close")
    return df.select("ticker", F.when(F.col("level") < F.col("close"), "support").otherwise("resistance").alias("side"), "basis", "level", "close")


def level_clusters(candidates: DataFrame, pct: float = CLUSTER_PCT) -> DataFrame:
    """Zones of each side: ascending levels join the zone whose first member is at most ``pct`` percent below.

    The fold carries an array of zones; a ticker has some thirty candidates at most.
    """
    x = F.struct("level", "basis")
    g = candidates.groupBy("ticker", "side").agg(F.first("close").alias("close"), F.array_sort(F.collect_list(x)).alias("a"))
    zone = lambda anchor, total, n, bases: F.struct(anchor.alias("anchor"), total.alias("total"), n.alias("n"), bases.alias("bases"))
    fresh = lambda v: F.array(zone(v["level"], v["level"], F.lit(1), F.array(v["basis"])))

    def step(zones, v):
        last = F.element_at(zones, -1)
        joined = zone(last["anchor"], last["total"] + v["level"], last["n"] + 1, F.array_union(last["bases"], F.array(v["basis"])))
        return F.when((last["anchor"] > 0) & ((v["level"] - last["anchor"]) / last["anchor"] * 100 <= pct), F.concat(F.slice(zones, 1, F.size(zones) - 1), F.array(joined))).otherwise(F.concat(zones, fresh(v)))

    folded = g.select("ticker", "side", "close", F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), fresh(F.element_at("a", 1)), step).alias("zones"))
    z = folded.select("ticker", "side", "close", F.explode("zones").alias("z"))
    level = F.round(F.col("z.total") / F.col("z.n"), 0)
    return z.select("ticker", "side", level.alias("level"), F.size("z.bases").cast("bigint").alias("confluence"), F.array_join("z.bases", " + ").alias("basis"), cents(F.abs(level - F.col("close")) / F.col("close") * 100).alias("distance_pct"), "close")


def nearest_levels(zones: DataFrame, most: int = MOST) -> DataFrame:
    near = Window.partitionBy("ticker", "side").orderBy(F.when(F.col("side") == "support", -F.col("level")).otherwise(F.col("level")))
    return zones.withColumn("ordinal", F.row_number().over(near).cast("bigint")).where(F.col("ordinal") <= most).drop("close")


def level_position(zones: DataFrame, bars: DataFrame) -> DataFrame:
    """Where the latest close stands between its nearest support and resistance."""
    g = zones.groupBy("ticker").agg(F.max(F.when(F.col("side") == "support", F.col("level"))).alias("support"), F.min(F.when(F.col("side") == "resistance", F.col("level"))).alias("resistance"))
    df = latest(bars).select("ticker", "date", "close").join(g, "ticker", "left")
    s, r = F.col("support"), F.col("resistance")
    band = F.when(r > s, F.round(((F.col("close") - s) / (r - s) * 100).cast("decimal(28,8)"), 1).cast("double"))
    df = df.withColumn("pct_in_band", band)
    p = F.col("pct_in_band")
    reading = cases((s.isNull() & r.isNull(), "no_levels"), (r.isNull(), "above_all_levels"), (s.isNull(), "below_all_levels"), (p.isNull(), "degenerate_band"), (p >= 75, "testing_resistance"), (p <= 25, "testing_support"), otherwise="mid_band")
    return df.select("ticker", "date", r6("close").alias("close"), "support", "resistance", "pct_in_band", reading.alias("reading"))


def horizon_ma_levels(bars: DataFrame, most: int = 4) -> DataFrame:
    """Short-term view: EMA12, SMA20, SMA50 and the bands by distance from the close, four of each side."""
    close = latest(bars).select("ticker", "close")
    m = trend.moving_averages(bars).drop("close", "date")
    bb = latest(volatility.bands(bars)).select("ticker", "upper", "lower")
    named = [("EMA12", "ema_12"), ("SMA20", "sma_20"), ("SMA50", "sma_50"), ("BB lower", "lower"), ("BB upper", "upper")]
    df = close.join(m, "ticker").join(bb, "ticker").select("ticker", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("basis"), F.col(c).alias("v")) for n, c in named])).alias("x")).select("ticker", "close", "x.*").where("v IS NOT NULL AND v <> close")
    df = df.where("NOT (basis = 'BB lower' AND v > close) AND NOT (basis = 'BB upper' AND v < close)")
    df = df.select("ticker", F.when(F.col("v") < F.col("close"), "support").otherwise("resistance").alias("side"), "basis", F.round("v", 0).alias("level"), cents(F.abs(F.col("v") - F.col("close")) / F.col("close") * 100).alias("distance_pct"))
    order = Window.partitionBy("ticker", "side").orderBy("distance_pct", "basis")
    return df.withColumn("ordinal", F.row_number().over(order).cast("bigint")).where(F.col("ordinal") <= most)
