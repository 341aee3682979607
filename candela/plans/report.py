"""The whole report of a ticker in one row for each horizon, and the one-row-per-ticker comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import cents
from ..operators import levels
from . import scoring


def multi_horizon(bars: DataFrame) -> DataFrame:
    """Verdict of each horizon with the position between the ticker's nearest levels."""
    verdict = scoring.verdicts(scoring.components(scoring.features(bars)))
    position = levels.level_position(levels.level_clusters(levels.level_candidates(bars)), bars)
    return verdict.join(position, "ticker")


#: The averages each horizon takes its own levels from, and their names.
OWN = {
    "short_term": [("EMA12", "ema_12"), ("SMA20", "sma_20"), ("SMA50", "sma_50")],
    "mid_term": [("SMA20", "sma_20"), ("SMA50", "sma_50"), ("SMA100", "sma_100"), ("SMA200", "sma_200")],
    "long_term": [("SMA200_daily", "sma_200"), ("SMA20_weekly", "w_sma_20"), ("SMA50_weekly", "w_sma_50")],
}


def own_levels(feats: DataFrame) -> DataFrame:
    """(ticker, horizon, s, r): nearest average of the horizon below the close, and nearest one not below it; (level, order, basis)."""
    rows = []
    for h, means in OWN.items():
        at = [F.struct(F.round(c, 0).alias("level"), F.lit(i).alias("order"), F.lit(name).alias("basis"), F.col(c).alias("v")) for i, (name, c) in enumerate(means)]
        have = F.filter(F.array(*at), lambda x: x["v"] > 0)
        below, above = F.filter(have, lambda x: x["v"] < F.col("close")), F.filter(have, lambda x: x["v"] >= F.col("close"))
        first = F.array_max(F.transform(below, lambda x: F.struct(x["level"].alias("level"), (-x["order"]).alias("order"), x["basis"].alias("basis"))))
        last = F.array_min(F.transform(above, lambda x: F.struct(x["level"].alias("level"), x["order"].alias("order"), x["basis"].alias("basis"))))
        rows.append(F.struct(F.lit(h).alias("horizon"), first.alias("s"), last.alias("r")))
    return feats.select("ticker", F.explode(F.array(*rows)).alias("x")).select("ticker", "x.*")


def levels_to_watch(feats: DataFrame) -> DataFrame:
    """Every average of each horizon as support (below the close) or resistance, nearest level first; equal levels in the order of OWN.

    An average that is null or not positive gives no row. Sorted inside the ticker's row, so nothing is shuffled.
    """
    close, rows = F.col("close"), []
    for h, means in OWN.items():
        at = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(name).alias("basis"), F.col(c).alias("v")) for i, (name, c) in enumerate(means)])
        for side, sign in (("support", -1), ("resistance", 1)):
            here = F.filter(at, lambda x: (x["v"] > 0) & ((x["v"] < close) if side == "support" else (x["v"] >= close)))  # noqa: B023
            shown = lambda x: F.struct((F.round(x["v"], 0) * sign).alias("key"), x["order"].alias("order"), x["basis"].alias("basis"), F.round(x["v"], 0).alias("level"), cents(F.abs(x["v"] - close) / close * 100).alias("distance_pct"))  # noqa: B023, E731
            rows.append(F.struct(F.lit(h).alias("horizon"), F.lit(side).alias("side"), F.array_sort(F.transform(here, shown)).alias("found")))
    df = feats.select("ticker", F.explode(F.array(*rows)).alias("x")).select("ticker", "x.horizon", "x.side", F.posexplode("x.found").alias("at", "y"))
    return df.select("ticker", "horizon", "side", (F.col("at") + 1).cast("bigint").alias("ordinal"), "y.basis", "y.level", "y.distance_pct")


def perspectives(bars: DataFrame) -> DataFrame:
    """For each horizon its state, the levels to watch, what would confirm it, and what is at risk.

    Levels are the nearest ones of the horizon's own averages, else the nearest zones of the ticker.
    """
    feats = scoring.features(bars)
    verdict = scoring.verdicts(scoring.components(feats))
    zones = levels.level_clusters(levels.level_candidates(bars))
    side = lambda name: F.when(F.col("side") == name, F.struct("level", "basis"))
    near = zones.groupBy("ticker").agg(F.max(side("support")).alias("zs"), F.min(side("resistance")).alias("zr"))
    df = verdict.join(own_levels(feats), ["ticker", "horizon"]).join(near, "ticker", "left")
    pick = lambda own, zone, k: F.coalesce(F.col(f"{own}.{k}"), F.col(f"{zone}.{k}"))
    df = df.select("ticker", "horizon", "strength", "confidence", "missing", "zs", "zr", *[pick(o, z, k).alias(f"{name}{end}") for o, z, name in (("s", "zs", "support"), ("r", "zr", "resistance")) for k, end in (("level", ""), ("basis", "_basis"))])
    bias = F.coalesce(scoring.bias_of(F.col("strength")), F.lit(0))
    of = lambda level, basis: F.concat(level.cast("bigint").cast("string"), F.lit(" ("), basis, F.lit(")"))
    s, r = of(F.col("support"), F.col("support_basis")), of(F.col("resistance"), F.col("resistance_basis"))
    confirmation = F.when(bias > 0, F.coalesce(F.concat(F.lit("close above "), r), F.lit("above all levels"))).when(bias < 0, F.coalesce(F.concat(F.lit("close back above "), r), F.lit("no level above"))).otherwise(F.coalesce(F.concat(r, F.lit(" or "), s), F.lit("no levels on both sides")))
    overturns = F.when(bias > 0, F.concat(F.lit("close below "), of(F.col("zs.level"), F.col("zs.basis")))).when(bias < 0, F.concat(F.lit("close above "), of(F.col("zr.level"), F.col("zr.basis"))))
    risk = F.coalesce(overturns, F.when(bias != 0, F.concat(F.lit("close below "), s)), F.lit("no direction"))
    return df.select("ticker", "horizon", F.concat(F.replace("strength", F.lit("_"), F.lit(" ")), F.lit(", confidence "), "confidence").alias("state"), "support", "support_basis", "resistance", "resistance_basis", confirmation.alias("confirmation"), risk.alias("risk"), "missing")


def compare_pivot(bars: DataFrame) -> DataFrame:
    """The three comparison tables side by side."""
    stats = scoring.compare_52w(bars).select("ticker", "excluded", "return_pct", "max_drawdown_pct", "from_low_pct")
    return stats.join(scoring.compare_ma(bars), "ticker").join(scoring.compare_levels(bars), "ticker")
