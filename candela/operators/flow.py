"""Order flow, foreign flow and the quality of the daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import TICKER, W, cases, cents, full, full_avg, lag, latest, pct, prior_avg, r2, r6, ratio, recent

def CUMULATIVE():
    return W().rowsBetween(Window.unboundedPreceding, 0)


def imbalance(buy: str, sell: str) -> Column:
    return ratio(F.col(buy) - F.col(sell), F.col(buy) + F.col(sell))


def bias(x: Column) -> Column:
    return cases((x.isNull(), "unknown"), (x > 0.05, "buy_side"), (x < -0.05, "sell_side"), otherwise="balanced")


def volume_imbalance(bars: DataFrame, n: int = 5) -> DataFrame:
    df = latest(bars.select("ticker", "date", imbalance("buy_volume", "sell_volume").alias("x")).withColumn("m", full_avg("x", n)))
    return df.select("ticker", "date", r6("x").alias("imbalance"), r6("m").alias("mean"), bias(F.col("m")).alias("bias"))


def count_imbalance(bars: DataFrame, n: int = 5) -> DataFrame:
    df = latest(bars.select("ticker", "date", imbalance("buy_count", "sell_count").alias("x")).withColumn("m", full_avg("x", n)))
    return df.select("ticker", "date", r6("x").alias("imbalance"), r6("m").alias("mean"))


def prev_close_mismatch(bars: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Rows whose prev_close differs from the prior close by more than the tolerance."""
    df = bars.select("ticker", "date", "prev_close", lag("close").alias("prior_close"))
    return df.where(F.abs(F.col("prev_close") - F.col("prior_close")) > tolerance * F.col("prior_close")).select("ticker", "date", r6("prev_close").alias("prev_close"), r6("prior_close").alias("prior_close"), r6(ratio("prior_close", "prev_close")).alias("ratio"))


def obv_rows(bars: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """On-balance volume of each row; null for tickers with an unusable prev_close."""
    step = (F.signum(F.col("close") - F.col("prev_close")) * F.col("total_volume")).cast("double")
    df = bars.withColumn("prior", lag("close")).withColumn("wrong", (F.col("prev_close").isNull() | (F.col("prev_close") <= 0) | F.coalesce(F.abs(F.col("prev_close") - F.col("prior")) > tolerance * F.col("prior"), F.lit(False))).cast("int"))
    df = df.withColumn("refused", F.max("wrong").over(TICKER())).withColumn("move", F.signum(F.col("close") - F.col("prev_close"))).withColumn("rows", F.count(F.lit(1)).over(TICKER())).withColumn("i", F.row_number().over(W()))
    return df.withColumn("obv", F.when(F.col("refused") == 0, F.sum(step).over(CUMULATIVE())))


def obv(bars: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Latest OBV and its change over min(rows - 1, 20) rows."""
    df = obv_rows(bars, tolerance).withColumn("back", F.least(F.col("rows") - 1, F.lit(20)))
    first = F.first(F.when(F.col("i") == F.col("rows") - F.col("back"), F.col("obv")), ignorenulls=True).over(W().rowsBetween(-20, 0))
    return latest(df.withColumn("was", first)).where("rows >= 2").select("ticker", "date", "obv", (F.col("obv") - F.col("was")).alias("change"))


def obv_direction_counts(bars: DataFrame) -> DataFrame:
    return obv_rows(bars).groupBy("ticker").agg(F.count_if(F.col("move") > 0).alias("up"), F.count_if(F.col("move") < 0).alias("down"), F.count_if(F.col("move") == 0).alias("flat"))


def obv_divergence(bars: DataFrame, windows=(20, 60)) -> DataFrame:
    df = obv_rows(bars)
    for n in windows:
        p, o = pct("close", lag("close", n)), F.col("obv") - lag("obv", n)
        df = df.withColumn(f"divergence_{n}", cases((p.isNull() | o.isNull(), None), ((p > 2) & (o < -1_000_000), "bearish_divergence"), ((p < -2) & (o > 1_000_000), "bullish_divergence"), otherwise="in_sync"))
    return latest(df).select("ticker", "date", *[f"divergence_{n}" for n in windows])


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    df = latest(bars.select("ticker", "date", ratio("total_volume", prior_avg("total_volume", n)).alias("x")))
    x = F.col("x")
    return df.select("ticker", "date", r6("x").alias("ratio"), cases((x.isNull(), None), (x >= 2, "very_high"), (x >= 1.5, "elevated"), (x <= 0.5, "very_low"), (x <= 0.7, "low"), otherwise="normal").alias("flag"))


def volume_spikes(bars: DataFrame, n: int = 20) -> DataFrame:
    """Days of volume over 1.5 times the mean of the 20 before, among the last 20 and 60 rows, by direction of the day."""
    df = bars.select("ticker", "date", (F.col("total_volume") > 1.5 * prior_avg("total_volume", n)).alias("spike"), F.signum(F.col("close") - lag("close")).alias("move"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("k"))
    count = lambda n, more: F.count_if(F.expr(f"k <= {n} AND spike AND {more}"))
    return df.groupBy("ticker").agg(*[count(k, m).alias(f"spikes_{k}_{name}") for k in (20, 60) for name, m in (("up", "move > 0"), ("down", "move < 0"), ("all", "true"))])


def trade_size_by_side(bars: DataFrame, n: int = 20) -> DataFrame:
    """Shares a trade on each side, in lots, against the mean of the n rows before."""
    df = bars.select("ticker", "date", ratio("buy_volume", "buy_count").alias("b"), ratio("sell_volume", "sell_count").alias("s"))
    df = latest(df.withColumn("br", ratio("b", prior_avg("b", n))).withColumn("sr", ratio("s", prior_avg("s", n))))
    x, br, sr = ratio("b", "s"), F.col("br"), F.col("sr")
    reading = cases((br.isNull() | sr.isNull(), "unknown"), ((br >= 1.3) & (sr >= 1.3), "larger_tickets_both_sides"), (br >= 1.3, "larger_buy_tickets"), (sr >= 1.3, "larger_sell_tickets"), otherwise="ordinary_ticket_sizes")
    return df.select("ticker", "date", r6(F.col("b") / 100).alias("buy_lots"), r6(F.col("s") / 100).alias("sell_lots"), r6("br").alias("buy_ratio"), r6("sr").alias("sell_ratio"), r6(x).alias("buy_vs_sell"), reading.alias("reading"))


def avg_trade_value(bars: DataFrame, n: int = 20) -> DataFrame:
    df = bars.select("ticker", "date", ratio("total_value", "total_trade").alias("v"))
    df = latest(df.withColumn("x", ratio("v", prior_avg("v", n))))
    x = F.col("x")
    return df.select("ticker", "date", r2("v").alias("value"), r6("x").alias("ratio"), cases((x.isNull(), "unknown"), (x >= 1.5, "unusually_large_tickets"), (x <= 0.66, "unusually_small_tickets"), otherwise="normal").alias("reading"))


def value_spike(bars: DataFrame, n: int = 20) -> DataFrame:
    df = latest(bars.select("ticker", "date", ratio("total_value", prior_avg("total_value", n)).alias("x")))
    x = F.col("x")
    return df.select("ticker", "date", r6("x").alias("ratio"), cases((x.isNull(), "unknown"), (x >= 2, "value_spike"), (x >= 1.5, "elevated_value"), (x <= 0.5, "value_drought"), otherwise="normal").alias("flag"))


def prior_average(bars: DataFrame, column: str = "total_volume", n: int = 20) -> DataFrame:
    return bars.select("ticker", "date", r2(prior_avg(column, n)).alias("prior_average"), r6(ratio(column, prior_avg(column, n))).alias("ratio"))


def foreign_net_volume(bars: DataFrame) -> DataFrame:
    net = F.col("foreign_buy_volume") - F.col("foreign_sell_volume")
    return bars.select("ticker", "date", net.alias("net_volume")).withColumn("cumulative", F.sum("net_volume").over(CUMULATIVE()))


def stance_of(x: Column) -> Column:
    return cases((x.isNull(), "unknown"), (x > 0, "net_buying"), (x < 0, "net_selling"), otherwise="flat")


def foreign_net_value(bars: DataFrame, windows=(20, 60, 120)) -> DataFrame:
    """Net value of the latest row, cumulative with its stance, and over windows that shorten to the rows there are."""
    df = bars.withColumn("net", F.col("foreign_buy_value") - F.col("foreign_sell_value")).withColumn("i", F.row_number().over(W()))
    cols = [F.sum("net").over(CUMULATIVE()).alias("cumulative")]
    for n in windows:
        w = W().rowsBetween(-(n - 1), 0)
        cols += [F.sum("net").over(w).alias(f"net_{n}"), F.count_if(F.col("net") > 0).over(w).alias(f"buying_{n}"), F.count_if(F.col("net") < 0).over(w).alias(f"selling_{n}"), F.count(F.lit(1)).over(w).alias(f"rows_{n}")]
    df = latest(df.select("ticker", "date", "net", *cols))
    stance = stance_of(F.col("cumulative"))
    return df.select("ticker", "date", r2("net").alias("net"), r2("cumulative").alias("cumulative"), stance.alias("stance"), *[x for n in windows for x in (r2(f"net_{n}").alias(f"net_{n}"), F.col(f"buying_{n}"), F.col(f"selling_{n}"), F.col(f"rows_{n}"))])


def foreign_participation(bars: DataFrame, n: int = 20) -> DataFrame:
    df = bars.select("ticker", "date", ratio(F.col("foreign_buy_volume") + F.col("foreign_sell_volume"), "total_volume").alias("x"))
    return latest(df.withColumn("m", full_avg("x", n))).select("ticker", "date", r6("x").alias("participation"), r6("m").alias("mean"))


def foreign_room_trend(bars: DataFrame, n: int = 20) -> DataFrame:
    df = bars.select("ticker", "date", "foreign_room", (F.col("foreign_room") - lag("foreign_room")).alias("d"))
    df = latest(df.withColumn("x", full(F.sum, "d", n)))
    x = F.col("x")
    return df.select("ticker", "date", "foreign_room", x.alias("change"), cases((x.isNull(), "unknown"), (x < 0, "room_shrinking_foreign_accumulation"), (x > 0, "room_growing_foreign_divestment"), otherwise="room_unchanged").alias("reading"))


def unexplained_room() -> Column:
    """Room move of a row that its foreign net volume does not explain; null within the tolerance."""
    move = F.col("foreign_room") - lag("foreign_room") + F.col("foreign_buy_volume") - F.col("foreign_sell_volume")
    return F.when(F.abs(move) > F.greatest(0.05 * F.col("total_volume"), F.lit(1000.0)), move)


def room_structural(bars: DataFrame) -> DataFrame:
    """Room moves that flow does not explain: the first ten of each ticker."""
    df = bars.select("ticker", "date", unexplained_room().alias("unexplained")).where("unexplained IS NOT NULL")
    return df.withColumn("ordinal", F.row_number().over(W()).cast("bigint")).where("ordinal <= 10").select("ticker", "date", "ordinal", "unexplained")


def zero_foreign_days(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count_if(F.expr("foreign_buy_volume = 0 AND foreign_sell_volume = 0")).alias("days"), F.count(F.lit(1)).alias("rows"))


def flow_summary(bars: DataFrame, n: int = 20) -> DataFrame:
    """Latest scalars of the flow groups over n rows, with the three notes on them as flags and a count (ten at most).

    Foreign flow is against the matched flow if the cumulative foreign net value and the volume bias have opposite sides.
    """
    net = F.col("foreign_buy_value") - F.col("foreign_sell_value")
    df = bars.select("ticker", "date", imbalance("buy_volume", "sell_volume").alias("v"), imbalance("buy_count", "sell_count").alias("c"), net.alias("net"), ratio(F.col("foreign_buy_volume") + F.col("foreign_sell_volume"), "total_volume").alias("p"), (F.col("foreign_room") - lag("foreign_room")).alias("d"), unexplained_room().alias("u"))
    df = latest(df.select("ticker", "date", full_avg("v", n).alias("v"), full_avg("c", n).alias("c"), F.sum("net").over(CUMULATIVE()).alias("cum"), F.sum("net").over(W().rowsBetween(-(n - 1), 0)).alias("net"), full_avg("p", n).alias("p"), full(F.sum, "d", n).alias("room"), F.count("u").over(CUMULATIVE()).alias("moves")))
    stance, side = stance_of(F.col("cum")), bias(F.col("v"))
    against = (stance == "net_buying") & (side == "sell_side") | (stance == "net_selling") & (side == "buy_side")
    return df.select("ticker", "date", r6("v").alias("volume_imbalance"), r6("c").alias("count_imbalance"), r2("cum").alias("foreign_net_value_cum"), r2("net").alias("foreign_net_value"), r6("p").alias("foreign_participation"), F.col("room").alias("room_change"),
        against.alias("flow_against_foreign"), F.coalesce(F.col("v") * F.col("c") < 0, F.lit(False)).alias("volume_against_count"), F.least(F.col("moves"), F.lit(10).cast("bigint")).alias("structural_moves"))


def latest_session(bars: DataFrame) -> DataFrame:
    return latest(bars).select("ticker", "date", r6("close").alias("close"), r6(pct("close", "prev_close")).alias("change_pct"), r6(F.col("total_volume") / 1e6).alias("volume_mil"), r6(F.col("total_value") / 1e9).alias("value_bil"), r6((F.col("foreign_buy_value") - F.col("foreign_sell_value")) / 1e9).alias("foreign_net_bil"))


def recent_history(bars: DataFrame, n: int = 5) -> DataFrame:
    return recent(bars, n).select("ticker", "date", r6("close").alias("close"), r6(pct("close", "prev_close")).alias("change_pct"), r6(F.col("total_volume") / 1e6).alias("volume_mil"), r6((F.col("foreign_buy_value") - F.col("foreign_sell_value")) / 1e9).alias("foreign_net_bil"))


def price_limit_flag(bars: DataFrame) -> DataFrame:
    """near_ceiling or near_floor from a rounded change of 6.5 percent on."""
    df = latest(bars).select("ticker", "date", F.when(F.col("prev_close") > 0, cents(pct("close", "prev_close"))).alias("change_pct"))
    x = F.col("change_pct")
    return df.withColumn("flag", cases((x >= 6.5, "near_ceiling"), (x <= -6.5, "near_floor"), otherwise=None))


def calendar_gaps(bars: DataFrame, days: int = 5) -> DataFrame:
    """Neighbouring dates more than five days apart: the count and the first ten of each ticker."""
    df = bars.select("ticker", "date", lag("date").alias("previous")).withColumn("days", F.datediff("date", "previous").cast("bigint")).where(F.col("days") > days)
    df = df.withColumn("ordinal", F.row_number().over(W()).cast("bigint")).withColumn("gaps", F.count(F.lit(1)).over(TICKER()))
    return df.where("ordinal <= 10").select("ticker", "previous", "date", "days", "ordinal", "gaps")


def zero_volume_days(bars: DataFrame) -> DataFrame:
    return bars.where("total_volume IS NULL OR total_volume <= 0").select("ticker", "date")


def data_quality(bars: DataFrame) -> DataFrame:
    """Rows, gaps, halts and suspected corporate actions of each ticker, with a warning flag for each."""
    df = bars.select("ticker", (F.datediff("date", lag("date")) > 5).alias("gap"), F.expr("total_volume IS NULL OR total_volume <= 0").alias("halt"), (F.abs(F.col("prev_close") - lag("close")) > 0.005 * lag("close")).alias("action"))
    g = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"{c}s") for c in ("gap", "halt", "action")])
    return g.select("*", *[(F.col(f"{c}s") > 0).alias(f"warn_{c}") for c in ("gap", "halt", "action")])
