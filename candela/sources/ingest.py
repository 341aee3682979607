"""Cleaning of raw feed records: all fields are text; bad records are kept with a reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Texts that mean "no value" in the feed.
BLANKS = ["", "-", "--", "N/A", "n/a", "null", "NULL"]
#: Date layouts of the feed, in the order they are tried.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "yyyyMMdd", "d/M/yy"]
#: Field names of the feed and of the stored table.
FIELDS = {
    "Symbol": "ticker", "Date": "date", "PricePreviousClose": "prev_close", "PriceOpen": "open", "Open": "open", "PriceHigh": "high", "High": "high", "PriceLow": "low", "Low": "low",
    "PriceClose": "close", "TotalTrade": "total_trade", "TotalVolume": "total_volume", "TotalValue": "total_value", "BuyCount": "buy_count", "SellCount": "sell_count",
    "BuyQuantity": "buy_volume", "SellQuantity": "sell_volume", "ForeignerBuyQuantity": "foreign_buy_volume", "ForeignerSellQuantity": "foreign_sell_volume",
    "ForeignerBuyValue": "foreign_buy_value", "ForeignerSellValue": "foreign_sell_value", "CurrentForeignRoom": "foreign_room",
}
INTS = ["total_trade", "total_volume", "buy_count", "sell_count", "buy_volume", "sell_volume", "foreign_buy_volume", "foreign_sell_volume", "foreign_room"]
FLOATS = ["total_value", "foreign_buy_value", "foreign_sell_value"]


def clean(text: Column) -> Column:
    """The text without separators and blanks; null if it stands for no value."""
    t = F.translate(F.trim(text), ", \u00a0", "")
    return F.when(t.isin(BLANKS), None).otherwise(t)


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def as_number(text: Column) -> Column:
    return finite(clean(text).try_cast("double"))


def as_float(text: Column) -> Column:
    return F.coalesce(as_number(text), F.lit(0.0))


def as_int(text: Column) -> Column:
    """Truncated towards zero; 0 where there is no number, or one beyond 64 bits."""
    return F.coalesce(as_number(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def as_date(text: Column) -> Column:
    day = F.split_part(F.split_part(F.trim(text), F.lit("T"), F.lit(1)), F.lit(" "), F.lit(1))
    # a layout is only tried on text of its shape: failing to parse is slow
    digits = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    shape = lambda f: "^" + re.sub("yyyy|yy|MM|dd|M|d", lambda m: digits[m[0]], f) + "$"
    return F.coalesce(*[F.when(day.rlike(shape(f)), F.try_to_timestamp(day, F.lit(f))).cast("date") for f in DATE_FORMATS])


def parse(raw: DataFrame) -> DataFrame:
    """Typed records with ``reject_reason`` (null: good). ``raw`` has text columns named as in FIELDS, and ``seq``, the input order.

    A count beyond 64 bits is a reason too. The reason passes through a generator: a filter on it stays above, where it
    reads a value; merged into the projection it would repeat all the cleaning.
    """
    have = {}
    for name, to in FIELDS.items():
        if name in raw.columns:
            have.setdefault(to, []).append(F.col(name))
    # in stages, so that no expression repeats the cleaning of another
    text = raw.select("seq", F.col("Date").alias("day"), *[F.coalesce(*[clean(c) for c in cols]).alias(f"t_{to}") for to, cols in have.items() if to != "date"])
    get = lambda k: F.col(f"t_{k}") if k in have else F.lit(None).cast("string")
    prices = ("prev_close", "close", "open", "high", "low")
    cast = text.select("seq", F.upper(get("ticker")).alias("ticker"), as_date(F.col("day")).alias("date"), *[get(c).isNotNull().alias(f"has_{c}") for c in prices], *[get(c).try_cast("double").alias(c) for c in (*prices, *INTS, *FLOATS)])
    number = cast.select("seq", "ticker", "date", *[f"has_{c}" for c in prices], *[finite(F.col(c)).alias(c) for c in (*prices, *INTS, *FLOATS)])
    typed = number.select("seq", "ticker", "date", *[f"has_{c}" for c in prices], *prices, *[(F.col(c).isNotNull() & F.col(c).try_cast("bigint").isNull()).alias(f"over_{c}") for c in INTS], *[F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in INTS], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FLOATS])
    reason = F.when(F.col("ticker").isNull(), "missing ticker").when(F.col("date").isNull(), "bad date")
    for c in ("prev_close", "close"):
        reason = reason.when(F.col(c).isNull() | (F.col(c) <= 0), f"bad {c}")
    for c in ("open", "high", "low"):
        reason = reason.when(F.col(f"has_{c}") & (F.col(c).isNull() | (F.col(c) <= 0)), f"bad {c}")
    for c in INTS:
        reason = reason.when(F.col(f"over_{c}"), f"bad {c}")
    shown = ["seq", "ticker", "date", *prices, *INTS, *FLOATS]
    return typed.select(*shown, reason.alias("reason")).select(*shown, F.explode(F.array("reason")).alias("reject_reason"))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL").drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL").select("seq", "ticker", "date", "reject_reason")


def warnings(parsed: DataFrame) -> DataFrame:
    """(seq, ticker, date, warning): sums that do not agree. They reject nothing."""
    off = lambda cond, name: F.when(F.expr(cond), F.lit(name))
    found = F.array_compact(F.array(
        off("total_volume <> 0 AND buy_volume + sell_volume <> total_volume", "volume"),
        off("total_trade <> 0 AND buy_count + sell_count <> total_trade", "trades"),
        off("total_volume <> 0 AND foreign_buy_volume + foreign_sell_volume > total_volume", "foreign"),
    ))
    return good(parsed).select("seq", "ticker", "date", F.explode(found).alias("warning"))


def dedupe_last(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the highest seq for each key, and how many rows it replaced."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("seq")))).withColumn("replaced", F.count(F.lit(1)).over(w) - 1).where("k = 1").drop("k")


def summary(parsed: DataFrame) -> DataFrame:
    ok = F.col("reject_reason").isNull()
    return parsed.agg(F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("rejected"), F.countDistinct(F.when(ok, F.struct("ticker", "date"))).alias("written"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(ok, F.col("ticker"))))).alias("tickers"))
