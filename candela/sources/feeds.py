"""Feeds: JSON envelopes, SOAP/XML items, REST items, and a pluggable Python data source."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from .ingest import FIELDS, as_date, as_float, as_int, as_number


def records(value) -> Iterator[dict]:
    """The records inside any envelope: a dict with a Symbol; lists, dicts and JSON in text are opened."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
            try:
                todo.append(json.loads(x))
            except ValueError:
                continue
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if "Symbol" in x:
                yield x
            else:
                todo += reversed([v for v in x.values() if isinstance(v, (dict, list, str))])


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Raw text records (the columns of FIELDS, with ``seq``) of JSON files; a file is one task's unit."""
    names = list(FIELDS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(records(text))
                cols = [[None if r.get(n) is None else str(r[n]) for r in found] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), *[pa.array(c, pa.string()) for c in cols]], names=["file", "seq", *names])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInArrow(run, "file string, seq long, " + ", ".join(f"`{n}` string" for n in names))


def read_xml_items(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements named ``tag`` of SOAP or plain XML files, all children as text by the schema."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(schema).load(path)


def soap_items(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements named ``tag`` of SOAP responses; a fault in any of them fails the read with its text."""
    items = read_xml_items(spark, path, tag, schema)
    said = F.coalesce(F.nullif(F.trim("faultstring"), F.lit("")), F.nullif(F.trim("faultcode"), F.lit("")), F.lit("SOAP Fault occurred"))
    failed = xml_faults(spark, path).select(F.raise_error(F.concat(F.lit("SOAP Fault: "), said)).alias("fault"))
    return items.unionByName(failed.select(*[F.col("fault").cast(f.dataType).alias(f.name) for f in items.schema.fields]))


def xml_faults(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_items(spark, path, "Fault", "faultcode string, faultstring string")


#: Names of the exchanges in the feed and of their indices.
INDEX_OF = {"HOSTC": "VNINDEX", "HSX": "VNINDEX", "HASTC": "HNX"}


def rest_items(responses: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Items of responses {"success": .., "data": [..]}; responses without success give none."""
    parsed = responses.select(F.from_json(body, f"success boolean, data array<struct<{schema}>>").alias("r"))
    return parsed.where("r.success").select(F.explode("r.data").alias("x")).select("x.*")


def rest_history(responses: DataFrame) -> DataFrame:
    """Daily bars of the history service; all fields come as text."""
    t = "Symbol:string,Date:string,Open:string,High:string,Low:string,Close:string,Basic:string,Volume:string,DealVolume:string,TotalValue:string,TotalTrade:string,BuyForeignVolume:string,SellForeignVolume:string,CurrentForeignRoom:string,BuyQuantity:string,SellQuantity:string"
    c = F.col
    return rest_items(responses, t).select(
        F.upper("Symbol").alias("ticker"), as_date(c("Date")).alias("date"), as_number(c("Basic")).alias("prev_close"), *[as_number(c(k)).alias(k.lower()) for k in ("Open", "High", "Low", "Close")],
        as_int(F.coalesce(c("Volume"), c("DealVolume"))).alias("total_volume"), as_float(c("TotalValue")).alias("total_value"), as_int(c("TotalTrade")).alias("total_trade"),
        as_int(c("BuyQuantity")).alias("buy_volume"), as_int(c("SellQuantity")).alias("sell_volume"), as_int(c("BuyForeignVolume")).alias("foreign_buy_volume"), as_int(c("SellForeignVolume")).alias("foreign_sell_volume"), as_int(c("CurrentForeignRoom")).alias("foreign_room"),
    )


def rest_market(responses: DataFrame) -> DataFrame:
    """Index rows of the market service, by the name of the index."""
    t = "Exchange:string,Date:string,IndexCurrent:string,IndexChange:string,IndexPercentChange:string,Advances:string,Declines:string,Unchange:string,TotalVolume:string,TotalValue:string,TotalTrade:string"
    c, names = F.col, F.create_map(*[F.lit(x) for kv in INDEX_OF.items() for x in kv])
    return rest_items(responses, t).select(
        F.coalesce(F.try_element_at(names, F.upper("Exchange")), F.upper("Exchange")).alias("exchange"), as_date(c("Date")).alias("date"), as_number(c("IndexCurrent")).alias("index_current"), as_number(c("IndexChange")).alias("index_change"), as_number(c("IndexPercentChange")).alias("index_percent_change"),
        *[as_int(c(k)).alias(n) for k, n in (("TotalTrade", "total_trade"), ("TotalVolume", "total_volume"), ("Advances", "advances"), ("Declines", "declines"), ("Unchange", "unchanged"))], as_float(c("TotalValue")).alias("total_value"),
    )


def rest_quotes(responses: DataFrame) -> DataFrame:
    """Current quotes: prices, change against the reference price, the day's volumes, first bid and ask. A quote without one price counts with the next."""
    names = "Symbol Name Exchange Date PriceBasic PriceCurrent PriceLast PriceClose PriceCeiling PriceFloor PriceOpen PriceHigh PriceLow Volume TotalVolume TotalValue BuyForeignQuantity SellForeignQuantity CurrentForeignRoom PriceBid1 QuantityBid1 PriceAsk1 QuantityAsk1".split()
    c = F.col
    given = lambda k: F.when(~F.trim(c(k)).isin("", "0"), c(k))
    df = rest_items(responses, ",".join(f"{n}:string" for n in names)).withColumn("basic", as_float(c("PriceBasic"))).withColumn("now", as_float(F.coalesce(given("PriceCurrent"), given("PriceLast"), c("PriceClose"))))
    change = F.when(c("basic") > 0, c("now") - c("basic")).otherwise(0.0)
    level = lambda side: F.struct(as_float(c(f"Price{side}1")).alias("price"), as_int(c(f"Quantity{side}1")).alias("volume"))
    return df.select(
        F.upper("Symbol").alias("ticker"), c("Name").alias("name"), c("Exchange").alias("exchange"), c("Date").alias("timestamp"), c("basic").alias("price_basic"),
        *[as_float(c(f"Price{k.title()}")).alias(f"price_{k}") for k in ("ceiling", "floor", "open", "high", "low")], c("now").alias("price_current"), F.round(change, 3).alias("change"),
        F.round(F.when(c("basic") > 0, change / c("basic") * 100).otherwise(0.0), 2).alias("percent_change"), as_int(c("Volume")).alias("volume_last_tick"), as_int(c("TotalVolume")).alias("accumulated_volume"), as_float(c("TotalValue")).alias("accumulated_value"),
        as_int(c("BuyForeignQuantity")).alias("foreign_buy_volume"), as_int(c("SellForeignQuantity")).alias("foreign_sell_volume"), as_int(c("CurrentForeignRoom")).alias("foreign_room"), level("Bid").alias("bid_1"), level("Ask").alias("ask_1"),
    )


class FeedReader(DataSourceReader):
    """One request and one task for each symbol."""

    def __init__(self, options: dict):
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.provider = options["provider"]

    def partitions(self):
        # Spark takes an empty list for one task without a partition
        return [InputPartition(s) for s in self.symbols] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        module, _, name = self.provider.partition(":")
        for i, r in enumerate(records(getattr(importlib.import_module(module), name)(partition.value))):
            yield (i, *[None if r.get(n) is None else str(r[n]) for n in FIELDS])


class FilteredFeedReader(FeedReader):
    """Asks only for the symbols that the query's filters leave."""

    def pushFilters(self, filters):
        """Filters on Symbol narrow the requests; Spark applies them too, as a response may hold other symbols."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("Symbol",):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif isinstance(f, In) and f.attribute == ("Symbol",):
                self.symbols = [s for s in self.symbols if s in f.value]
            yield f


class FeedStreamReader(DataSourceStreamReader):
    """Each batch asks the provider once for every symbol, one task a symbol.

    Offsets are times in nanoseconds, so they never go back, also after a restart. A batch that is run again asks again:
    quotes are live. Where each response must count once, use :func:`land` and :func:`landed`.
    """

    def __init__(self, options: dict):
        self.batch = FeedReader(options)
        self.last = 0

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        self.last = max(self.last + 1, time.time_ns())
        return {"at": self.last}

    def partitions(self, start, end):
        self.last = max(self.last, start["at"], end["at"])
        return self.batch.partitions()

    def read(self, partition):
        return self.batch.read(partition)


def land(spark: SparkSession, symbols: list[str], provider: str, folder: str) -> None:
    """Ask the provider for each symbol once, and add the records to a landing folder, all of them or none."""
    spark.dataSource.register(FeedDataSource)
    df = spark.read.format("candela_feed").option("symbols", ",".join(symbols)).option("provider", provider).load()
    df.withColumn("polled", F.lit(time.time_ns())).write.mode("append").parquet(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the landed records. Its offsets are the files, logged in the checkpoint: a batch that is run again reads
    the same responses, and a restart goes on with the first file not yet read."""
    return spark.readStream.schema(f"{FeedDataSource.SCHEMA}, polled long").parquet(folder)


class FeedDataSource(DataSource):
    """``spark.read.format("candela_feed")``: option ``provider`` ("module:function", symbol -> response) is called once for each of ``symbols``, each in a task of its own.

    With option ``pushdown``, filters on Symbol leave out requests; Spark needs ``spark.sql.python.filterPushdown.enabled`` for it.
    ``spark.readStream.format("candela_feed")`` calls the provider again for each batch.
    """

    SCHEMA = "seq long, " + ", ".join(f"{n} string" for n in FIELDS)

    @classmethod
    def name(cls):
        return "candela_feed"

    def schema(self):
        return self.SCHEMA

    def reader(self, schema):
        return (FilteredFeedReader if self.options.get("pushdown", "false") == "true" else FeedReader)(self.options)

    def streamReader(self, schema):
        return FeedStreamReader(self.options)
