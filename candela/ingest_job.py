"""Ingest of daily records as a job: ``spark-submit candela/ingest_job.py --file feed.json --table bars``.

Good records go as a new batch to a Parquet log, of which ``streaming.sessions.read_upserted`` gives the newest row of each
ticker and date. Prints a summary and the first rejected records.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from candela.sources import feeds, ingest

SHOWN = 20


def ingested(raw: DataFrame, table: str) -> tuple[dict, list]:
    """Writes the good records of ``raw`` to the log; the summary, and the first rejected records."""
    parsed = ingest.parse(raw).cache()
    try:
        rows = ingest.dedupe_last(ingest.good(parsed), "ticker", "date").drop("seq", "replaced")
        rows.write.mode("overwrite").parquet(f"{table}/batch={time.time_ns()}")
        return ingest.summary(parsed).first().asDict(), ingest.rejected(parsed).orderBy("seq").limit(SHOWN).collect()
    finally:
        parsed.unpersist()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Ingest daily trading statistics.")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--file", help="saved responses (JSON): a file, a folder or a pattern")
    source.add_argument("--symbols", help="symbols to ask the provider for, with commas")
    parser.add_argument("--provider", help="module:function, from symbol to response")
    parser.add_argument("--table", required=True, help="folder of the Parquet log")
    args = parser.parse_args(argv)
    if args.symbols and not args.provider:
        parser.error("--symbols needs --provider")
    spark = spark or SparkSession.builder.appName("candela-ingest").getOrCreate()
    if args.file:
        raw = feeds.read_envelopes(spark, args.file)
    else:
        spark.dataSource.register(feeds.FeedDataSource)
        raw = spark.read.format("candela_feed").option("symbols", args.symbols).option("provider", args.provider).load()
    summary, rejected = ingested(raw, args.table)
    print(", ".join(f"{k} {v}" for k, v in summary.items()))
    for r in rejected:
        print(f"  rejected {r.ticker} {r.date}: {r.reject_reason}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
