"""Session bars in order of arrival: a bar forms tick by tick, closes when a later session begins, and is emitted at each change.

Other than :func:`~candela.streaming.sessions.session_bars`, which follows event time, open and close here are the first and
the last tick that arrived, and a session's volume is what the accumulated volume of the last tick exceeds the sum of the earlier
sessions' volumes by, as they stood when it arrived. State is one map of at most four bars for each (ticker, date). A timer on
the watermark closes a day's bars and drops its state; ticks that come after that would begin the day anew, so they are left
out by the watermark. Equal ticks change nothing but for what they say; a tick without time, price or session is left out.

Restarts: state and timers are in the checkpoint, so a restarted query goes on where it stopped. It needs the state store
of RocksDB (``spark.sql.streaming.stateStore.providerClass``), as all of ``transformWithState`` does.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import SESSIONS, session_ticks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "open double, high double, low double, close double, volume bigint, value double, is_closed boolean"
OUT = f"ticker string, date date, session_index int, datetime timestamp_ntz, {BAR}"
NAMES = ("open", "high", "low", "close", "volume", "value", "is_closed")


class DayOfBars(StatefulProcessor):
    """The bars of one (ticker, date)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "session_index int", BAR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ticker, date = key
        now = {k[0]: dict(zip(NAMES, v, strict=True)) for k, v in self.bars.iterator()}
        touched = set()
        for r in sorted(rows, key=lambda r: r.seq):  # what one trigger brings of a key, in the order it arrived
            s = r.session_index
            before = [b for k, b in now.items() if k < s]
            volume = max(0, r.accumulated_volume - sum(b["volume"] for b in before))
            value = max(0.0, r.accumulated_value - sum(b["value"] for b in before))
            old = now.get(s)
            now[s] = {
                "open": old["open"] if old else r.price, "high": max(old["high"], r.price) if old else r.price, "low": min(old["low"], r.price) if old else r.price,
                "close": r.price, "volume": volume, "value": value, "is_closed": bool(old and old["is_closed"]),
            }
            touched.add(s)
            for k, b in now.items():
                if k < s and not b["is_closed"]:
                    b["is_closed"] = True
                    touched.add(k)
        for s in sorted(touched):
            self.bars.updateValue((s,), tuple(now[s][c] for c in NAMES))
            yield self.row(ticker, date, s, now[s])
        if not any(True for _ in self.handle.listTimers()):
            day_over = datetime.datetime.combine(date + datetime.timedelta(days=1), datetime.time(), datetime.UTC)
            self.handle.registerTimer(int(day_over.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ticker, date = key
        for k, v in sorted(self.bars.iterator()):
            bar = dict(zip(NAMES, v, strict=True))
            if not bar["is_closed"]:
                yield self.row(ticker, date, k[0], bar | {"is_closed": True})
        self.bars.clear()

    @staticmethod
    def row(ticker, date, session, bar) -> Row:
        start = datetime.datetime.combine(date, datetime.time.fromisoformat(SESSIONS[session - 1][2]))
        return Row(ticker=ticker, date=date, session_index=session, datetime=start, **{c: bar[c] for c in NAMES})


def arrival_bars(ticks: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Changed and closed bars of a streaming DataFrame of ticks (ticker, timestamp, price, accumulated_volume,
    accumulated_value, seq), ``seq`` being their order of arrival. For update mode."""
    if ticks.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    timed = session_ticks(ticks).where("price IS NOT NULL").select(
        F.upper("ticker").alias("ticker"), F.to_date("timestamp").alias("date"), F.col("timestamp").cast("timestamp").alias("event_time"), "session_index", "price",
        *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("accumulated_volume", "bigint"), ("accumulated_value", "double"))], "seq",
    )
    return timed.withWatermark("event_time", delay).groupBy("ticker", "date").transformWithState(DayOfBars(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
