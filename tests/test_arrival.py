"""Session bars in order of arrival against a sequential replay, with late and repeated ticks and a restart."""

import datetime
import random

import pytest

from candela.streaming import arrival

START = {1: 9, 2: 10, 3: 13, 4: 14}


def replay(ticks):
    """One tick after the other over a plain dictionary."""
    bars = {}
    for ticker, ts, price, volume, value, _ in ticks:
        session = next((s for s, h in START.items() if (h <= ts.hour < h + 1) or (s == 2 and (ts.hour, ts.minute) <= (11, 30) and ts.hour >= 10)), None)
        if session is None:
            continue
        key = (ticker, ts.date())
        day = bars.setdefault(key, {})
        prior_volume, prior_value = (sum(b[i] for k, b in day.items() if k < session) for i in (4, 5))
        old = day.get(session)
        v, m = max(0, volume - prior_volume), max(0.0, value - prior_value)
        day[session] = [price, price, price, price, v, m, False] if old is None else [old[0], max(old[1], price), min(old[2], price), price, v, m, old[6]]
        for k, b in day.items():
            if k < session:
                b[6] = True
    return {(*k, s): tuple(b) for k, day in bars.items() for s, b in day.items()}


def ticks_of(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        ts = datetime.datetime(2024, 1, 3 + i * 2 // n, rng.choice([8, 9, 10, 11, 13, 14, 16]), rng.randrange(30), rng.randrange(60))
        out.append((rng.choice(["AAA", "BBB"]), ts, float(rng.randint(10, 30)), rng.randint(0, 900), float(rng.randint(0, 9000)), i))
    return out + [(*out[-1][:5], n)]


SCHEMA = "ticker string, timestamp timestamp_ntz, price double, accumulated_volume bigint, accumulated_value double, seq bigint"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, arrival.ROCKSDB)
    yield spark
    spark.conf.set(key, old)


def test_bars_in_order_of_arrival(rocks, tmp_path):
    """Batches with late ticks, each run started anew from the checkpoint; then the day's timer closes what is open."""
    ticks = ticks_of(3, 120)
    seen, rows = {}, []

    def write(batch, _):
        rows.extend(tuple(r) for r in batch.collect())

    for part in range(4):
        some = ticks[part * 31 : (part + 1) * 31]
        rocks.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = arrival.arrival_bars(rocks.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "48 hours")
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(120)
        for r in rows:
            seen[r[0], r[1], r[2]] = r[4:]
        assert seen == replay(ticks[: (part + 1) * 31])
    assert any(not b[6] for b in seen.values())
    rocks.createDataFrame([("CCC", datetime.datetime(2024, 2, 1, 9, 1), 1.0, 1, 1.0, 500), ("CCC", datetime.datetime(2024, 2, 9, 9, 1), 1.0, 1, 1.0, 501)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = arrival.arrival_bars(rocks.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "48 hours")
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(120)
    for r in rows:
        seen[r[0], r[1], r[2]] = r[4:]
    closed = {k: (*b[:6], True) for k, b in replay(ticks).items()}
    assert {k: b for k, b in seen.items() if k[0] != "CCC"} == closed


def test_needs_its_state_store(spark, tmp_path):
    with pytest.raises(RuntimeError, match="RocksDB"):
        arrival.arrival_bars(spark.createDataFrame([], SCHEMA))
