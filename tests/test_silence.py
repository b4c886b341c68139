"""Silence on a stream: late rows, restarts and expiry against the batch sessions; wall-clock alarms without rows."""

import random
import time
from datetime import datetime, timedelta

import pytest

from tastevin.streaming import offers, silence

pytest.importorskip("google.protobuf")
SCHEMA = "run string, ts timestamp"


@pytest.fixture
def timed(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield silence.with_timers(spark)
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, out, checkpoint):
    found = silence.silences(spark.readStream.schema(SCHEMA).parquet(folder), "run", "ts", timedelta(minutes=15), "30 minutes")
    query = found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_sessions_with_late_rows_and_restarts(timed, tmp_path):
    spark, rng = timed, random.Random(4)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    start, rows = datetime(2024, 1, 1), []
    for run in "abc":
        at = start
        for _ in range(40):
            at += timedelta(minutes=rng.choice([1, 3, 5, 14, 15, 16, 40]))
            rows.append((run, at))
    rows.sort(key=lambda r: (r[1] + timedelta(minutes=rng.uniform(0, 14))))  # late, but within the watermark
    size = len(rows) // 4 + 1
    for k in range(0, len(rows), size):
        feed(spark, folder, rows[k : k + size])
        drain(spark, folder, out, checkpoint)  # each a run of its own: the state comes from the checkpoint
    feed(spark, folder, [("z", max(t for _, t in rows) + timedelta(days=1))])  # moves the watermark past all
    drain(spark, folder, out, checkpoint)
    feed(spark, folder, [("z", max(t for _, t in rows) + timedelta(days=1, minutes=1)), ("a", start)])  # a row that is too late
    drain(spark, folder, out, checkpoint)
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("run <> 'z'").collect())
    want = sorted(tuple(r) for r in offers.stalls(spark.createDataFrame(rows, SCHEMA), "run", "ts", "15 minutes").collect())
    assert got == want and len(got) > 10


def test_alarm_without_rows(timed, tmp_path):
    spark = timed
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    feed(spark, folder, [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 3))])
    found = silence.alarms(spark.readStream.schema(SCHEMA).parquet(folder), "run", "ts", timedelta(seconds=2))
    query = found.writeStream.format("memory").queryName("alarms_found").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("alarms_found").count() >= 2:
                break
        got = sorted((r["run"], r["last_seen"]) for r in spark.table("alarms_found").collect())
        assert got == [("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 3))]  # once each, though no row came
        time.sleep(3)
        assert spark.table("alarms_found").count() == 2
    finally:
        query.stop()


def test_batch_form(spark):
    beats = spark.createDataFrame([("a", datetime(2024, 1, 1, 10)), ("a", datetime(2024, 1, 1, 11)), ("b", datetime(2024, 1, 1, 9))], SCHEMA)
    got = silence.silent_now(beats, "run", "ts", timedelta(minutes=90), datetime(2024, 1, 1, 12)).collect()
    assert [tuple(r) for r in got] == [("b", datetime(2024, 1, 1, 9))]
