"""Streams give what the batch gives, on events in order."""

import pytest
from pyspark.sql import functions as F

from sketchloom.operators import decay, ratelimit
from sketchloom.sources.tables import load
from sketchloom.streaming import stateful


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "table")
    load(spark, sf, "events").select("event_id", "user_id", "ts").orderBy("ts").coalesce(1).write.parquet(path)
    return path


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_rates(spark, events, tmp_path):
    out = run(spark, stateful.decayed_rates(stream(spark, events), "user_id", "ts", 3600.0), "rates", "update", tmp_path)
    batch = decay.running_rate(spark.read.parquet(events), ["user_id"], "ts", "event_id", 3600.0)
    last = {r["user_id"]: r["r"] for r in batch.groupBy("user_id").agg(F.max_by("rate", F.struct("ts", "event_id")).alias("r")).collect()}
    assert {r["user_id"]: pytest.approx(r["rate"]) for r in out.collect()} == last


def test_windows(spark, events, tmp_path):
    out = run(spark, stateful.rate_limit(stream(spark, events), "user_id", "ts", "event_id", 3, 86400.0), "windows", "append", tmp_path)
    batch = ratelimit.replay(spark.read.parquet(events), "user_id", "ts", "event_id", 3, 86400.0)
    assert {r["event_id"]: r["allowed"] for r in out.collect()} == {r["event_id"]: r["allowed"] for r in batch.collect()}


def test_windowed_distinct(spark, events, tmp_path):
    out = run(spark, stateful.windowed_distinct(stream(spark, events), "user_id", "ts", "1 day", "1 hour"), "distinct_users", "complete", tmp_path)
    want = {r["d"]: r["n"] for r in spark.read.parquet(events).groupBy(F.to_date("ts").alias("d")).agg(F.countDistinct("user_id").alias("n")).collect()}
    assert {r["window"].start.date(): r["estimate"] for r in out.collect()} == want


def test_state_expires_behind_the_watermark(spark, tmp_path):
    source, rows = str(tmp_path / "in"), "event_id long, user_id long, ts timestamp"
    for day in (1, 9, 17):
        spark.createDataFrame([(day, day, f"2024-01-{day:02}")], "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(source)
    df = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(source)
    q = stateful.rate_limit(df, "user_id", "ts", "event_id", 3, 86400.0).writeStream.format("memory").queryName("expiry").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and spark.table("expiry").count() == 3
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the last window, its timer and at most one more of each, not three
