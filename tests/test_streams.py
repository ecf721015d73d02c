"""Streams over several files in no order of time equal the batch results, also after a restart."""

import pytest
from pyspark.sql import functions as F

from workloom.plans.live import WEEK, _attempts
from workloom.streaming import feeds, lockout

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in two portions of three files each, dealt by hash."""
    folder = tmp_path_factory.mktemp("parts")
    events = spark.read.parquet(EVENTS).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(2)))
    for k in range(2):
        events.filter(F.col("part") == k).drop("part").repartition(3, F.xxhash64("event_id", F.lit(7))).write.parquet(f"{folder}/portion-{k}")
    return folder


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


RUNS = {
    "lockout": (lambda s, place: lockout.lockout_stream(_attempts(s), WEEK, 3, place), lambda e: lockout.lockout(_attempts(e), WEEK, 3)),
    "feed": (lambda s, place: feeds.feed_stream(s, 5, place), lambda e: feeds.newest_per_user(e, 5)),
    "sessions": (feeds.session_stream, lambda e: feeds.merged_sessions(feeds.session_parts(e))),
    "daily": (feeds.daily_stream, lambda e: feeds.daily_parts(e)),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_stream_equals_batch_and_resumes(spark, parts, tmp_path, name):
    stream, batch = RUNS[name]
    table, place = tmp_path / "events.parquet", str(tmp_path / "place")
    for k in range(2):
        # New files arrive in the folder of the table; the second run goes on from the checkpoint.
        spark.read.parquet(f"{parts}/portion-{k}").write.mode("append").parquet(str(table))
        got = stream(feeds.event_stream(spark, str(tmp_path), files=2), place)
        events = spark.read.parquet(str(table)).withColumn("ts", F.col("ts").cast("timestamp"))
        assert rows(got) == rows(batch(events)) and got.count() > 0
    assert rows(stream(feeds.event_stream(spark, str(tmp_path), files=2), place)) == rows(got)


def test_sessions_against_one_pass(spark):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    halves = [feeds.session_parts(events.filter(F.col("event_id") % 2 == k)) for k in range(2)]
    assert rows(feeds.merged_sessions(halves[0].unionByName(halves[1]))) == rows(feeds.merged_sessions(feeds.session_parts(events)))


def test_empty_table(spark, tmp_path):
    spark.read.parquet(EVENTS).limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for name, (stream, _) in RUNS.items():
        assert stream(feeds.event_stream(spark, str(tmp_path)), str(tmp_path / name)).count() == 0


def test_keyed_lockout_goes_on_and_forgets(spark, parts, tmp_path):
    """Two portions in order of time, with attempts up to a day late; then a closing row. State ends near empty."""
    from workloom.streaming import keyed
    attempts = _attempts(spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")))
    middle = attempts.agg(F.percentile_approx("ts", 0.5)).first()[0]
    place, folder = str(tmp_path / "place"), str(tmp_path / "attempts")
    schema, counts = attempts.schema, []
    for part in (attempts.filter(F.col("ts") <= middle), attempts.filter(F.col("ts") > middle)):
        part.repartition(3).write.mode("append").parquet(folder)
        got, seen = keyed.keyed_lockout(spark.readStream.schema(schema).parquet(folder), WEEK, 3, "1 day", place)
        counts.append(seen)
    last = attempts.agg(F.max("ts")).first()[0]
    keyed.closing_rows(spark, place, ts=last.replace(year=last.year + 2))
    got, seen = keyed.keyed_lockout(spark.readStream.schema(schema).parquet(folder), WEEK, 3, "1 day", place)
    assert rows(got) == rows(lockout.lockout(attempts, WEEK, 3)) and sum(c["late"] for c in [*counts, seen]) == 0
    # The second portion is as large as the first; state holds a week and what waits, not the history.
    assert counts[1]["state_rows"] <= 1.5 * counts[0]["state_rows"] and seen["state_rows"] <= 10
