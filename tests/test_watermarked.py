"""Streams bounded by watermarks, bucketed snapshots and stored sketches, against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from workloom.operators.sketches import distinct_estimates, distinct_sketches
from workloom.streaming import feeds, snapshots, watermarked

START = datetime(2024, 1, 1)


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


class Feed:
    """A folder of files that a stream reads one by one, in the order in which they were added."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        spark.createDataFrame([], schema).write.mode("append").parquet(self.folder)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        kind = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def table(self):
        return self.spark.read.parquet(self.folder)


def at(hours):
    return START + timedelta(hours=hours)


def test_session_checks(spark, tmp_path):
    events = Feed(spark, tmp_path / "events", "user_id long, id long, ts timestamp")
    logins = Feed(spark, tmp_path / "logins", "user_id long, ts timestamp")
    place = str(tmp_path / "place")
    for day in range(4):
        # Two logins that both reach an event, one at the very moment, one a full day before, a user without login, a null.
        logins.add([(1, at(24 * day)), (1, at(24 * day + 1)), (2, at(48 * (day // 2)))])
        events.add([(1, 10 * day, at(24 * day + 2)), (2, 10 * day + 1, at(24 * day)), (3, 10 * day + 2, at(24 * day + 3)), (None, 10 * day + 3, at(24 * day + 3)),
                    (1, 10 * day + 4, at(24 * day))])
        got, counts = watermarked.session_checks(logins.stream(), events.stream(), 24, "2 days", place)
        assert counts["late"] == 0
    watermarked.close_streams(spark, place, at(10000))
    got, counts = watermarked.session_checks(logins.stream(), events.stream(), 24, "2 days", place)
    assert rows(got) == rows(feeds.valid_sessions(logins.table(), events.table().withColumnRenamed("id", "event_id"))) and got.count() == 20
    assert counts["late"] == 0 and counts["state_rows"] <= 4


def test_late_events_are_counted(spark, tmp_path):
    events = Feed(spark, tmp_path / "events", "user_id long, event_type string, ts timestamp")
    place = str(tmp_path / "place")
    sizes = []
    for day in range(6):
        events.add([(user, "view", at(24 * day + hour)) for user in range(5) for hour in (1, 2)])
        got, counts = watermarked.closed_daily_counts(events.stream(), "1 day", place)
        sizes.append(counts["state_rows"])
    assert max(sizes[2:]) <= 15 and got.filter("n <> 2").count() == 0
    events.add([(1, "view", at(1))])
    got, counts = watermarked.closed_daily_counts(events.stream(), "1 day", place)
    assert counts["late"] == 1
    watermarked.close_streams(spark, place, at(10000))
    got, counts = watermarked.closed_daily_counts(events.stream(), "1 day", place)
    whole = feeds.daily_parts(events.table().dropDuplicates(["user_id", "ts"]))
    assert rows(got) == rows(whole) and counts["state_rows"] <= 1


def test_requests_in_order(spark, tmp_path):
    requests = Feed(spark, tmp_path / "requests", "user_id long, id long, status string, created_at timestamp")
    place = str(tmp_path / "place")
    for day in range(3):
        requests.add([(1, 10 * day, "Pending", at(day)), (2 + day, 10 * day + 1, "Pending", at(day)), (9, 10 * day + 2, "Called", at(day)), (None, 10 * day + 3, "Pending", at(day))])
        got, _ = watermarked.accepted_requests(requests.stream(), "10 days", place)
    assert rows(got.filter("user_id IS NOT NULL").select("user_id", "id")) == rows(feeds.open_requests(requests.table().filter("user_id IS NOT NULL")))
    assert got.filter("user_id IS NULL").select("id").collect() == [(3,)]
    # A request far later ends the ones before it; one before the watermark is late.
    requests.add([(7, 90, "Pending", at(24 * 40))])
    watermarked.accepted_requests(requests.stream(), "10 days", place)
    requests.add([(1, 91, "Pending", at(24 * 41)), (8, 92, "Pending", at(2))])
    got, counts = watermarked.accepted_requests(requests.stream(), "10 days", place)
    assert {r.id for r in got.collect()} == {0, 1, 3, 11, 21, 90, 91} and counts["late"] == 1


def test_snapshot_rewrites_touched_buckets_only(spark, tmp_path):
    base = spark.createDataFrame([(u, f"s{u % 3}", "Beginner", 10 + u, at(u)) for u in range(40)], "user_id long, skill_name string, level string, progress int, updated_at timestamp")
    searches = Feed(spark, tmp_path / "searches", "user_id long, skill_name string, level string, id long, created_at timestamp")
    place = str(tmp_path / "place")
    run = lambda: snapshots.skill_snapshot(base, searches.stream(), 10, place, 5)
    assert rows(run()) == rows(base)
    for new in ([(1, "s1", "Advanced", 5, at(50)), (1, "s1", "Beginner", 4, at(50)), (99, "x", "Advanced", 6, at(1))],
                [(1, "s1", "Intermediate", 1, at(20))], [(1, "s1", "Advanced", 7, at(50)), (1, "s1", "Intermediate", 7, at(50)), (99, "y", None, 8, None)]):
        searches.add(new)
        got = run()
        assert rows(got) == rows(feeds.upsert_skills(base, searches.table()))
    listed = spark.read.parquet(f"{place}/listed").groupBy("version").count().orderBy("version").collect()
    # Eight buckets at first, then those of the two, one and two keys of each change.
    assert listed[0]["count"] == 8 and all(r["count"] <= 2 for r in listed[1:]) and len(listed) == 4
    assert rows(run()) == rows(got)


def test_snapshot_of_nulls_and_nothing(spark, tmp_path):
    base = spark.createDataFrame([], "user_id long, age int, preferred_domain string, primary_skill string")
    searches = Feed(spark, tmp_path / "searches", "user_id long, age int, domain string, work_mode string, id long, created_at timestamp")
    place = str(tmp_path / "place")
    assert snapshots.profile_snapshot(base, searches.stream(), place).count() == 0
    for age in (30, 31):
        searches.add([(None, age, "IT", "Remote", age, at(age))])
        got = snapshots.profile_snapshot(base, searches.stream(), place).collect()
        assert [tuple(r) for r in got] == [(None, age, "IT", None, "Remote")]


@pytest.mark.parametrize("size", [0, 1, 300, 50_000])
def test_sketches(spark, size):
    df = spark.range(size).select(F.col("id"), (F.col("id") % 7).alias("few"), F.lit(None).cast("string").alias("none"), (F.col("id") % 3).alias("day"))
    stored = distinct_sketches(df, ["id", "few", "none"], F.col("day"))
    got = {r.column: r for r in distinct_estimates(stored).collect()}
    if not size:
        assert got == {}
        return
    assert abs(got["id"].estimate - size) <= 0.07 * size and got["few"].estimate == min(size, 7) and got["none"].estimate == 0 and got["id"].n == size
    assert distinct_estimates(stored, "part").count() == 3 * min(size, 3)
