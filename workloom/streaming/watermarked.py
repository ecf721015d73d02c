"""Streams whose state the watermark bounds: session checks, open requests, daily counters.

Rows may come up to ``delay`` late; later ones are dropped and counted. Results are appended once the watermark
has passed them, so the newest ``delay`` of a stream waits for a later run, or for a closing row. After a closing
row the stream is over: rows that come then are late.
"""

from pyspark.sql import functions as F

from workloom.session import scratch_path
from workloom.streaming.feeds import batch_rows
from workloom.streaming.keyed import rocks_store


def close_streams(spark, place, ts):
    """Moves the watermark of all streams that run in ``place`` to ``ts`` less their delay."""
    spark.createDataFrame([(ts,)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{place}/closing")


def _with_closing(stream, place, ts):
    """The stream and the closing rows of ``place`` (null but for ``ts``, marked by ``closing``)."""
    spark = stream.sparkSession
    empty = spark.createDataFrame([], "ts timestamp")
    empty.coalesce(1).write.mode("append").parquet(f"{place}/closing")
    ends = spark.readStream.schema(empty.schema).parquet(f"{place}/closing").select(F.col("ts").alias(ts), F.lit(True).alias("closing"))
    return stream.withColumn("closing", F.lit(False)).unionByName(ends, allowMissingColumns=True)


def _settled(result, place):
    """Appends what the watermark has passed to the tables of ``place``: (all rows so far, counts of this run)."""
    spark = result.sparkSession

    def keep(batch, number):
        batch.filter("NOT closing").drop("closing").write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    with rocks_store(spark):
        run = (result.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint")
               .outputMode("append").trigger(availableNow=True).start())
        run.awaitTermination()
    seen = [p["stateOperators"] for p in run.recentProgress if p["stateOperators"]]
    counts = {"late": sum(s["numRowsDroppedByWatermark"] for states in seen for s in states),
              "state_rows": sum(s["numRowsTotal"] for s in seen[-1]) if seen else 0}
    schema = result.drop("closing").schema
    return batch_rows(spark, place, schema).drop("batch"), counts


def session_checks(logins, events, hours=24, delay="1 day", place=None):
    """``user_id, id, valid`` of every event: is there a login of the user less than ``hours`` before it?

    An interval join of the two streams; a login is kept while events may still need it, an event while logins
    before it may still come. Logins (user_id, ts) and events (user_id, id, ts); an event id that repeats within the
    delay is told once. Without user or time an event is not valid; without time it is never told.
    """
    place = place or scratch_path(events.sparkSession, "session-checks")
    # A key that is never null: with the bare user, closing rows would be filtered before they move the watermark.
    def keyed(stream, ts):
        return _with_closing(stream, place, ts).withColumn("key", F.struct("user_id", "closing")).withWatermark(ts, delay)

    left = keyed(events.select("user_id", "id", F.col("ts").alias("at")), "at")
    right = keyed(logins.select("user_id", F.col("ts").alias("login_at")), "login_at").select(F.col("key").alias("l_key"), "login_at")
    met = F.expr(f"key = l_key AND user_id IS NOT NULL AND login_at <= at AND login_at > at - INTERVAL {int(hours)} HOURS")
    checked = left.join(right, met, "left_outer").select("user_id", "id", "at", F.col("login_at").isNotNull().alias("valid"), "closing")
    # Several logins may meet an event; its first row is as good as any, as all of them say that it is valid.
    rows, counts = _settled(checked.dropDuplicatesWithinWatermark(["user_id", "id", "closing"]), place)
    return rows.select("user_id", "id", "valid"), counts


def accepted_requests(requests, delay="1 day", place=None):
    """Pending requests (user_id, id, status, created_at) that find no open one of their user.

    A request stays open for ``delay`` of event time. Of requests of one batch any may come first; streams in order of
    time with one file to a batch accept the earliest.
    """
    place = place or scratch_path(requests.sparkSession, "accepted-requests")
    asked = _with_closing(requests.filter("status = 'Pending'").select("user_id", "id", "created_at"), place, "created_at")
    rows, counts = _settled(asked.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["user_id", "closing"]), place)
    return rows, counts


def closed_daily_counts(events, delay="1 day", place=None):
    """``user_id, day_us, event_type, n`` of the days that the watermark has passed; state holds open days only."""
    place = place or scratch_path(events.sparkSession, "closed-days")
    seen = _with_closing(events.select("user_id", "event_type", "ts"), place, "ts").withWatermark("ts", delay)
    days = seen.groupBy("user_id", F.window("ts", "1 day").alias("w"), "event_type", "closing").agg(F.count(F.lit(1)).alias("n"))
    return _settled(days.select("user_id", F.unix_micros("w.start").alias("day_us"), "event_type", "n", "closing"), place)
