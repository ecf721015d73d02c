"""Login lockout with keyed state: attempts wait for the watermark, failures are forgotten by timers."""

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from workloom.session import scratch_path
from workloom.streaming.feeds import batch_rows
from workloom.streaming.lockout import OUTPUT, step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ATTEMPT = "user_id BIGINT, id BIGINT, ts TIMESTAMP, success BOOLEAN"


class Lockout(StatefulProcessor):
    """State of a user: attempts that the watermark has not passed, and failures that still count.

    A timer at the earliest waiting attempt judges, in order of time and id, all that the watermark has passed;
    one at the end of the last failure's window empties the state. A user that is quiet leaves nothing behind.
    """

    def __init__(self, window, limit):
        self.window, self.limit = window, limit

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id BIGINT, micros BIGINT, success BOOLEAN")
        self.failures = handle.getListState("failures", "at DOUBLE")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for part in rows:
            new = [(int(i), int(m), bool(s)) for i, m, s in zip(part["id"], part["micros"], part["success"], strict=True)]
            if new:
                self.waiting.appendList(new)
                first = min([m for _, m, _ in new] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((m, i, s) for i, m, s in self.waiting.get()) if self.waiting.exists() else []
        due, later = [w for w in waiting if w[0] <= now], [w for w in waiting if w[0] > now]
        failures = [r[0] for r in self.failures.get()] if self.failures.exists() else []
        out = []
        for micros, number, success in due:
            at = micros / 1e6
            failures, allowed, remaining = step(failures, at, success, self.window, self.limit)
            out.append((key[0], number, at, success, allowed, remaining))
        failures = [t for t in failures if now / 1e6 - t < self.window]
        for state, rows in ((self.waiting, [(i, m, s) for m, i, s in later]), (self.failures, [(t,) for t in failures])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        if failures:
            self.handle.registerTimer(int((max(failures) + self.window) * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "id", "at", "success", "allowed", "remaining"])

    def close(self):
        pass


@contextmanager
def rocks_store(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def closing_rows(spark, place, user_id=None, ts=None):
    """The folder from which a run also reads; with ``ts`` a row is added that moves the watermark there."""
    folder = f"{place}/closing"
    rows = [] if ts is None else [(user_id, -1, ts, True)]
    spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], ATTEMPT).schema).parquet(folder)


def keyed_lockout(attempts, window=300, limit=5, delay="30 days", place=None):
    """Judges the attempts (user_id, id, ts, success) that are there now: (verdicts so far, counts of this run).

    Attempts may come up to ``delay`` late; later ones are not judged, the counts tell how many (``late``), the
    rows of state (``state_rows``) and the rows that wait or count. A second run over the same ``place`` goes on
    where the first one ended. Attempts above the watermark are judged by a later run, or after ``close``.
    """
    spark = attempts.sparkSession
    place = place or scratch_path(spark, "keyed-lockout")
    closing = closing_rows(spark, place)
    rows = attempts.select("user_id", "id", F.col("ts").cast("timestamp").alias("ts"), "success").union(closing)
    rows = rows.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", delay)
    judged = rows.groupBy("user_id").transformWithStateInPandas(Lockout(window, limit), OUTPUT, "append", "eventTime")

    def keep(batch, number):
        batch.filter("id >= 0").write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    with rocks_store(spark):
        query = judged.writeStream.foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    seen = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    counts = {"late": sum(s["numRowsDroppedByWatermark"] for s in seen), "state_rows": seen[-1]["numRowsTotal"] if seen else 0}
    return batch_rows(spark, place, spark.createDataFrame([], OUTPUT).schema).drop("batch"), counts
