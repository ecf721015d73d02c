"""Login lockout: a keyed state machine, as a stream and as its batch twin."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.session import scratch_path
from workloom.streaming.feeds import batch_rows, run_batches

OUTPUT = "user_id BIGINT, id BIGINT, at DOUBLE, success BOOLEAN, allowed BOOLEAN, remaining BIGINT"


def step(open_failures, at, success, window, limit):
    """One attempt. Returns (failures kept, allowed, remaining seconds).

    Failures of ``window`` seconds and more ago are forgotten; ``limit`` of them block until
    the oldest is forgotten. A success clears them; a blocked attempt leaves no trace.
    """
    kept = [t for t in open_failures if at - t < window]
    if len(kept) >= limit:
        return kept, False, int(window - (at - min(kept)))
    return ([] if success else kept + [at]), True, 0


def replay(window, limit):
    """Batch function over rows sorted by (user, run, time): state is carried from row to row,
    so memory holds one short list whatever the size of a user."""
    def run(batches):
        key, failures = None, []
        for pdf in batches:
            allowed, remaining = [], []
            for row in pdf.itertuples(index=False):
                if (row.user_id, row.run) != key:
                    key, failures = (row.user_id, row.run), []
                failures, ok, left = step(failures, row.at, row.success, window, limit)
                allowed.append(ok)
                remaining.append(left)
            yield pdf[["user_id", "id", "at", "success"]].assign(allowed=allowed, remaining=remaining)
    return run


def with_runs(rows, window, bucket=86400):
    """Adds ``run``: the time of the last attempt that followed a pause of ``window`` seconds.

    Users are cut by time first, so a user with very many attempts is many groups. What a
    slice needs of the slices before it - their last attempt and last fresh start - comes
    from one row per user and slice.
    """
    width = max(bucket, window)
    cut = rows.withColumn("slice", F.floor(F.col("at") / width))
    slices = cut.groupBy("user_id", "slice").agg(F.max("at").alias("last_at"))
    by_user = Window.partitionBy("user_id").orderBy("slice")
    before = slices.select("user_id", "slice", F.lag("last_at").over(by_user).alias("prev_at"))
    inside = Window.partitionBy("user_id", "slice").orderBy("at", "id")
    known = cut.join(before, ["user_id", "slice"]).withColumn("prev", F.coalesce(F.lag("at").over(inside), "prev_at"))
    fresh = known.withColumn("start", F.when(F.col("prev").isNull() | (F.col("at") - F.col("prev") >= window), F.col("at")))
    starts = fresh.groupBy("user_id", "slice").agg(F.max("start").alias("last_start"))
    carried = starts.select("user_id", "slice", F.last("last_start", True).over(
        by_user.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (fresh.join(carried, ["user_id", "slice"])
            .withColumn("run", F.coalesce(F.max("start").over(upto), "carry")).select(*rows.columns, "run"))


def lockout(attempts, window=300, limit=5):
    """Verdict for every attempt (user_id, id, ts, success).

    A pause of ``window`` seconds empties the state, so each user falls into independent runs
    which are spread over the tasks; a busy user is not one group.
    """
    rows = attempts.select("user_id", "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "success")
    spread = with_runs(rows, window).repartition("user_id", "run").sortWithinPartitions("user_id", "run", "at", "id")
    return spread.mapInPandas(replay(window, limit), OUTPUT)


def lockout_stream(attempts, window=300, limit=5, place=None, buckets=64):
    """The same verdicts from a stream whose attempts come in any order.

    Attempts are kept by user bucket. A batch judges the users it touches again, over all their
    attempts so far, as an attempt may come before ones that are judged already; the verdicts of a user
    are those of the last batch that touched them.
    """
    spark = attempts.sparkSession
    place = place or scratch_path(spark, "lockout")
    kept = f"{place}/attempts"
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")

    def judge(batch, folder, number):
        rows = batch.select("user_id", "id", "ts", "success").withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{kept}/batch={number}")
        touched = rows.select("bucket", "user_id").distinct()
        schema = rows.schema.add("batch", "long")
        known = spark.read.schema(schema).option("basePath", kept).parquet(kept).filter(F.col("batch") <= number)
        lockout(known.join(touched, ["bucket", "user_id"], "left_semi").drop("batch", "bucket"), window, limit).write.mode("overwrite").parquet(folder)

    run_batches(attempts, judge, place)
    verdicts = batch_rows(spark, place, spark.createDataFrame([], OUTPUT).schema)
    last = verdicts.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return verdicts.join(last, ["user_id", "batch"], "left_semi").drop("batch")


def recent_failures(attempts, window, limit):
    """Failures in the ``window`` seconds up to each failure, since the last success; the
    attempts that reach ``limit``. Built-in windows only, each over one slice of one user: a
    failure is listed in its own slice and, as context, in the next.
    """
    width = window * 1_000_000
    rows = attempts.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("slice", F.floor(F.col("at") / width))
    slices = rows.groupBy("user_id", "slice").agg(F.count_if("success").alias("n"))
    earlier = Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select("user_id", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("user_id", "slice").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.join(before, ["user_id", "slice"]).withColumn("since", F.col("before") + F.count_if("success").over(upto))
    listed = counted.filter(~F.col("success")).select(
        "user_id", "id", "at", "since", "slice", F.explode(F.array("slice", F.col("slice") + 1)).alias("home"))
    span = Window.partitionBy("user_id", "since", "home").orderBy("at").rangeBetween(-(width - 1), Window.currentRow)
    return (listed.withColumn("failures", F.count(F.lit(1)).over(span))
            .filter((F.col("home") == F.col("slice")) & (F.col("failures") >= limit)).select("user_id", "id", "failures"))
