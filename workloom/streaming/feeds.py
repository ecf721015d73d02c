"""Streams over user events and the tables they keep up to date."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.operators.ranking import top_per_key
from workloom.session import scratch_path
from workloom.sources.catalog import STANDINS, needs

DAY = 86400


def table_stream(spark, folder, name, files=16):
    """File stream of one table, a file or a folder of files; ``files`` per trigger bound a batch."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    # A file source takes folders only; the pattern matches the table, be it a folder or one file.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path[:-1] + "[t]")


def event_stream(spark, folder, name="events", files=16):
    return table_stream(spark, folder, name, files).withColumn("ts", F.col("ts").cast("timestamp"))


def derived_stream(spark, folder, name, files=16):
    """Stream of a derived table, from the streams of the given tables it reads."""
    sql = STANDINS[name]
    return spark.sql(sql, **{n: table_stream(spark, folder, n, files) for n in needs(sql)})


def run_batches(stream, handle, place):
    """Runs ``handle(batch, folder of this batch, number)`` for every micro-batch of what is there now.

    The checkpoint lies in ``place``: a second run over the same place goes on where the first one
    ended. A batch that is retried writes the same folder again.
    """
    def step(batch, number):
        handle(batch, f"{place}/rows/batch={number}", number)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def batch_rows(spark, place, schema):
    """All rows that the batches of ``place`` wrote, with the column ``batch``; empty before the first one."""
    schema = schema.add("batch", "long") if "batch" not in schema.names else schema
    try:
        return spark.read.schema(schema).option("basePath", f"{place}/rows").parquet(f"{place}/rows")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def merged_stream(stream, partial, merge, label, place=None):
    """A keyed result of a stream, whatever the order in which rows come.

    Every batch adds a small ``partial`` table, the result merges them. There is no state that grows
    with time and no watermark, so no late row is lost.
    """
    spark = stream.sparkSession
    place = place or scratch_path(spark, label)
    run_batches(stream, lambda batch, folder, number: partial(batch).write.mode("overwrite").parquet(folder), place)
    schema = partial(spark.createDataFrame([], stream.schema)).schema
    return merge(batch_rows(spark, place, schema).drop("batch"))


def newest_per_user(events, n=5):
    return top_per_key(events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], n, "rank")


def feed_stream(events, n=5, place=None):
    """Newest ``n`` activities per user: the newest of every batch, and the newest of those."""
    return merged_stream(events, lambda rows: newest_per_user(rows, n).drop("rank"), lambda rows: newest_per_user(rows, n), "feed", place)


def valid_sessions(logins, events, hours=24):
    """Events with the newest login of the same user at most ``hours`` before them.

    Both sides are cut into spans of that length, so the join is an equi join on user and
    span; a login is listed in its own and in the next span.
    """
    span = hours * 3600
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bucket = F.floor(at / (span * 1_000_000))
    left = logins.select("user_id", at.alias("login_at"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    right = events.select("user_id", F.col("event_id").alias("id"), at.alias("at"), bucket.alias("bucket"))
    # Newest login up to the event: merged in time order per user and span, no pairs are made.
    merged = left.select("user_id", "bucket", F.col("login_at").alias("at"), F.lit(None).cast("long").alias("id"), "login_at").unionByName(
        right.select("user_id", "bucket", "at", "id", F.lit(None).cast("long").alias("login_at")))
    w = Window.partitionBy("user_id", "bucket").orderBy("at", F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = merged.withColumn("login", F.last("login_at", True).over(w)).filter("id IS NOT NULL")
    return seen.select("user_id", "id", ((F.col("login").isNotNull()) & (F.col("at") - F.col("login") < span * 1_000_000)).alias("valid"))


def session_parts(events, gap="24 hours"):
    """Sessions within a set of rows: first and last moment and number of events."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.unix_micros(F.min("ts")).alias("start_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.count(F.lit(1)).alias("n")).drop("s")


def merged_sessions(parts, gap_us=DAY * 1_000_000):
    """Sessions of all rows from sessions of parts of them: parts closer than the gap are one."""
    before = Window.partitionBy("user_id").orderBy("start_us", "last_us")
    reach = F.max("last_us").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("fresh", F.when(reach.isNull() | (F.col("start_us") - reach >= gap_us), 1).otherwise(0))
    numbered = fresh.withColumn("session", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("start_us").alias("start_us"), F.sum("n").alias("n")).drop("session")


def session_stream(events, place=None):
    """Sessions of a day's gap from a stream in any order."""
    return merged_stream(events, session_parts, merged_sessions, "sessions", place)


def daily_parts(events):
    return events.groupBy("user_id", F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.unix_micros("w.start").alias("day_us"), "event_type", "n")


def daily_stream(events, place=None):
    """Counters per user, day and type: counts of the batches, summed."""
    return merged_stream(events, daily_parts, lambda rows: rows.groupBy("user_id", "day_us", "event_type").agg(F.sum("n").alias("n")), "daily", place)


def _first_pending(requests):
    """First pending request per user; later ones are refused while it is open."""
    first = requests.filter("status = 'Pending'").groupBy("user_id").agg(F.min(F.struct("created_at", "id")).alias("f"))
    return first.select("user_id", "f.id", F.lit("Pending").alias("status"), "f.created_at")


def open_requests(requests):
    return _first_pending(requests).select("user_id", "id")


def request_stream(requests, place=None):
    """The open request of every user, whatever the order in which requests arrive."""
    return merged_stream(requests, _first_pending, open_requests, "requests", place)


def upsert_skills(snapshot, searches, start_progress=10):
    """Skill table after a batch of searches: new pairs start at ``start_progress``, known ones
    take the newest level and time."""
    newest = searches.groupBy("user_id", "skill_name").agg(F.max(F.struct("created_at", "id", "level")).alias("u"))
    return snapshot.alias("s").join(newest.alias("n"), ["user_id", "skill_name"], "full_outer").select(
        "user_id", "skill_name", F.coalesce("n.u.level", "s.level").alias("level"),
        F.coalesce("s.progress", F.lit(start_progress)).alias("progress"), F.coalesce("n.u.created_at", "s.updated_at").alias("updated_at"))


def skill_stream(snapshot, searches, start_progress=10, place=None):
    """The skill table after a stream of searches: every batch keeps its newest row per user and skill."""
    def newest(rows):
        best = rows.groupBy("user_id", "skill_name").agg(F.max(F.struct("created_at", "id", "level")).alias("u"))
        return best.select("user_id", "skill_name", "u.*")

    return merged_stream(searches, newest, lambda rows: upsert_skills(snapshot, rows, start_progress), "skills", place)


def profile_stream(snapshot, searches, place=None):
    """The profile table after a stream of searches."""
    def newest(rows):
        best = rows.groupBy("user_id").agg(F.max(F.struct("created_at", "id", "domain", "work_mode", "age")).alias("u"))
        return best.select("user_id", "u.*")

    return merged_stream(searches, newest, lambda rows: upsert_profiles(snapshot, rows), "profiles", place)


def upsert_profiles(snapshot, searches):
    """The newest search overwrites the profile fields it carries."""
    newest = searches.groupBy("user_id").agg(F.max(F.struct("created_at", "id", "domain", "work_mode", "age")).alias("u"))
    return snapshot.select("user_id", "age", "preferred_domain", "primary_skill").join(newest, "user_id", "full_outer").select(
        "user_id", F.coalesce("u.age", "age").alias("age"), F.coalesce("u.domain", "preferred_domain").alias("preferred_domain"),
        "primary_skill", F.col("u.work_mode").alias("work_mode_preference"))


def latest_valid_status(changes, allowed):
    """Newest change of every entity (``kind``, ``entity_id``) whose value its kind allows; others are ignored."""
    valid = F.lit(False)
    for kind, states in allowed.items():
        valid = valid | ((F.col("kind") == kind) & F.col("status").isin(states))
    newest = changes.filter(valid).groupBy("kind", "entity_id").agg(F.max(F.struct("changed_at", "id", "status")).alias("u"))
    return newest.select("kind", "entity_id", "u.*")


def status_stream(changes, allowed, place=None):
    """The state of every entity from a stream of changes in any order."""
    newest = lambda rows: latest_valid_status(rows, allowed)
    return merged_stream(changes, newest, newest, "status", place)


def cascade_delete(removed, jobs, applications, courses):
    """What is left of jobs, applications and courses after organisations go."""
    jobs_left = jobs.join(removed.select(F.col("id").alias("org_id")), "org_id", "left_anti")
    courses_left = courses.join(removed.select(F.col("id").alias("org_id")), "org_id", "left_anti")
    gone = jobs.join(removed.select(F.col("id").alias("org_id")), "org_id", "left_semi").select(F.col("id").alias("job_id"))
    return jobs_left, applications.join(gone, "job_id", "left_anti"), courses_left
