"""A keyed table in buckets that a stream of changes keeps up to date.

A batch reads and writes the buckets that it touches and no others: what it costs follows the batch, not the
history. A bucket lies in one folder per version; a small list says which version of which bucket holds, and is written
last. A batch that is retried writes the same version again. Buckets of older versions are not removed, so that readers
that began before a batch can go on.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from workloom.session import scratch_path
from workloom.streaming.feeds import run_batches

BUCKET_ROWS = 1_000_000
LISTED = "bucket int, n long, version long"


def _listed(spark, place):
    """{bucket: (newest version, rows)}; empty before the first version."""
    try:
        rows = spark.read.schema(LISTED).parquet(f"{place}/listed")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    newest = rows.groupBy("bucket").agg(F.max(F.struct("version", "n")).alias("v")).collect()
    return {r.bucket: (r.v.version, r.v.n) for r in newest}


def _read(spark, place, schema, listed):
    paths = [f"{place}/rows/version={version}/bucket={bucket}" for bucket, (version, n) in listed.items() if n]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{place}/rows").parquet(*paths).drop("version", "bucket")


def _write(rows, keys, buckets, place, version, empty=()):
    """Writes rows as one version of their buckets, and then lists it; ``empty`` names buckets that may have no rows."""
    spark = rows.sparkSession
    path = f"{place}/rows/version={version}"
    placed = rows.withColumn("bucket", _bucket(keys, buckets))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = {r.bucket: r["count"] for r in spark.read.schema(placed.schema).parquet(path).groupBy("bucket").count().collect()}
    listed = [(b, written.get(b, 0)) for b in sorted({*written, *empty})]
    spark.createDataFrame(listed, "bucket int, n long").coalesce(1).write.mode("overwrite").parquet(f"{place}/listed/version={version}")


def _bucket(keys, buckets):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _newest(rows, keys, order, fields):
    """The newest change per key as ``u``: largest by ``order``, then by ``fields``."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *fields)).alias("u"))


def _all_equal(keys, left, right):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def snapshot_stream(base, changes, keys, order, fields, place=None, bucket_rows=BUCKET_ROWS):
    """The columns of ``base``, unique by ``keys``, and the newest change of every key as the struct ``u``.

    ``base`` is read by the first run over ``place`` only. Changes may come in any order: the largest by ``order`` and
    then by ``fields`` holds. Null keys are equal to each other. ``base`` has no columns ``u``, ``bucket``, ``version``.
    """
    spark = base.sparkSession
    place = place or scratch_path(spark, "snapshot")
    kind = _newest(spark.createDataFrame([], changes.schema), keys, order, fields).schema["u"].dataType
    start = base.withColumn("u", F.lit(None).cast(kind))
    others = [c for c in base.columns if c not in keys]
    if not _listed(spark, place):
        buckets = -(-max(base.count(), 1) // bucket_rows)
        _write(start, keys, buckets, place, 0, range(buckets))
    buckets = len(_listed(spark, place))

    def step(batch, folder, number):
        # Only versions before this one are read, so that a retried batch starts from the same rows.
        new = _newest(batch, keys, order, fields)
        touched = [r.bucket for r in new.select(_bucket(keys, buckets).alias("bucket")).distinct().collect()]
        if not touched:
            return
        before = spark.read.schema(LISTED).parquet(f"{place}/listed").filter((F.col("version") <= number) & F.col("bucket").isin(touched))
        listed = {r.bucket: (r.v.version, r.v.n) for r in before.groupBy("bucket").agg(F.max(F.struct("version", "n")).alias("v")).collect()}
        old = _read(spark, place, start.schema, listed).alias("o")
        both = old.join(new.alias("c"), _all_equal(keys, "o", "c"), "full_outer")
        # Both sides null-safe equal on the keys: where the old row is there, its keys hold, else those of the change.
        keyed = [F.coalesce(f"o.{k}", f"c.{k}").alias(k) for k in keys]
        _write(both.select(*keyed, *[F.col(f"o.{c}") for c in others], F.greatest("o.u", "c.u").alias("u")), keys, buckets, place, number + 1)

    run_batches(changes, step, place)
    return _read(spark, place, start.schema, _listed(spark, place))


def skill_snapshot(base, searches, start_progress=10, place=None, bucket_rows=BUCKET_ROWS):
    """The skill table after a stream of searches, as ``feeds.upsert_skills`` has it."""
    kept = base.select("user_id", "skill_name", "level", "progress", "updated_at")
    rows = snapshot_stream(kept, searches, ["user_id", "skill_name"], ["created_at", "id"], ["level"], place, bucket_rows)
    return rows.select("user_id", "skill_name", F.coalesce("u.level", "level").alias("level"),
                       F.coalesce("progress", F.lit(start_progress)).alias("progress"), F.coalesce("u.created_at", "updated_at").alias("updated_at"))


def profile_snapshot(base, searches, place=None, bucket_rows=BUCKET_ROWS):
    """The profile table after a stream of searches, as ``feeds.upsert_profiles`` has it."""
    kept = base.select("user_id", "age", "preferred_domain", "primary_skill")
    rows = snapshot_stream(kept, searches, ["user_id"], ["created_at", "id"], ["domain", "work_mode", "age"], place, bucket_rows)
    return rows.select("user_id", F.coalesce("u.age", "age").alias("age"), F.coalesce("u.domain", "preferred_domain").alias("preferred_domain"),
                       "primary_skill", F.col("u.work_mode").alias("work_mode_preference"))
