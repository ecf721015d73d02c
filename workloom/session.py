"""Session helpers: local sessions for tests, shared folder lookup for jobs."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", app="workloom", shuffle_partitions=8, driver_memory="20g"):
    """A local session. Clusters bring their own session; nothing here is needed there."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark):
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only in a local session where that is
    unset (tests) a temporary folder is made and set for the rest of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="workloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df, *keys):
    """Hash partitioning in the session's number of shuffle partitions. Naming the number keeps
    rows that are few bytes but much work from being merged into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_by_rows(df, rows):
    """At least one task per ``rows`` rows; a table that is read in as many tasks stays as it is. Splits go by bytes, so
    that narrow rows that are much work come in a few tasks."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def spread_over_cores(df, rows, most=100_000):
    """A task per core, or per ``rows`` rows where they are fewer, for steps that pass many times over narrow rows; beyond
    ``most`` rows a core a task per ``most`` rows, so that what a task reads is bounded. A table in as many tasks stays."""
    n = df.count()
    tasks = max(min(-(-n // rows), df.sparkSession.sparkContext.defaultParallelism), -(-n // most))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def in_tasks(df, tasks):
    """``df`` in so many tasks; more are put together without a shuffle."""
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df.coalesce(tasks)


def scratch_path(spark, label):
    """A fresh path below the shared folder for one run of one job."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df, label):
    """Cut the lineage of ``df`` through a Parquet table in the shared folder.

    Unlike a cache, the table survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
