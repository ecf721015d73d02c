"""File sources and sinks: CSV, JSON reports, prefix scans, optional and sampled reads."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": False}


def read_csv(spark, path, schema):
    """Header CSV with a declared schema: one pass, no inference scan."""
    return spark.read.options(**CSV).schema(schema).csv(path)


def write_csv(df, path):
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_matching(spark, folder, pattern, schema):
    """All files of a folder that match ``pattern``, each row with its file name."""
    return (spark.read.options(**CSV, pathGlobFilter=pattern, recursiveFileLookup=True).schema(schema)
            .csv(folder).withColumn("source_file", F.col("_metadata.file_name")))


def read_if_present(spark, path, schema):
    """The table below ``path``, or an empty one where the path does not exist."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_report(metrics, path):
    """Metric rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def preview(df, key, n):
    """First ``n`` rows by key; a sort with limit keeps n rows per task."""
    return df.orderBy(key).limit(n)


def hash_sample(df, key, keep, of):
    """Repeatable sample: the same rows whatever the partitioning."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.filter(number % of < keep)
