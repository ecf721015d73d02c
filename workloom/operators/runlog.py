"""Log of processing steps and its summary."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

LOG = "step STRING, rows_in BIGINT, rows_out BIGINT"


def run_steps(spark, steps):
    """One log row per step ``{name: (table, function)}``: rows before and after; none after where it failed.

    A step that cannot be planned on its table fails alone, the others go on.
    """
    rows = []
    for name, (table, step) in steps.items():
        before = table.count()
        try:
            after = step(table).count()
        except AnalysisException:
            after = None
        rows.append((name, before, after))
    return spark.createDataFrame(rows, LOG)


def summary(log):
    """Every step with status, removed rows and kept share, and one row over all of them."""
    done = F.col("rows_out").isNotNull()
    steps = log.select("step", F.when(done, "SUCCESS").otherwise("FAILED").alias("status"), "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("removed"),
                       F.round(100.0 * F.col("rows_out") / F.col("rows_in"), 4).alias("score"))
    none = F.lit(None).cast("bigint")
    failed = F.count_if(F.col("status") == "FAILED")
    whole = steps.agg(F.when(failed > 0, "FAILED").otherwise("SUCCESS").alias("status"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"),
                      F.sum("removed").alias("removed"), F.round(F.avg("score"), 4).alias("score"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"), failed.alias("failed"))
    return steps.withColumns({"succeeded": none, "failed": none}).unionByName(whole.withColumn("step", F.lit("ALL")))
