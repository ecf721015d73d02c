"""Intermediate tables of one operator run, in the shared folder of the session."""

from pyspark.sql import functions as F

from workloom.session import scratch_path


def quoted(name):
    """A column name that may hold dots and back quotes, as a reference."""
    return "`" + name.replace("`", "``") + "`"


def dealt_join(left, right, key, most, how="inner"):
    """Join with ``right``, unique by ``key``, whose column ``n`` is the number of its rows in ``left``.

    A table of up to ``most`` rows is broadcast. Of a larger one, those keys are that hold more than one of
    ``most`` parts of all rows, so ``most`` of them at most; the rest is dealt by key, and no key is a large task.
    """
    size = right.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    right, hot = right.withColumn("__met", F.lit(True)), F.col("n").cast("double") * most > float(size.total)
    if size.rows <= most:
        return left.join(F.broadcast(right.drop("n")), key, how).drop("__met")
    names = [c for c in right.columns if c not in (*key, "n")]
    out = left.join(F.broadcast(right.filter(hot).select(*key, F.struct(*names).alias("__hot"))), key, "left")
    out = out.join(right.filter(~hot).select(*key, F.struct(*names).alias("__cold")), key, "left")
    out = out.withColumns({c: F.coalesce(f"__hot.{c}", f"__cold.{c}") for c in names})
    return (out if how == "left" else out.filter("__met")).drop("__hot", "__cold", "__met")


class Scratch:
    """Keeps named tables as Parquet below one folder; lineage ends there and outlives executors."""

    def __init__(self, spark, label):
        self.spark = spark
        self.folder = scratch_path(spark, label)
        self.made = 0

    def path(self, name):
        self.made += 1
        return f"{self.folder}/{self.made:03d}-{name}"

    def keep(self, df, name):
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
