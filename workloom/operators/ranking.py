"""Ranks over a whole table without a single-partition window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.session import written

#: Rows of one range of a global order; the number of ranges follows the table.
RANGE_ROWS = 1_000_000
_IN_RANGE = (1 << 33) - 1


def _in_order(df, keys, buckets=None):
    """``df`` stored in the order of ``keys``: ``__b`` is the range of a row, ``__r`` its place in it from 0.

    Ranges hold about ``RANGE_ROWS`` rows however large the table is. One shuffle by sampled bounds; keys that
    end with a row id also split a value that most rows have. The written table fixes the places, so that lost
    executors or another sample change nothing in what is read later.
    """
    if buckets is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(tasks, -(-df.count() // RANGE_ROWS))
    place = F.monotonically_increasing_id()  # number of the task, then of the row within it
    sorted_ = df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).withColumn("__at", place)
    stored = written(sorted_, "ordered")
    return stored.withColumns({"__b": F.shiftright("__at", 33).cast("int"), "__r": F.col("__at").bitwiseAND(F.lit(_IN_RANGE))}).drop("__at")


def _before(totals, values):
    """Sums over the ranges before each. One row per range, so the ordered window here is small."""
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__b", *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__s_{v}") for v in values])


def dense_rank_rows(df, order, row_id, name="rank", buckets=None):
    """Adds the 1-based position of every row by (``order``, ``row_id``).

    The table is dealt by ranges of both, sorted there, and places are shifted by the sizes of the ranges
    before. ``order`` may be None to rank by row id alone.
    """
    placed = _in_order(df, [c for c in (order, row_id) if c is not None], buckets)
    starts = _before(placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__t_n")), ["n"])
    return (placed.join(F.broadcast(starts), "__b")
            .withColumn(name, (F.col("__r") + F.col("__s_n") + 1).cast("long")).drop("__b", "__r", "__s_n"))


def quintile_labels(df, value, row_id, labels, name):
    """Five balanced classes by rank; ties go by row id. One row alone gets the first class."""
    ranked = dense_rank_rows(df, value, row_id, "__rank")
    total = ranked.count()
    number = (F.greatest(F.lit(1), F.ceil((F.col("__rank") - 1) * 5 / F.lit(float(total - 1))))
              if total > 1 else F.lit(1))
    return ranked.withColumn(name, F.element_at(F.array(*[F.lit(x) for x in labels]), number.cast("int"))).drop("__rank")


def first_per_key(df, keys, order):
    """Keep the first row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def top_per_key(df, keys, order, n, rank=None):
    """Keep the first ``n`` rows of every key; the rank limit runs before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return out.withColumnRenamed("__r", rank) if rank else out.drop("__r")


def sums_before(df, order, values, buckets=None):
    """Adds ``<v>_before``: the sum of ``v`` over all rows with a smaller ``order``.

    ``order`` must be unique. Ranges of it are summed on their own and shifted by the totals of the ranges
    before them, so no task sees the whole table.
    """
    keyed = _in_order(df, [order], buckets)
    starts = _before(keyed.groupBy("__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in values]), values)
    within = Window.partitionBy("__b").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumns({f"__w_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(F.broadcast(starts), "__b")
    return out.select(*df.columns, *[(F.col(f"__w_{v}") + F.col(f"__s_{v}")).alias(f"{v}_before") for v in values])
