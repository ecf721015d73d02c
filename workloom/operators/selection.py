"""Exact quantiles of all groups at once, by refining histograms of their values."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.session import written
from workloom.text.tfidf import broadcast_if_small

#: Buckets per unit of the logarithm in the first histogram, and per range that is refined.
FIRST, BUCKETS = 64, 1024


def _same(left, right, names):
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"{n}_"]) for n in names])


def _holding(histogram, names, within, wanted):
    """Buckets that hold a wanted place, with the number of values below them. ``within``: groups and ranges."""
    order = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("below", F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    inside = F.filter(wanted, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return placed.withColumn("wanted", inside).filter(F.size("wanted") > 0).select(*names, "total", "below", "low", "high", "wanted")


def grouped_quantiles(df, keys, value, shares, weight=None):
    """``keys..., q``: for every group the exact values at ``shares``, an array, linearly interpolated.

    A histogram per group (buckets of like logarithm) tells which buckets hold the wanted places; only those
    are cut again, between their least and largest value, until a bucket holds a single value. A round is one
    pass over the narrow stored values, summed per task before it is shuffled, so no task holds a group.
    ``weight`` names a column that says how often a row counts. Null and NaN values are left out, groups
    without values have no row; null keys are a group.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v"),
                     (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("n"))
    rows = written(rows.filter("v IS NOT NULL AND NOT isnan(v) AND n > 0"), "values")
    summed = [F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]

    bucket = F.floor(F.signum("v") * F.log1p(F.abs("v")) * FIRST)
    first = rows.groupBy(*names, bucket.alias("bucket")).agg(*summed)
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy(*names))).withColumn("base", F.lit(0).cast("long"))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in _places(shares)])))
    held = written(_holding(first, names, names, places), "held")
    found = []
    while True:
        found.append(held.filter("low = high").select(*names, "total", F.col("low").alias("v"), "wanted"))
        ranges = held.filter("low < high")
        if ranges.isEmpty():
            break
        ranges = ranges.withColumnsRenamed({n: f"{n}_" for n in names})
        few = broadcast_if_small(ranges)
        met = rows.join(few, _same(rows, few, names) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        # Halves, so that the width of a range is finite.
        place = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS)
        cut = met.withColumn("bucket", F.least(place, F.lit(BUCKETS - 1))).withColumnsRenamed({"low": "from", "below": "base"})
        histogram = cut.groupBy(*names, "total", "base", "from", F.col("wanted").alias("asked"), "bucket").agg(*summed)
        held = written(_holding(histogram, names, [*names, "from"], F.col("asked")), "held")
    at = reduce(lambda a, b: a.unionByName(b), found).select(*names, "total", "v", F.explode("wanted").alias("place"))
    at = at.groupBy(*names, "total").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"))
    return at.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.array(*[_interpolated(p) for p in _places(shares)]).alias("q"))


def _places(shares):
    return [F.lit(float(s)) * (F.col("total") - 1) for s in shares]


def _interpolated(place):
    low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
    a, b = F.col("at")[low], F.col("at")[high]
    return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)
