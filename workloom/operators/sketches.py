"""Distinct counts from sketches that are stored per part of a table and united later."""

from pyspark.sql import functions as F

#: 2^12 registers: estimates are off by 1.6 % (one standard deviation).
PRECISION = 12


def distinct_sketches(df, columns, part, precision=PRECISION):
    """``part, column, n, sketch``: one row per part and column, some kilobytes each; nulls are not counted.

    Rows that are added to a table need sketches of their own only; no row is read twice.
    """
    made = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), *[
        F.hll_sketch_agg(F.col(c).cast("string"), precision).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]))
    return made.select("part", "n", rows.alias("r")).select("part", "r.column", "n", "r.sketch")


def distinct_estimates(sketches, *keys):
    """Estimated distinct values per column (and ``keys``, which may name ``part``) from stored sketches."""
    united = sketches.groupBy(*keys, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("n").alias("n"))
    return united.select(*keys, "column", "n", "estimate")
