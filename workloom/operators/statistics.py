"""Exact quantiles and modes that no task has to hold in full."""

from pyspark.sql import functions as F

from workloom.operators.selection import grouped_quantiles

#: Distinct values that may come to the driver as one histogram.
HISTOGRAM_ROWS = 20_000


def _interpolated(rows, share, size):
    """Value at ``share`` of ``size`` sorted values with linear interpolation. ``rows``: ascending (value, count)."""
    place = share * (size - 1)
    low, high = int(place), int(place) + (1 if place > int(place) else 0)

    def at(k):
        seen = 0
        for value, n in rows:
            seen += n
            if seen > k:
                return value
        return rows[-1][0]

    a, b = at(low), at(high)
    return float(a) if low == high or a == b else (high - place) * a + (place - low) * b


def quantiles(df, columns, shares):
    """{column: exact values at ``shares``}, linearly interpolated; None without values.

    All columns are counted together by value: a small histogram is all that is collected. Where it would be
    large, the columns are stored once and the places found by refining histograms of all columns together.
    """
    if not columns:
        return {}
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "name", "value").filter("value IS NOT NULL")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(HISTOGRAM_ROWS + 1).collect()
    out = {c: [None] * len(shares) for c in columns}
    if len(few) <= HISTOGRAM_ROWS:
        by = {}
        for r in few:
            by.setdefault(r["name"], []).append((r["value"], r["n"]))
        for c, rows in by.items():
            rows.sort()
            size = sum(n for _, n in rows)
            out[c] = [_interpolated(rows, s, size) for s in shares]
        return out
    for r in grouped_quantiles(long, ["name"], "value", shares).collect():
        out[r["name"]] = list(r["q"])
    return out


def most_frequent(df, column):
    """The most frequent non-null value, ties to the smaller one; None without values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.desc("n"), column).limit(1).collect()
    return row[0][0] if row else None
