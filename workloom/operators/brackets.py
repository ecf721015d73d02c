"""Range join of values with a table of brackets, by bins."""

from pyspark.sql import functions as F

from workloom.text.tfidf import broadcast_if_small

#: Bins over the span of the values; a bracket is in as many bins as it touches.
BINS = 1024


def bracket_join(rows, brackets, value, low="low", high="high", bins=BINS):
    """Every row of ``rows`` with each bracket, low <= value < high, that holds its value; null brackets where none does.

    A null bound is open. Brackets may overlap, leave gaps, be any number, and be a table of any source: both
    sides meet by equality on a bin of the span of the values, the bounds are a condition on top, so there is
    no nested loop. Null values are in no bracket. Columns of ``brackets`` must differ from those of ``rows``;
    brackets without a value between their bounds add nothing.
    """
    least, most = rows.agg(F.min(F.col(value).cast("double")), F.max(F.col(value).cast("double"))).first()
    least, most = (0.0, 0.0) if least is None else (least, most)
    width = (most - least) / bins or 1.0

    def bin_of(x):
        return F.floor((F.greatest(F.least(x.cast("double"), F.lit(most)), F.lit(least)) - F.lit(least)) / F.lit(width)).cast("int")

    first, last = F.coalesce(F.col(low), F.lit(least)), F.coalesce(F.col(high), F.lit(most))
    open_ = (F.col(low).isNull() | (F.col(low) <= F.lit(most))) & (F.col(high).isNull() | (F.col(high) > F.lit(least)))
    valid = F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high))
    placed = brackets.filter(open_ & valid).select("*", F.explode(F.sequence(bin_of(first), bin_of(last))).alias("__at"))
    held = rows.withColumn("__bin", bin_of(F.col(value)))
    few = broadcast_if_small(placed)
    inside = F.col(value).isNotNull() & (F.col("__bin") == F.col("__at")) & (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return held.join(few, inside, "left").drop("__bin", "__at")
