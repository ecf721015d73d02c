"""Interaction of document filters, counted on sorted posting lists.

Every part of the corpus keeps, per filter, the sorted list of the rows that fail it. Lists are cut
into ranges of ``RANGE`` row numbers, so no list grows with the table and a part with a third of all
rows is many ranges. Inside a range

* the rows that some filters drop together are a k-way union of their lists,
* the rows that a filter drops after others are the difference of its list and that union,

both by galloping: the shorter list is searched in the longer one. Only sizes leave the tasks; they
are summed over all ranges. An order of filters is a chain of such differences, so the sizes per
filter and set of earlier filters answer all orders, and no document is looked at once per order.
"""

from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch, dealt_join, quoted

#: Row numbers per posting list: 128 KB at most.
RANGE = 1 << 14
#: Texts that occur several times, and marked ids, that are broadcast; beyond, hot ones alone are.
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"

SIZES = "part string, filter int, prior int, failing long, before long, removed long, good long, toxic long"


# --- the five filters of the audit --------------------------------------------------------------

def text_filters(docs, scratch, doc_id="doc_id", text="text", part="lang"):
    """``doc_id, part, A, B, C, D, E``: one row per document with the filters that it fails; null texts are empty.

    A: under 200 words. B: distinct words are less than half of all. C: over 3 % of the code points are
    A to Z. D: one of #$%&*| occurs. E: the text equals that of a smaller id anywhere in the table;
    rows without an id neither fail E nor make others fail it, equal rows of one id do not either.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    measured = docs.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    measured = measured.select(
        "doc_id", "part", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"),
        F.regexp_count("body", F.lit("[A-Z]")).alias("upper"), F.char_length("body").alias("points"), F.col("body").rlike(r"[#$%&*|]").alias("D"),
        F.xxhash64("body").alias("text_a"), F.xxhash64(F.lit(7), "body").alias("text_b"))
    slim = scratch.keep(measured.select(
        "doc_id", "part", (F.col("n") < 200).alias("A"), (100 * F.col("different").cast("long") < 50 * F.col("n").cast("long")).alias("B"),
        (100 * F.col("upper").cast("long") > 3 * F.col("points").cast("long")).alias("C"), "D", "text_a", "text_b"), "measured")
    groups = slim.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = dealt_join(slim, scratch.keep(groups, "groups"), ["text_a", "text_b"], BROADCAST_ROWS, "left")
    return out.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def with_marks(rows, labels, scratch, doc_id="doc_id", good="quality", toxic="toxic"):
    """``rows`` with the flags ``good`` and ``toxic``: some label row of the id has a 1 there."""
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col(toxic) == 1), F.lit(False)).alias("toxic"))
    known = scratch.keep(known.filter("good OR toxic"), "marks")
    if known.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(known), "doc_id", "left")
    else:
        none = rows.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
        out = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(none)
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


# --- posting lists --------------------------------------------------------------------------------

def posting_lists(flagged, filters, scratch, size=RANGE):
    """``part, range, n, good, toxic`` and one sorted list per filter: numbers of the rows that fail it.

    Row numbers are positions in the stored table, so they are unique whatever the ids, ascending in
    every partition, and the same when a task runs again.
    """
    stored = scratch.keep(flagged, "flagged").withColumn("row", F.monotonically_increasing_id())
    lists = [F.array_sort(F.collect_list(F.when(F.col(quoted(c)), F.col("row")))).alias(c) for c in (*filters, "good", "toxic")]
    grouped = stored.groupBy("part", F.floor(F.col("row") / size).cast("long").alias("range"))
    return scratch.keep(grouped.agg(F.count(F.lit(1)).alias("n"), *lists), "postings")


def inside(needles, hay):
    """Truth per sorted needle: it is in the sorted ``hay``. The shorter list gallops through the longer."""
    if not len(needles) or not len(hay):
        return np.zeros(len(needles), bool)
    if len(needles) <= len(hay):
        at = np.searchsorted(hay, needles)
        return hay[np.minimum(at, len(hay) - 1)] == needles
    out = np.zeros(len(needles), bool)
    at = np.searchsorted(needles, hay)
    met = needles[np.minimum(at, len(needles) - 1)] == hay
    out[at[met]] = True
    return out


def union(lists):
    """Sorted union of sorted lists: the longest takes in the others, of which only new rows are inserted."""
    out, *rest = sorted(lists, key=len, reverse=True)
    for more in rest:
        new = more[~inside(more, out)]
        out = np.insert(out, np.searchsorted(out, new), new)
    return out


def interactions(lists, good, toxic):
    """(filter, prior set as bits, failing, before, removed, removed good, removed toxic) for every filter and
    every set of other filters that came before; ``before`` is what the prior filters removed together."""
    k = len(lists)
    unions = [np.empty(0, np.int64)] + [union([lists[i] for i in range(k) if bits >> i & 1]) for bits in range(1, 1 << k)]
    for f in range(k):
        for prior in range(1 << k):
            if not prior >> f & 1:
                left = lists[f][~inside(lists[f], unions[prior])]
                yield f, prior, len(lists[f]), len(unions[prior]), len(left), int(inside(left, good).sum()), int(inside(left, toxic).sum())


def _sizes(names):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lists = {c: batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (*names, "good", "toxic")}
                found = list(zip(*interactions([lists[c] for c in names], lists["good"], lists["toxic"]), strict=True))
                part = pa.array([batch.column("part")[row].as_py()] * len(found[0]), pa.string())
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([part, *[pa.array(v, t) for v, t in zip(found, kinds, strict=True)]],
                                                 names=["part", "filter", "prior", "failing", "before", "removed", "good", "toxic"])

    return run


# --- all orders -----------------------------------------------------------------------------------

def _steps(spark, filters):
    """One row per order and step: letter of the filter and the bits of those applied earlier."""
    rows = []
    for order in permutations(range(len(filters))):
        prior = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, f, prior))
            prior |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, prior int")


def _orders_with(spark, k):
    """In how many orders exactly the filters of ``prior`` come before a filter, per set."""
    rows = [(sum(1 << i for i in some), factorial(len(some)) * factorial(k - 1 - len(some))) for n in range(k) for some in combinations(range(k), n)]
    return spark.createDataFrame(rows, "prior int, orders long")


def audit_filters(flagged, filters, scratch=None, size=RANGE):
    """One row per part, order of the filters and step of the order.

    ``flagged`` has a row per document with ``part`` (string, not null), a boolean per filter (one-letter
    names), and the booleans ``good`` and ``toxic``, all not null; more columns are ignored. ``kept`` and
    ``removed`` follow the order; ``redundant`` fail the filter of the step but were removed earlier;
    ``unique_fails`` fail this filter only; ``good_lost`` and ``toxic_lost`` are marked rows among the removed;
    ``shapley`` sums what the filter removes over all orders. Repeated rows count again. Parts are the
    values that occur; an empty table has no rows. The tables of orders have k! * k rows for k filters.
    """
    spark = flagged.sparkSession
    scratch = scratch or Scratch(spark, "audit")
    filters = list(filters)
    lists = posting_lists(flagged, filters, scratch, size)
    numbers = [F.sum(c).alias(c) for c in ("failing", "before", "removed", "good", "toxic")]
    sizes = scratch.keep(lists.select("part", *[F.col(quoted(c)) for c in filters], "good", "toxic").mapInArrow(_sizes(filters), SIZES)
                         .groupBy("part", "filter", "prior").agg(*numbers), "sizes")
    totals = lists.groupBy("part").agg(F.sum("n").alias("n"))
    rest = F.lit((1 << len(filters)) - 1) - F.expr("shiftleft(1, filter)")
    per_filter = (sizes.join(F.broadcast(_orders_with(spark, len(filters))), "prior").groupBy("part", "filter")
                  .agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"), F.sum(F.when(F.col("prior") == rest, F.col("removed")).otherwise(0)).alias("unique_fails")))
    rows = sizes.join(F.broadcast(_steps(spark, filters)), ["filter", "prior"]).join(totals, "part").join(per_filter, ["part", "filter"])
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.col("before") - F.col("removed")).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
