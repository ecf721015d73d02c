"""Mixing of sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash. The words of a source that a target asks for beyond whole copies
are those of the documents below a hash threshold. The threshold is found by histograms of words per
source and hash bucket (4096 buckets): the bucket in which the budget ends is the only one that is
refined by the next 12 bits, until it holds a single hash value. No document is sorted, and a
smaller budget always takes a subset of what a larger one takes.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch

HASH_BITS, STEP = 60, 12
#: Tables of one row per source are broadcast up to so many rows.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def source_key(source):
    """A non-null string per source, nulls apart from all texts."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def document_hash(doc_id, text):
    """60 bits of the MD5 of id and text: the same in every run."""
    digest = F.md5(F.concat_ws("|", doc_id.cast("string"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Adds ``target`` to a table of one row per source (``source``, ``source_size``).

    Sources in code point order, null last, have the weights in turn. The budget is ``share`` of all
    words; no target is above ``limit`` times its source, what is cut off goes to the others by weight.
    That is target = min(cap, weight * level) for one level, found by sorting sources by cap / weight.
    The two ordered windows hold one row per source, no documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    placed = sizes.withColumn("place", place)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = (sizes.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = placed.withColumn("level", (F.lit(budget) - before) / left)
    free = (level.filter(F.col("cap") / F.col("weight") > F.col("level"))
            .agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), F.col("place")))).first()[0])
    target = F.col("cap") if free is None else F.least("cap", F.col("weight") * F.lit(free))
    return placed.withColumn("target", target).select("key", "source_size", "target")


def _by_source(df, small, rows):
    return df.join(F.broadcast(small) if rows <= BROADCAST_SOURCES else small, "key")


def thresholds(slim, targets, scratch):
    """``key, copies, below``: whole copies of every document and the hash below which one more is taken.

    ``slim`` has key, hash and size of every document. The boundary group (one hash value) is taken
    where that is nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    open_ = targets.withColumn("copies", whole.cast("int")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    open_ = scratch.keep(open_.select("key", "copies", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("words")), "level")
    rows = open_.count()
    for level in range(1, HASH_BITS // STEP + 1):
        shift = HASH_BITS - STEP * level
        inside = _by_source(slim, open_, rows).filter(F.shiftright("hash", shift + STEP) == F.col("prefix"))
        bucket = F.shiftright("hash", shift)
        sums = inside.groupBy("key", "copies", "rest", "words", bucket.alias("bucket")).agg(
            F.sum("size").alias("s"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        upto = F.sum("s").over(Window.partitionBy("key").orderBy("bucket")) + F.col("words")
        found = sums.withColumn("upto", upto).filter((F.col("upto") - F.col("s") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        open_ = scratch.keep(found.select("key", "copies", "rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("s")).alias("words"),
                                          "s", "low", "high"), "level")
        if open_.filter("low < high").isEmpty():
            break
    near = F.col("words") + F.col("s") - F.col("rest") <= F.col("rest") - F.col("words")
    return open_.select("key", F.when(near, F.col("low") + 1).otherwise(F.col("low")).alias("below"))


def mix_sources(docs, doc_id="doc_id", text="text", source="source", weights=(3, 1, 2), share=1.5, limit=2.0, into="mix"):
    """``docs`` with the struct ``into``: size, source_size, target, copies, taken (words, repeats counted).

    Null texts have size 0. A null source is a source of its own. Rows that are equal in id and text
    have one hash and are taken together. An empty table stays empty. A column of ``docs`` that is
    called like ``into`` is replaced; all others pass unchanged.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    body = F.col(text).cast("string")
    size = F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long")
    own = F.struct(source_key(F.col(source).cast("string")).alias("key"), document_hash(F.col(doc_id), body).alias("hash"), size.alias("size"))
    slim = scratch.keep(docs.select(own.alias("o"), F.col(source).cast("string").alias("source")).select("o.*", "source"), "slim")
    sizes = scratch.keep(slim.groupBy("key", "source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = scratch.keep(source_targets(sizes, weights, share, limit), "targets")
    cuts = thresholds(slim, targets, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = (targets.join(cuts, "key", "left")
            .select(F.struct("key", "source_size", "target", whole.alias("whole"), F.coalesce("below", F.lit(0)).alias("below")).alias("__plan")))
    few = targets.count() <= BROADCAST_SOURCES
    out = docs.withColumn("__own", own)
    out = out.join(F.broadcast(plan) if few else plan, F.col("__own.key") == F.col("__plan.key"), "left")
    copies = F.col("__plan.whole") + F.when(F.col("__own.hash") < F.col("__plan.below"), 1).otherwise(0)
    made = F.struct(F.col("__own.size").alias("size"), F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"),
                    copies.alias("copies"), (copies * F.col("__own.size")).alias("taken"))
    return out.withColumn(into, made).drop("__own", "__plan")
