"""N-gram Jaccard self join: rare-first prefix filter with length, positional and suffix filters.

1. Every document becomes a set of hashed word n-grams; rows with equal sets are one node.
2. All grams are put in one order, rare ones first. How rare a gram is tells a table of counts by
   ``SLOTS`` hash slots, summed over all documents: any fixed order gives the same links, a good one gives
   few candidates. Two sets that link share a gram among the first few of both (their prefixes).
3. Nodes meet in the bucket of a shared prefix gram. A pair passes only where its sizes allow the
   similarity (length), the places of the gram in both orders leave enough grams in common
   (positional), and the sizes of 64 parts, into which fixed pivots cut both sets, do (suffix filter:
   the differences of the part sizes bound the number of grams that are in one set only).
4. Links are confirmed on full sets. First every node meets the smallest node of its buckets only, so a
   group of n copies gives n pairs per gram, and linked nodes are merged to classes. After that only
   pairs of different classes are looked at: in small buckets by an equi join, once per pair; in large
   ones inside tasks, block by block, in the bucket of the pair's first common gram. There the class with
   most rows of a bucket meets the other rows only, so the rows sent follow what is not merged yet, and
   only links that merge classes leave a task.

Nothing is capped; classes are those of all links.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workloom.llm.classes import connected_classes
from workloom.llm.neardup import shingle_sets
from workloom.llm.scratch import Scratch, dealt_join

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
PARTS = 64
#: Buckets of more nodes are cut into blocks of at most about BLOCK nodes.
SMALL, BLOCK = 48, 1024
#: Rows of a joined table up to which it is broadcast (about 50 bytes each); beyond, hot keys alone are.
BROADCAST_ROWS = 200_000
#: Of grams, those that hold more than one of so many parts of all rows are broadcast; the others are dealt.
HOT_GRAMS = 10_000

SIGNED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("text_a", T.LongType()), T.StructField("text_b", T.LongType()),
    T.StructField("items", T.LongType()), T.StructField("print_a", T.LongType()), T.StructField("print_b", T.LongType()),
    T.StructField("parts", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType(), False)),
])


# --- sets, order and prefixes ---------------------------------------------------------------------

def _slot(grams):
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(words):
    """How many documents of the task have a gram of a slot, counted per gram."""
    def run(batches):
        counts, held, size = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), words):
                held.append(_slot(found))
                size += len(found)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])

    return run


def gram_counts(source, words):
    """An array of SLOTS counts over all texts; the table that comes to the driver has SLOTS rows at most."""
    table = source.select("text").mapInArrow(_slot_counts(words), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return counts


def prefix_length(items, percent):
    """Of a set that meets larger or smaller ones: it shares a gram of so many first ones with each it links with."""
    return items + (percent * items * -1) // 100 + 1


def prefix(found, counts, percent):
    """The first grams of a sorted set, rarest first, ties by hash."""
    order = np.argsort(counts[_slot(found)], kind="stable")
    return found[order[:prefix_length(len(found), percent)]]


def part_sizes(found):
    """Number of grams between fixed pivots, modulo 256."""
    return np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.uint8)


def _sign(counts, words, percent):
    def run(batches):
        base, seen = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            items, prints, parts, grams = [], [], [], []
            for _, found in shingle_sets(batch.column(1), words):
                items.append(len(found))
                if not len(found):
                    prints.append((None, None))
                    parts.append(None)
                    grams.append(None)
                    continue
                mixed = found * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                prints.append((int(np.bitwise_xor.reduce(found).view(np.int64)), int(np.add.reduce(mixed, dtype=np.uint64).view(np.int64))))
                parts.append(part_sizes(found).tobytes())
                grams.append(prefix(found, counts.value, percent).view(np.int64))
            rows = np.arange(base + seen, base + seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), batch.column(2), batch.column(3), pa.array(items, pa.int64()), pa.array([a for a, _ in prints], pa.int64()),
                 pa.array([b for _, b in prints], pa.int64()), pa.array(parts, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], names=SIGNED.names)

    return run


# --- filters --------------------------------------------------------------------------------------

def _needed(x, y, percent):
    """Common grams that two sets of these sizes need, in numpy or Spark expressions as text."""
    if isinstance(x, str):
        return f"((({percent} * ({x} + {y})) + {99 + percent}) div {100 + percent})"
    return -((-percent * (x + y)) // (100 + percent))


def may_link(x, y, parts_x, parts_y, percent):
    """Length and suffix filter on arrays of pairs: sizes, and rows of part sizes."""
    far = parts_x - parts_y
    far = np.minimum(far, np.uint8(0) - far).sum(axis=1, dtype=np.int64)  # modulo 256: never above the true difference
    return (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (x + y - far >= 2 * _needed(x, y, percent))


def _matrix(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS)


def _numbers(column):
    return np.asarray(column.to_numpy(), np.int64)


def _prune(percent):
    def run(batches):
        for batch in batches:
            keep = may_link(_numbers(batch.column("items_a")), _numbers(batch.column("items_b")), _matrix(batch.column("parts_a")), _matrix(batch.column("parts_b")), percent)
            yield batch.select(["a", "b", "couple"]).filter(pa.array(keep))

    return run


def _pruned(pairs, nodes, percent):
    """``a, b, couple``: those pairs that their sizes and part sizes allow."""
    sides = [nodes.select(F.col("node").alias(s), F.col("items").alias(f"items_{s}"), F.col("parts").alias(f"parts_{s}")) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").filter(f"100 * least(items_a, items_b) >= {percent} * greatest(items_a, items_b)")
    return joined.select("a", "b", "couple", "items_a", "items_b", "parts_a", "parts_b").mapInArrow(_prune(percent), "a long, b long, couple boolean")


def _linked(percent, words):
    """Pairs that link by their full sets: 100 * common >= percent * union, in whole numbers."""
    def run(batches):
        for batch in batches:
            keep = []
            for i, ((_, x), (_, y)) in enumerate(zip(shingle_sets(batch.column("text_a"), words), shingle_sets(batch.column("text_b"), words), strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _confirmed(pairs, texts, percent, words):
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked(percent, words), "a long, b long")


# --- large buckets, inside tasks ------------------------------------------------------------------

def _block_live(percent, step=256):
    """Nodes of two blocks with a partner of another class that all filters let pass."""
    def run(key, left, right):
        a, b = _numbers(left.column("node")), _numbers(right.column("node_"))
        ca, cb = _numbers(left.column("comp")), _numbers(right.column("comp_"))
        xa, xb = _numbers(left.column("items")), _numbers(right.column("items_"))
        pa_, pb = _numbers(left.column("pos")), _numbers(right.column("pos_"))
        sa, sb = _matrix(left.column("parts")), _matrix(right.column("parts_"))
        live_a, live_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i in range(0, len(a), step):
            x, y, p, q = xa[i:i + step, None], xb[None, :], pa_[i:i + step, None], pb[None, :]
            enough = np.minimum(p, q) + 1 + np.minimum(x - p - 1, y - q - 1) >= _needed(x, y, percent)
            u, v = np.nonzero(enough & (ca[i:i + step, None] != cb[None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)))
            u += i
            for k in range(0, len(u), 1 << 16):
                s, t = u[k:k + (1 << 16)], v[k:k + (1 << 16)]
                keep = may_link(xa[s], xb[t], sa[s], sb[t], percent)
                live_a[s[keep]] = live_b[t[keep]] = True
        return pa.table({"node": pa.array(np.union1d(a[live_a], b[live_b]), pa.int64())})

    return run


class _Known:
    """Numbers for the grams of several sets, to see quickly what another set shares with each of them."""

    def __init__(self, sets):
        self.size = np.array([len(s) for s in sets])
        self.begin = np.cumsum(self.size) - self.size
        self.grams, self.at = np.unique(np.concatenate(sets), return_inverse=True)

    def mark(self, own, values, missing):
        """``values`` of ``own`` at the place of every gram of every set, ``missing`` elsewhere."""
        marks = np.full(len(self.grams), missing, np.int64)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        met = self.grams[at] == own
        marks[at[met]] = values[met]
        return marks


def _block_links(counts, percent, words):
    """Links between two blocks of a bucket, as few as connect what is linked.

    A pair is confirmed only in the bucket of its first common gram; classes are merged on the way, so
    pairs that are connected already are passed over.
    """
    def run(key, left, right):
        gram = np.int64(key[0].as_py()).view(np.uint64)
        a, b = _numbers(left.column("node")), _numbers(right.column("node_"))
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(a) or not len(b):
            return none
        _, label = np.unique(np.concatenate([_numbers(left.column("comp")), _numbers(right.column("comp_"))]), return_inverse=True)
        la, lb = label[:len(a)].copy(), label[len(a):].copy()
        sets = [s for _, s in shingle_sets(right.column("text_"), words)]
        whole, first = _Known(sets), _Known([prefix(s, counts.value, percent) for s in sets])
        found = []
        for i, own in shingle_sets(left.column("text"), words):
            near = (lb != la[i]) & (whole.size * 100 >= percent * len(own)) & (len(own) * 100 >= percent * whole.size)
            if not near.any():
                continue
            start = prefix(own, counts.value, percent)
            order = first.mark(start, np.arange(len(start)), len(start))
            here = np.flatnonzero(start == gram)[0]
            near &= np.minimum.reduceat(order[first.at], first.begin) == here
            some = np.flatnonzero(near)
            if not len(some):
                continue
            mark = whole.mark(own, np.ones(len(own), np.int64), 0)
            common = np.array([mark[whole.at[whole.begin[j]:whole.begin[j] + whole.size[j]]].sum() for j in some])
            for j in some[100 * common >= percent * (len(own) + whole.size[some] - common)]:
                if lb[j] != la[i]:
                    found.append((a[i], b[j]))
                    old, new = lb[j], la[i]
                    la[la == old], lb[lb == old] = new, new
        both = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both.min(axis=1), pa.int64()), "b": pa.array(both.max(axis=1), pa.int64())}) if found else none

    return run


def _cut(large, block):
    """Rows of large buckets with the class of most rows (``main``) and all others apart, each side in blocks."""
    sizes = large.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("n"))
    main = main.select("gram", F.col("most.comp").alias("main"), F.ceil(F.col("most.k") / block).cast("int").alias("mains"),
                       F.ceil((F.col("n") - F.col("most.k")) / block).cast("int").alias("rests"), "n")
    return main


def _block_groups(cut, payload, run, schema):
    """Pairs of blocks of a bucket, each once: a block of the main class with one of the others, two of the others."""
    is_main = F.col("comp") == F.col("main")
    number = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    placed = cut.withColumn("own", number)
    columns = ["gram", "node", "comp", *payload]
    others = F.sequence(F.when(is_main, F.lit(0)).otherwise(F.col("own")), F.col("rests") - 1)
    left = placed.select(*columns, is_main.alias("i_main"), F.col("own").alias("i"), F.explode(others).alias("j"))
    # On the right a row of the others meets every block of the main class and those of the others up to its own.
    meets = F.concat(F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(F.lit(True).alias("of_main"), i.alias("i"))),
                     F.transform(F.sequence(F.lit(0), F.col("own")), lambda i: F.struct(F.lit(False).alias("of_main"), i.alias("i"))))
    right = placed.filter(~is_main).select(*[F.col(c).alias(f"{c}_") for c in columns], F.explode(meets).alias("m"), F.col("own").alias("j_"))
    right = right.select("*", F.col("m.of_main").alias("of_main_"), F.col("m.i").alias("i_")).drop("m")
    return (left.groupBy("gram", "i_main", "i", "j").cogroup(right.groupBy("gram_", "of_main_", "i_", "j_")).applyInArrow(run, schema))


# --- the join -------------------------------------------------------------------------------------

def ngram_classes(docs, doc_id="doc_id", text="text", words=4, percent=85, small=SMALL, block=BLOCK):
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id that links reach, its own included).

    Two documents link where 100 * common >= percent * union of their sets of ``words``-word shingles
    (lower-cased A-Z, words without white space); texts of fewer words have their whole sequence as the
    one shingle. Nulls and texts without words have an empty set and no links. Every row is a document of
    its own, also where ids repeat, whatever the texts; rows without an id link like others, and a class of
    such rows alone has a null component. Further columns of ``docs`` are ignored. Sets are compared by
    64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngramjoin")
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), body.alias("text"), F.xxhash64(body).alias("text_a"), F.xxhash64(F.lit(7), body).alias("text_b"))
    counts = spark.sparkContext.broadcast(gram_counts(source, words))
    signed = scratch.keep(source.mapInArrow(_sign(counts, words, percent), SIGNED), "signed")

    # Equal sets are one node: its first row.
    members = signed.filter("items > 0").select("row", "print_a", "print_b")
    prints = members.groupBy("print_a", "print_b").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    prints = scratch.keep(prints, "prints")
    copies = scratch.keep(dealt_join(members, prints, ["print_a", "print_b"], BROADCAST_ROWS).select("row", "node"), "copies")
    later = copies.filter("row > node").select("row")
    nodes = signed.filter("items > 0").join(later, "row", "left_anti").withColumnRenamed("row", "node").join(prints.select("node", "n"), "node", "left")
    nodes = scratch.keep(nodes.select("node", "items", "parts", "grams", "text_a", "text_b", F.coalesce("n", F.lit(1)).alias("n")), "nodes")
    slim = nodes.select("node", "items", "parts")

    entries = nodes.select("node", "items", F.posexplode("grams").alias("pos", "gram"))
    buckets = entries.groupBy("gram").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    shared = scratch.keep(dealt_join(entries, scratch.keep(buckets, "buckets"), ["gram"], HOT_GRAMS).select("gram", "node", "items", "pos", "least", "size"), "shared")

    # First round: every node with the least node of its buckets.
    stars = shared.filter("node > least").groupBy(F.col("least").alias("a"), F.col("node").alias("b")).agg(F.max(F.col("size") == 2).alias("couple"))
    alive = scratch.keep(_pruned(stars, slim, percent), "alive")
    best = scratch.keep(alive.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(alive.filter("couple").select("a", "b")).distinct(), "best")
    links = scratch.keep(_confirmed(best, _texts_of(source, nodes, _both(best), scratch), percent, words), "links")
    classes = connected_classes(links, scratch)

    # Second round: buckets with several classes.
    placed = shared.filter("size > 2").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    mixed = scratch.keep(mixed.select("gram", "n", F.lit(True).alias("several")), "mixed-buckets")
    mixed = scratch.keep(dealt_join(placed, mixed, ["gram"], HOT_GRAMS).select("gram", "node", "items", "pos", "comp", "size"), "mixed")
    pairs = _small_pairs(mixed.filter(F.col("size") <= small), percent).join(best, ["a", "b"], "left_anti").withColumn("couple", F.lit(False))
    pairs = scratch.keep(_pruned(pairs, slim, percent).select("a", "b"), "pairs")
    more = scratch.keep(_confirmed(pairs, _texts_of(source, nodes, _both(pairs), scratch), percent, words), "more")
    new = links.union(more)
    large = mixed.filter(F.col("size") > small)
    if not large.isEmpty():
        sides = scratch.keep(_cut(large, block), "sides")
        cut = dealt_join(large.select("gram", "node", "items", "pos", "comp"), sides, ["gram"], BROADCAST_ROWS)
        cut = scratch.keep(cut.join(slim.select("node", "parts"), "node"), "cut")
        live = scratch.keep(_block_groups(cut, ["items", "pos", "parts"], _block_live(percent), "node long").distinct(), "live")
        texts = _texts_of(source, nodes, live, scratch)
        of_live = cut.drop("parts", "pos", "items").join(texts, "node")
        new = new.union(_block_groups(of_live, ["text"], _block_links(counts, percent, words), "a long, b long").distinct())
    if not more.isEmpty() or not large.isEmpty():
        classes = connected_classes(scratch.keep(new, "links"), scratch)

    # A row belongs to the class of its node; classes are named after their smallest id.
    rows = signed.select("row", "doc", "items").join(copies, "row", "left").withColumn("node", F.coalesce("node", "row"))
    rows = scratch.keep(rows.join(classes, "node", "left").select("doc", "items", F.coalesce("comp", "node").alias("comp")), "rows")
    named = scratch.keep(rows.groupBy("comp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "named")
    out = dealt_join(rows, named, ["comp"], BROADCAST_ROWS, "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("items").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def _small_pairs(rows, percent):
    """``a < b``: pairs of different classes in one bucket that length, prefix and positional filter let pass, once each."""
    x = rows.select("gram", *[F.col(c).alias(f"{c}_x") for c in ("node", "items", "pos", "comp")])
    x = x.filter(f"pos_x <= items_x - (({2 * percent} * items_x + {99 + percent}) div {100 + percent})")  # the smaller set needs fewer first grams
    y = rows.select("gram", *[F.col(c).alias(f"{c}_y") for c in ("node", "items", "pos", "comp")])
    fits = (f"comp_x <> comp_y AND (items_x < items_y OR items_x = items_y AND node_x < node_y) AND 100 * items_x >= {percent} * items_y "
            f"AND least(pos_x, pos_y) + 1 + least(items_x - pos_x - 1, items_y - pos_y - 1) >= {_needed('items_x', 'items_y', percent)}")
    return x.join(y, "gram").filter(fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _both(pairs):
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _texts_of(source, nodes, wanted, scratch):
    """``node, text``: a text of every wanted node, found by two hashes of the text; ``n`` rows may have it."""
    keys = nodes.select("node", "text_a", "text_b", "n").join(wanted, "node", "left_semi")
    found = dealt_join(source.select("text_a", "text_b", "text"), scratch.keep(keys, "wanted"), ["text_a", "text_b"], BROADCAST_ROWS)
    return scratch.keep(found.select("node", "text").dropDuplicates(["node"]), "texts")
