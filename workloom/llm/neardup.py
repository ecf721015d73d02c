"""Near-duplicate classes: banded MinHash candidates, sequential Bayesian verification, exact check.

1. Every document becomes a set of hashed word shingles, a MinHash signature and a fingerprint of
   the set. Documents with equal sets are one node, the one with the smallest id standing for all.
2. Signatures are cut into bands. Nodes that agree on a band are in one bucket. The first round
   pairs every node of a bucket with the bucket's smallest node only, so a group of n copies gives
   n pairs per band, not n * n.
3. A pair's signatures are compared in batches. After each batch the posterior of the similarity
   (uniform prior) bounds the chance that the pair reaches the threshold; below ``miss`` the pair is
   dropped. Survivors are confirmed on their full shingle sets.
4. Linked nodes are contracted to classes. Only buckets that still hold several classes are looked
   at again: there, in blocks of bounded size, all pairs of different classes are compared by their
   signatures, so no link between different texts depends on the choice of the smallest node. The
   nodes with a surviving partner meet once more, block by block, with their texts: pairs are
   confirmed on full sets inside the task, classes are merged as links are found, and only the links
   that merge classes leave the task. A group of near copies so yields a link per member, not one per
   pair.

Nothing is capped: large buckets are cut into blocks, and every block meets every other one.
"""

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workloom.llm.classes import connected_classes
from workloom.llm.scratch import Scratch
from workloom.llm.textcore import PLAIN_WORD, lowered_slices, mix64, sequence_hashes, word_hashes

BANDS = 56
ROWS = 6
BATCH = 42
MISS = 1e-6
BLOCK = 1024
#: At most so many ids are broadcast to fetch the texts of candidates (about 16 bytes each).
BROADCAST_IDS = 1_000_000

SIGNED = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("print_a", T.LongType()),
    T.StructField("print_b", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False)),
])


def _multipliers(count):
    seeds = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    parts = (seeds >> np.uint64(32)).astype(np.uint32)
    return parts[:count] | np.uint32(1), parts[count:]


def minhash(hashes, multipliers, shifts, width=1024):
    """Minimum of each hash function over the set, in column blocks of bounded size."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), width):
        part = multipliers[:, None] * low[None, a:a + width]
        part += shifts[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def shingle_sets(column, words):
    """Per row the sorted distinct shingle hashes; shorter texts have their whole sequence as the one shingle."""
    for a, b, low, _, starts, ends, first, _ in lowered_slices(column, PLAIN_WORD):
        hashes = word_hashes(low, starts, ends)
        runs = sequence_hashes(hashes, words)
        for i in range(b - a):
            f, l = int(first[i]), int(first[i + 1])
            if l - f >= words:
                yield a + i, np.unique(runs[f:l - words + 1])
            elif l > f:
                yield a + i, sequence_hashes(hashes[f:l], l - f)
            else:
                yield a + i, np.empty(0, np.uint64)


def _sign(words, bands, rows):
    multipliers, shifts = _multipliers(bands * rows)
    salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = {f.name: [] for f in SIGNED}
            for i, found in shingle_sets(batch.column(1), words):
                out["doc"].append(ids[i])
                out["n"].append(len(found))
                if not len(found):
                    for name in ("print_a", "print_b", "sketch", "bands"):
                        out[name].append(None)
                    continue
                ranks = mix64(found)
                out["print_a"].append(int(np.bitwise_xor.reduce(ranks).view(np.int64)))
                out["print_b"].append(int(np.add.reduce(mix64(ranks), dtype=np.uint64).view(np.int64)))
                mins = minhash(found, multipliers, shifts)
                out["sketch"].append((mins & np.uint32(255)).astype(np.uint8).tobytes())
                grid = mins.reshape(bands, rows).astype(np.uint64)
                keys = salt.copy()
                for k in range(rows):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
                out["bands"].append(keys.view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "doc": pa.array(out["doc"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "print_a": pa.array(out["print_a"], pa.int64()),
                "print_b": pa.array(out["print_b"], pa.int64()), "sketch": pa.array(out["sketch"], pa.binary()),
                "bands": pa.array(out["bands"], pa.list_(pa.int64())),
            })

    return run


def least_matches(size, batch, threshold, miss):
    """For every number of compared hashes the fewest matches with which a pair lives on.

    With a uniform prior and m matches of n, P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in [*range(batch, size, batch), size]:
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _alive(left, right, p, q, plan):
    """Places in ``p`` and ``q`` (rows of the sketches of both sides) of the pairs that no batch prunes."""
    keep, matches, done = np.arange(len(p)), np.zeros(len(p), np.int32), 0
    for n, least in plan:
        matches = matches + (left[p[keep], done:n] == right[q[keep], done:n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        keep, matches, done = keep[stay], matches[stay], n
        if not len(keep):
            break
    return keep


def _matrix(column, size):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)


def _prune(size, plan):
    def run(batches):
        for batch in batches:
            rows = np.arange(batch.num_rows)
            keep = _alive(_matrix(batch.column(3), size), _matrix(batch.column(4), size), rows, rows, plan)
            yield batch.select([0, 1, 2]).take(pa.array(keep))

    return run


def _block_live(size, plan, step=256):
    """Nodes of two blocks of a bucket (or of one block with itself) that have a surviving partner of another class."""
    def run(key, left, right):
        left, right = left.to_pydict(), right.to_pydict()
        a, b = np.array(left["node"], np.int64), np.array(right["node_"], np.int64)
        ca, cb = np.array(left["comp"], np.int64), np.array(right["comp_"], np.int64)
        sa = np.frombuffer(b"".join(left["sketch"]), np.uint8).reshape(len(a), size)
        sb = np.frombuffer(b"".join(right["sketch_"]), np.uint8).reshape(len(b), size)
        live_a, live_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i in range(0, len(a), step):
            x, y = np.nonzero(ca[i:i + step, None] != cb[None, :])
            x += i
            for k in range(0, len(x), 1 << 16):
                p, q = x[k:k + (1 << 16)], y[k:k + (1 << 16)]
                keep = _alive(sa, sb, p, q, plan)
                live_a[p[keep]] = live_b[q[keep]] = True
        return pa.table({"node": pa.array(np.union1d(a[live_a], b[live_b]), pa.int64())})

    return run


def _block_links(percent, words):
    """Confirmed links between two blocks of a bucket (or within one), as few as connect what is linked.

    A node of the left block meets all of the right block at once: the common shingles of all pairs are
    counted in one pass over the right sets. Classes are merged on the way, so pairs that are
    connected already are passed over.
    """
    def run(key, left, right):
        a, b = np.array(left.column("node").to_pylist(), np.int64), np.array(right.column("node_").to_pylist(), np.int64)
        _, label = np.unique(np.array(left.column("comp").to_pylist() + right.column("comp_").to_pylist(), np.int64), return_inverse=True)
        la, lb = label[:len(a)].copy(), label[len(a):].copy()
        sets_b = [s for _, s in shingle_sets(right.column("text_"), words)]
        n = np.array([len(s) for s in sets_b])
        known, ids = np.unique(np.concatenate(sets_b), return_inverse=True) if n.sum() else (np.empty(0, np.uint64), np.empty(0, np.int64))
        begin = np.cumsum(n) - n
        found = []
        for i, own in shingle_sets(left.column("text"), words):
            near = (lb != la[i]) & (n * 100 >= percent * len(own)) & (len(own) * 100 >= percent * n) & (n > 0)
            if not near.any() or not len(own):
                continue
            mark = np.zeros(len(known) + 1, np.int64)
            at = np.searchsorted(known, own)
            at = at[at < len(known)]
            mark[at[np.isin(known[at], own, assume_unique=True)]] = 1
            some = np.flatnonzero(near)
            if len(some) * 4 < len(n):
                common = np.array([mark[ids[begin[j]:begin[j] + n[j]]].sum() for j in some])
            else:
                upto = np.concatenate([[0], np.cumsum(mark[ids])])
                common = upto[begin[some] + n[some]] - upto[begin[some]]
            for j in some[100 * common >= percent * (len(own) + n[some] - common)]:
                if lb[j] != la[i]:
                    found.append((a[i], b[j]))
                    old, new = lb[j], la[i]
                    la[la == old], lb[lb == old] = new, new
        both = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both.min(axis=1), pa.int64()), "b": pa.array(both.max(axis=1), pa.int64())})

    return run


def _linked(percent, words):
    """Exact check of pairs by their full sets: 100 * common >= percent * union, in whole numbers."""
    def run(batches):
        for batch in batches:
            keep = []
            for i, ((_, x), (_, y)) in enumerate(zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _sketched_pairs(pairs, nodes, size, plan):
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "couple", "sketch_a", "sketch_b")
    return joined.mapInArrow(_prune(size, plan), "a long, b long, couple boolean")


def _confirmed(pairs, texts, percent, words):
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_linked(percent, words), "a long, b long")


def near_duplicates(docs, doc_id="doc_id", text="text", words=5, percent=75, bands=BANDS, rows=ROWS, miss=MISS, block=BLOCK):
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Nulls and texts without words have an empty set and are alone in their class. Ids are expected to
    be unique; repeated ids give repeated rows of one class, rows with a null id are their own class
    (component null, kept). Further columns of ``docs`` are ignored. With the defaults a pair at the
    threshold shares no band with probability 2e-5 and is pruned wrongly with about 1e-5; what is
    reported as linked is always confirmed on the full sets.
    """
    spark = docs.sparkSession
    size = bands * rows
    plan = least_matches(size, BATCH, percent / 100, miss)
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    signed = scratch.keep(source.mapInArrow(_sign(words, bands, rows), SIGNED), "signed")
    with_set = signed.filter("n > 0 AND doc IS NOT NULL")

    # Equal sets are one node. Signatures of equal sets are equal, so any row of the node will do.
    members = with_set.select("doc", "print_a", "print_b")
    first = members.groupBy("print_a", "print_b").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("size"))
    prints = scratch.keep(first, "prints")
    copies = scratch.keep(members.join(prints.filter("size > 1").select("print_a", "print_b", "node"), ["print_a", "print_b"])
                          .select("doc", "node"), "copies")
    later = copies.filter("doc > node").select("doc").distinct()
    nodes = with_set.select("doc", "bands").join(later, "doc", "left_anti")

    entries = nodes.select(F.col("doc").alias("node"), F.explode("bands").alias("band"))
    buckets = scratch.keep(entries.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    shared = scratch.keep(entries.join(buckets, "band").select("band", "node", "least", "size"), "shared")
    sketches = with_set.select(F.col("doc").alias("node"), "sketch")

    # First round: every node with the least node of each of its buckets. Confirmed are the pairs of buckets of
    # two, and for every node the smallest partner that is left; the second round sees to all others.
    stars = (shared.filter("node > least").groupBy(F.col("least").alias("a"), F.col("node").alias("b"))
             .agg(F.max(F.col("size") == 2).alias("couple")))
    alive = scratch.keep(_sketched_pairs(stars, sketches, size, plan), "alive")
    best = (alive.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            .union(alive.filter("couple").select("a", "b")).distinct())
    best = scratch.keep(best, "best")
    texts = scratch.keep(_texts_of(source, best.select(F.col("a").alias("node")).union(best.select(F.col("b").alias("node")))), "texts")
    links = scratch.keep(_confirmed(best, texts, percent, words), "links")
    classes = connected_classes(links, scratch)

    # Second round: buckets that still hold several classes, block by block.
    cut = _mixed_buckets(shared, classes, block, scratch)
    if cut is not None:
        live = _block_groups(cut.join(sketches, "node"), "sketch", _block_live(size, plan), "node long").distinct()
        live = scratch.keep(live, "live")
        texts = _texts_of(source, live)
        cut = cut.join(live, "node", "left_semi").join(texts, "node")
        new = _block_groups(cut, "text", _block_links(percent, words), "a long, b long").distinct()
        classes = connected_classes(scratch.keep(links.union(new), "links"), scratch)

    # A copy belongs to the class of its node.
    own = copies.filter("doc > node").distinct()
    of_copies = own.join(classes, "node", "left").select("doc", F.coalesce("comp", "node").alias("component"))
    of_nodes = classes.select(F.col("node").alias("doc"), F.col("comp").alias("component"))
    found = of_nodes.union(of_copies).groupBy("doc").agg(F.min("component").alias("component"))
    out = signed.select("doc", "n").join(found, "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def _mixed_buckets(shared, classes, block, scratch):
    """Rows of the buckets that hold several classes, cut into blocks; None where there is no such bucket."""
    placed = (shared.filter("size > 2").join(classes, "node", "left")
              .select("band", "node", F.coalesce("comp", "node").alias("comp")))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    rows = placed.join(mixed.select("band", "size"), "band").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = scratch.keep(rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("size"), "mixed")
    return None if rows.isEmpty() else rows


def _block_groups(cut, payload, run, schema):
    """Every pair of blocks i <= j of every bucket once: the left side comes as (own, j), the right side as (i, own)."""
    left = cut.select("band", "node", "comp", payload, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = cut.select(*[F.col(c).alias(f"{c}_") for c in ("band", "node", "comp", payload)], F.explode(F.sequence(F.lit(0), "own")).alias("i_"), F.col("own").alias("j_"))
    return left.groupBy("band", "i", "j").cogroup(right.groupBy("band_", "i_", "j_")).applyInArrow(run, schema)


def _texts_of(source, nodes):
    """Texts of the given ids, one row each; the ids are broadcast only while they are few."""
    nodes = nodes.distinct()
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    found = source.withColumnRenamed("doc", "node").join(nodes, "node", "left_semi")
    return found.dropDuplicates(["node"])
