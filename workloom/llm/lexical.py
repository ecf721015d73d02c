"""Ranked lexical search for a set of items: branch and bound on FP-trees of the documents.

1. Only terms of the items count. One pass turns every document into its restricted vector: term
   numbers, occurrences (tf) and its number of terms. Document frequencies, N and L are sums over that
   stored table.
2. A task sorts the vectors of its documents with terms in order of falling document frequency: equal
   beginnings become neighbours, which is a frequent-pattern tree with shared paths. A node is a run of
   documents below one path; chains of single children are one node, siblings of few documents
   share a leaf.
3. Every node keeps, for its subtree, the largest tf of every term and the smallest length weight m. As
   a score grows with tf and falls with m, scoring an item on these values bounds all documents below.
4. Per item the tree is searched depth first, best child first. A subtree whose bound is below the
   k-th best score that the task has found is passed over; leaves that are left are scored exactly.

A task gives at most k documents per item; these are merged by windows, first per salt, then per item.
Nothing is approximate: bounds hold in the same integer arithmetic as the scores.
"""

import heapq
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch
from workloom.llm.textcore import ALNUM_WORD, lowered_slices, word_hashes

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of item and term that travel to the tasks at once (about 100 bytes each); more items take several passes.
PART_TERMS = 20_000
#: Cells (documents x terms) of the table of one tree, 4 bytes each, and documents of a leaf.
CELLS, LEAF = 4_000_000, 16
#: Parts in which the candidates of an item are ranked before they meet.
SALTS = 64

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


# --- restricted vectors ---------------------------------------------------------------------------

def term_hashes(terms):
    """64-bit hashes of a list of terms, as documents have them."""
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return word_hashes(data, ends - np.array([len(t) for t in raw], np.int64), ends)


def _vectors(known):
    """Documents with at least one term: id, number of terms, and the item terms in them by number."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, low, _, starts, ends, first, _ in lowered_slices(batch.column(1), ALNUM_WORD):
                n = first[1:] - first[:-1]
                hashes, vocabulary = word_hashes(low, starts, ends), known.value
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes
                rows = np.repeat(np.arange(b - a), n)[hit]
                keys, tfs = np.unique(rows * len(vocabulary) + at[hit], return_counts=True)
                bounds = np.searchsorted(keys, np.arange(b - a + 1) * len(vocabulary)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array((keys % len(vocabulary)).astype(np.int32)))
                counts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(tfs.astype(np.int32)))
                rows = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), terms, counts], names=["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return run


# --- the tree -------------------------------------------------------------------------------------

class Tree:
    """FP-tree of documents that come in the order of their vectors.

    ``paths``: per document the places of its terms in the frequency order, ascending; ``tfs`` beside them.
    """

    def __init__(self, paths, tfs, m, width, leaf=LEAF):
        self.m = m
        self.table = np.zeros((len(paths), width), np.int32)
        rows = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
        self.table[rows, np.concatenate(paths)] = np.concatenate(tfs)
        self.start, self.end, self.children = [0], [len(paths)], [[]]
        grown = [(0, 0)]
        while grown:
            node, depth = grown.pop()
            for low, high, deeper in self._split(paths, self.start[node], self.end[node], depth, leaf):
                self.children[node].append(len(self.start))
                if deeper is not None:
                    grown.append((len(self.start), deeper))
                self.start.append(low)
                self.end.append(high)
                self.children.append([])
        # Children come after their parents: summaries are filled from the end.
        self.most = np.empty((len(self.start), width), np.int32)
        self.least = np.empty(len(self.start), np.int64)
        for node in range(len(self.start) - 1, -1, -1):
            below = self.children[node]
            span = slice(self.start[node], self.end[node])
            self.most[node] = self.most[below].max(axis=0) if below else self.table[span].max(axis=0)
            self.least[node] = self.least[below].min() if below else m[span].min()

    @staticmethod
    def _split(paths, low, high, depth, leaf):
        """Child runs (first, end, depth to go on from; None for a leaf) of documents that share ``depth`` terms."""
        if high - low <= leaf:
            return
        shortest = min(len(paths[low]), len(paths[high - 1]))
        while depth < shortest and paths[low][depth] == paths[high - 1][depth]:
            depth += 1
        following = np.array([p[depth] if len(p) > depth else -1 for p in paths[low:high]])
        bounds = [*(np.flatnonzero(np.diff(following)) + low + 1), high]
        begin, done = low, low  # documents from ``begin`` to ``done`` are siblings that share a leaf
        for bound in map(int, bounds):
            if bound - done > leaf and len(bounds) > 1:
                if done > begin:
                    yield begin, done, None
                yield done, bound, depth + 1
                begin = bound
            elif bound - begin > leaf:
                if done > begin:
                    yield begin, done, None
                begin = done
            done = bound
        if done > begin:
            yield begin, done, None

    def search(self, terms, weights, best, k, ids):
        """Brings the k best of ``best`` (a heap of (score, -order, id)) up to date for one item."""
        stack = [0]
        while stack:
            node = stack.pop()
            below = self.children[node]
            if below:
                bounds = scores(self.most[below][:, terms], self.least[below], weights)
                least = best[0][0] if len(best) == k else 1
                stack += [below[i] for i in np.argsort(bounds, kind="stable") if bounds[i] >= least]
                continue
            span = slice(self.start[node], self.end[node])
            least = best[0][0] if len(best) == k else 1
            if scores(self.most[node, terms][None], self.least[node:node + 1], weights)[0] < least:
                continue
            found = scores(self.table[span][:, terms], self.m[span], weights)
            for i in np.flatnonzero(found >= least).tolist():
                order, doc = ids[span.start + i]
                entry = (int(found[i]), -order, doc)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry[:2] > best[0][:2]:
                    heapq.heapreplace(best, entry)


def scores(tf, m, weights):
    """Sum over the terms of w * (10^9 tf div (1000 tf + 20 m)); rows are documents or bounds."""
    tf = tf.astype(np.int64)
    return (weights * (1_000_000_000 * tf // (1000 * tf + 20 * m[:, None]))).sum(axis=1)


def _ranked(plan, k, cells, leaf):
    """Best k documents of a task for every item."""
    def run(batches):
        place, weights, items = plan.value
        best = [[] for _ in items]
        for batch in batches:
            ids, m = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            terms = place[lists.values.to_numpy()]
            tfs = batch.column(3).values.to_numpy()
            paths, counts = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                order = np.argsort(terms[a:b])
                paths.append(terms[a:b][order])
                counts.append(tfs[a:b][order])
            order = sorted((i for i in range(len(paths)) if len(paths[i])), key=lambda i: paths[i].astype(">u4").tobytes())
            size = max(2 * leaf, cells // len(place))
            for a in range(0, len(order), size):
                some = order[a:a + size]
                tree = Tree([paths[i] for i in some], [counts[i] for i in some], m[some], len(place), leaf)
                keys = [(ids[i] if ids[i] is not None else 1 << 63, ids[i]) for i in some]
                for item, (own, heap) in enumerate(zip(items, best, strict=True)):
                    tree.search(own, weights[own], heap, k, keys)
        rows = [(item, doc, score) for item, heap in enumerate(best) for score, _, doc in heap]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(next(columns), pa.int32()), pa.array(next(columns), pa.int64()), pa.array(next(columns), pa.int64())],
                                             names=["item", "doc_id", "score"])

    return run


# --- the search -----------------------------------------------------------------------------------

def _part(spark, docs, scratch, pairs, k, cells, leaf):
    """``item, doc_id, score`` of the items of one part: candidates of all tasks, k per item and task. pairs: (item number, term)."""
    terms = sorted({t for _, t in pairs})
    hashes = term_hashes(terms)
    order = np.argsort(hashes)
    number = {terms[i]: n for n, i in enumerate(order)}
    if len(np.unique(hashes)) < len(terms):
        raise ValueError("two terms of the items have one hash")
    known = spark.sparkContext.broadcast(hashes[order])
    vectors = scratch.keep(docs.mapInArrow(_vectors(known), VECTORS), "vectors")
    known.destroy()
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(len(terms), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r.term] = r.df
    by_df = np.lexsort((np.arange(len(terms)), -df))
    place = np.empty(len(terms), np.int64)
    place[by_df] = np.arange(len(terms))
    weights = np.array([floor(1000 * log((2 * size.n + 2) / (2 * int(df[t]) + 1))) for t in by_df], np.int64)
    items = [[] for _ in range(max(i for i, _ in pairs) + 1)]
    for item, term in pairs:
        items[item].append(place[number[term]])
    plan = spark.sparkContext.broadcast((place, weights, [np.sort(np.array(x, np.int64)) for x in items]))
    m = F.lit(50) + F.expr(f"CAST(n AS DECIMAL(18, 0)) * CAST({50 * size.n} AS DECIMAL(20, 0)) div {max(size.l, 1)}")
    found = scratch.keep(vectors.select("doc_id", m.cast("long").alias("m"), "terms", "tfs").mapInArrow(_ranked(plan, k, cells, leaf), FOUND), "found")
    plan.destroy()
    return found


def search_items(docs, items, k=50, doc_id="doc_id", text="text", item_id="item_id", item_text="text", part_terms=PART_TERMS, cells=CELLS, leaf=LEAF):
    """``item_id, rank, doc_id, score``: the k best documents of every item with a score above 0, ties to the smaller id.

    Null and empty texts have no terms. Rows of ``items`` that share an id (null is one too) are one item of
    all their terms, so repeated rows count once; items without terms have no rows. Every row of ``docs`` is
    a document of its own, also where ids repeat; rows without an id rank after equal scores with one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lowered = F.translate(F.col(item_text).cast("string"), UPPER, LOWER)
    pairs = items.select(F.col(item_id).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    parts = max(1, -(-pairs.count() // part_terms))
    out = None
    for part in range(parts):
        some = [tuple(r) for r in pairs.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)) == part).collect()]
        if not some:
            continue
        numbers = {i: n for n, i in enumerate(dict.fromkeys(i for i, _ in some))}
        found = _part(spark, source, scratch, [(numbers[i], t) for i, t in some], k, cells, leaf)
        names = spark.createDataFrame([(n, i) for i, n in numbers.items()], "item int, item_id " + pairs.schema["id"].dataType.simpleString())
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
        top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.union(top)
    if out is None:
        kind = pairs.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
