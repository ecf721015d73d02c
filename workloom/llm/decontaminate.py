"""Benchmark decontamination: Wu-Manber search of many word windows in all documents.

The alphabet is words. Every window of ``width`` consecutive words of a benchmark item is a pattern;
an item of fewer words is one shorter pattern. Patterns of one length share the classic tables:

* the shift table tells, for a block of two words, how far the search may jump: blocks that occur in
  no pattern jump ``length - 1`` words at once;
* where the shift is zero, the block is the suffix of a pattern and selects a bucket of patterns;
* the patterns of the bucket are compared with the text word by word, first hashes, then bytes.

Documents are cut into lanes of neighbouring end positions. All lanes of a slice jump at the same
time, so one step is a few array operations. No row leaves its task: there is no shuffle.

The patterns travel to the tasks by broadcast in parts of bounded size (``PART_CHARS`` characters of
benchmark text); a larger benchmark takes several passes, joined through tables of the shared folder.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch
from workloom.llm.textcore import ALNUM_WORD, lowered_slices, mix64, word_hashes

WIDTH = 13
LANE = 256
TABLE_BITS = 18
#: Characters of benchmark text per broadcast part (about 20 times as many bytes of tables).
PART_CHARS = 4_000_000

FOUND = "struct<n_words:bigint,spans:array<struct<first:int,last:int>>,items:array<string>>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _block(hashes, at, length):
    """Hash of the block of words that ends at ``at``: two words, or one where patterns have but one."""
    if length == 1:
        return mix64(hashes[at])
    return mix64(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + mix64(hashes[at - 1]))


class Patterns:
    """The tables of all patterns of one length."""

    def __init__(self, length, sequences, owners):
        self.length = length
        self.words = sequences  # hashes, one row per pattern
        self.owners = owners  # [(item id, bytes of the pattern)]
        block = 1 if length == 1 else 2
        self.jump = length - block + 1
        self.shift = np.full(1 << TABLE_BITS, self.jump, np.uint8 if length < 256 else np.uint16)
        for end in range(block - 1, length):
            keys = _block(sequences.T, np.full(1, end), length)[0] >> np.uint64(64 - TABLE_BITS)
            np.minimum.at(self.shift, keys, length - 1 - end)
        suffix = _block(sequences.T, np.full(1, length - 1), length)[0]
        order = np.argsort(suffix, kind="stable")
        self.words, self.suffix = sequences[order], suffix[order]
        self.owners = [owners[i] for i in order]

    def occurrences(self, hashes, first):
        """(end position, pattern) of all hash-equal occurrences. ``first``: word bounds of the rows."""
        lows, highs = first[:-1] + self.length - 1, first[1:]
        rows = np.flatnonzero(highs > lows)
        if not len(rows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lows, highs = lows[rows], highs[rows]
        lanes = -(-(highs - lows) // LANE)
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(lows, lanes) + lane * LANE
        stop = np.minimum(at + LANE, np.repeat(highs, lanes))
        stops = []
        while len(at):
            shift = self.shift[_block(hashes, at, self.length) >> np.uint64(64 - TABLE_BITS)]
            zero = shift == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.where(zero, 1, shift)
            on = at < stop
            at, stop = at[on], stop[on]
        if not stops:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.concatenate(stops)
        keys = _block(hashes, ends, self.length)
        left, right = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        number = right - left
        ends = np.repeat(ends, number)
        which = np.arange(len(ends)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(left, number)
        for back in range(self.length):
            same = hashes[ends - back] == self.words[which, self.length - 1 - back]
            ends, which = ends[same], which[same]
        return ends, which


def _windows(items, width):
    """The distinct patterns by length: {length: {word tuple as bytes: set of item ids}}."""
    found = {}
    column = pa.array([text for _, text in items], pa.string())
    for a, b, low, _, starts, ends, first, _ in lowered_slices(column, ALNUM_WORD):
        raw = low.tobytes()
        for i in range(b - a):
            f, l = int(first[i]), int(first[i + 1])
            tokens = [raw[starts[k]:ends[k]] for k in range(f, l)]
            length = min(width, len(tokens))
            for k in range(len(tokens) - length + 1 if length else 0):
                found.setdefault(length, {}).setdefault(tuple(tokens[k:k + length]), set()).add(items[a + i][0])
    return found


def compile_patterns(items, width=WIDTH):
    """Tables for a list of (item id, text)."""
    tables = []
    for length, patterns in sorted(_windows(items, width).items()):
        flat = [token for tokens in patterns for token in tokens]
        ends = np.cumsum([len(t) for t in flat])
        data = np.frombuffer(b"".join(flat), np.uint8)
        hashes = word_hashes(data, ends - np.array([len(t) for t in flat]), ends).reshape(len(patterns), length)
        tables.append(Patterns(length, hashes, [(sorted(i for i in ids if i is not None), b" ".join(tokens)) for tokens, ids in patterns.items()]))
    return tables


def search(column, tables):
    """Per row of an Arrow string column: number of words, merged spans of hit words, items found."""
    out = []
    for a, b, low, _, starts, ends, first, _ in lowered_slices(column, ALNUM_WORD):
        hashes = word_hashes(low, starts, ends)
        cover = np.zeros(len(starts) + 1, np.int32)
        items = {}
        raw = None
        for table in tables:
            at, which = table.occurrences(hashes, first)
            if not len(at):
                continue
            raw = raw or low.tobytes()
            rows = np.searchsorted(first, at, "right") - 1
            for end, pattern, row in zip(at.tolist(), which.tolist(), rows.tolist(), strict=True):
                ids, wanted = table.owners[pattern]
                begin = end - table.length + 1
                if b" ".join([raw[starts[k]:ends[k]] for k in range(begin, end + 1)]) == wanted:
                    cover[begin] += 1
                    cover[end + 1] -= 1
                    items.setdefault(row, set()).update(ids)
        hit = np.cumsum(cover[:-1]) > 0
        for i in range(b - a):
            f, l = int(first[i]), int(first[i + 1])
            spans = []
            if i in items:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[f:l], [False]]).astype(np.int8)))
                spans = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)]
            out.append({"n_words": l - f, "spans": spans, "items": sorted(items.get(i, ()))})
    return out


def _merged(old, new):
    """Findings of one row from two parts of the benchmark."""
    spans = []
    for s in sorted(old["spans"] + new["spans"], key=lambda s: s["first"]):
        if spans and s["first"] <= spans[-1]["last"] + 1:
            spans[-1]["last"] = max(spans[-1]["last"], s["last"])
        else:
            spans.append(dict(s))
    return {"n_words": new["n_words"], "spans": spans, "items": sorted({*old["items"], *new["items"]})}


def _scan(tables):
    @F.arrow_udf(FOUND)
    def scan(column: pa.Array) -> pa.Array:
        return pa.array(search(column, tables.value), _FOUND_ARROW)

    return scan.asNondeterministic()


def _scan_on(tables):
    @F.arrow_udf(FOUND)
    def scan(column: pa.Array, before: pa.Array) -> pa.Array:
        both = zip(before.to_pylist(), search(column, tables.value), strict=True)
        return pa.array([_merged(x, y) for x, y in both], _FOUND_ARROW)

    return scan.asNondeterministic()


def find_benchmark_text(docs, benchmark, text="text", item_id="item_id", item_text="text", width=WIDTH, into="found", part_chars=PART_CHARS):
    """``docs`` with the column ``into`` (a struct): ``n_words``, ``spans`` (merged word positions, from
    0, both ends included) and ``items`` (ids as strings, sorted).

    Null and empty texts have no words. Items without words match nothing; an item whose id is null
    marks words but is not listed. Repeated items count once. A column of ``docs`` that is called
    like ``into`` is replaced; all others pass unchanged, repeated rows each get their own result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("body")).filter("body IS NOT NULL")
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, -(-total // part_chars))
    scratch = Scratch(spark, "decontaminate") if parts > 1 else None
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == part) if parts > 1 else items
        tables = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in some.collect()], width))

        body = F.col(text).cast("string")
        docs = docs.withColumn(into, _scan_on(tables)(body, F.col(into)) if part else _scan(tables)(body))
        if scratch:
            docs = scratch.keep(docs, "part")
    return docs


def contamination(found, share=20):
    """Columns of the verdict from the struct ``found``: hit words, items and the flag n_hit > 0 and share * n_hit >= n_words."""
    n_hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return {
        "n_words": found["n_words"], "n_hit": n_hit, "n_items": F.size(found["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(found["items"], ","), 256), "contaminated": (n_hit > 0) & (share * n_hit >= found["n_words"]),
    }
