"""Exact top-k inner product search as a Voronoi kNN join.

1. Pivots cut the space into cells; every vector belongs to the cell of its nearest pivot.
2. A cell is summarised by its size, its radius and its k + 1 smallest distances to the pivot. For a
   query q and a member x of the cell of pivot p, q.x lies within |q| d(x, p) of q.p, so the summaries
   alone give every query a score that its k-th neighbour cannot fall below, and every cell a score
   that none of its members can exceed.
3. A query is sent to the cells whose bound reaches its own, and to no other. Queries are grouped in
   chunks by the cell they lie in: near cells share a chunk, a cell of many queries is several chunks.
   Cells are cut into blocks; a large cell or a vector that repeats is many blocks. Data rows are
   replicated only to the chunks of queries that need their cell.
4. Every (block, chunk) is solved by one matrix product; its k best per query are merged per query.

Bounds only skip work: no cell that could hold a neighbour is skipped, so the result is exact.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from workloom.llm.scratch import Scratch

#: Rows of a cell that are solved together, at least and at most; queries of a chunk.
BLOCK_ROWS = (512, 32768)
CHUNK_QUERIES = 4096
PIVOTS = (8, 1024)
#: Products below this are exact in doubles.
EXACT = float(1 << 53)


def usable(vector):
    """No null vector, no empty one, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def whole_numbers(vector, scale=1024.0):
    """floor(scale * x) of every component, as doubles that hold whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))


def _grid(column, width):
    """Rows of an Arrow list column as a matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(column.flatten(), np.float64)
    return out


def _assign(pivots):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _grid(part.column(1), pivots.shape[1])
                square = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
                cell = square.argmin(axis=1)
                distance = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(distance)], ["id", "vector", "cell", "distance"])

    return run


def _chunks(pivots, asked, most):
    """``(first chunk, number of chunks)`` per cell, from the number of queries that lie in every cell.

    Cells are halved where their pivots spread most until a group has ``most`` queries or is one cell; queries of such a
    cell are dealt to as many chunks as they need. There are at most queries / ``most`` chunks and one per cell.
    """
    first, number, groups, made = np.zeros(len(pivots), int), np.ones(len(pivots), int), [np.flatnonzero(asked)], 0
    while groups:
        group = groups.pop()
        total = asked[group].sum()
        if total <= most or len(group) == 1:
            first[group], number[group] = made, max(1, -(-total // most))
            made += max(1, -(-total // most))
            continue
        group = group[np.argsort(pivots[group, pivots[group].var(axis=0).argmax()], kind="stable")]
        half = np.searchsorted(asked[group].cumsum(), total / 2) + 1
        cut = min(max(half, 1), len(group) - 1)
        groups += [group[cut:], group[:cut]]
    return first, number


def _needed(pivots, radius, nearest, k):
    """Cells that a query has to visit, with the cell it lies in; ``nearest``: (distances, their cells, their ids) over all cells."""
    squares = (pivots * pivots).sum(axis=1)[None, :]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                q = _grid(part.column(1), pivots.shape[1])
                norm = np.sqrt((q * q).sum(axis=1))[:, None]
                dots = q @ pivots.T
                slack = 1e-9 * (1 + np.abs(dots).max(axis=1, initial=0) + norm[:, 0] * (1 + radius.max()))[:, None]
                low = dots[:, nearest[1]] - norm * nearest[0][None, :]
                # Rows of the query's own id, however many, are no neighbours and bound nothing.
                low[nearest[2][None, :] == np.array(part.column(0).to_pylist(), np.int64)[:, None]] = -np.inf
                floor = np.partition(low, -k, axis=1)[:, -k][:, None] if low.shape[1] >= k else np.full((len(q), 1), -np.inf)
                row, cell = np.nonzero((dots + norm * radius[None, :] + slack >= floor) & (radius >= 0)[None, :])
                own = (squares - 2 * dots).argmin(axis=1)[row]
                new = np.diff(row, prepend=-1) > 0
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(own, pa.int32()), pa.array(new)],
                                                 ["query", "vector", "cell", "own", "new"])

    return run


def _solve(k, width):
    def run(key, data, queries):
        ids, x = np.array(data.column("id").to_pylist(), np.int64), _grid(data.column("vector"), width)
        asked, q = np.array(queries.column("query").to_pylist(), np.int64), _grid(queries.column("q_vector"), width)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        exact = len(x) and len(q) and np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1).max()) < EXACT
        out = [[], [], []]
        for a in range(0, len(asked), 256):
            if exact:
                scores = (q[a:a + 256] @ x.T).astype(np.int64)
            else:
                scores = (q[a:a + 256].astype(np.int64)[:, None, :] * x.astype(np.int64)[None, :, :]).sum(axis=2) if len(x) else np.zeros((1, 0), np.int64)
            for i, row in enumerate(scores):
                own = asked[a + i]
                row[np.searchsorted(ids, own):np.searchsorted(ids, own, "right")] = np.iinfo(np.int64).min
                some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                some = some[ids[some] != own]
                best = some[np.argsort(-row[some], kind="stable")[:k]]  # ids ascend, so ties go to the smaller one
                out[0] += [own] * len(best)
                out[1].append(ids[best])
                out[2].append(row[best])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": join(out[1]), "score": join(out[2])})

    return run


def top_k_inner_products(vectors, is_query, k=10, vec_id="vec_id", vector="embedding", scale=1024.0):
    """``query_id, rank, vec_id, score``: for every query row its ``k`` largest integer inner products.

    ``is_query`` is a condition on ``vectors``. A query is no candidate of its own; ties go to the
    smaller id. Null vectors, vectors with null or non-finite components and rows without an id take no
    part. Vectors of different lengths meet in their common components. Rows that repeat an id are
    candidates each of their own, a repeated query id is asked once. Scores have to fit in 64 bits.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    good = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    good = good.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    size = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.count(F.when(F.col("ask"), 1)).alias("asked")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size.n or not size.asked:
        return empty
    count = min(PIVOTS[1], max(PIVOTS[0], math.isqrt(size.n) // 3))
    # Candidates for pivots: vectors of low hash, about eight times as many as needed; equal vectors are one.
    h = F.xxhash64("vector")
    part = good.select("vector", h.alias("h")).filter(F.pmod("h", F.lit(1_000_000)) <= 8_000_000 * count // size.n)
    rows = part.distinct().orderBy("h").limit(count).collect() or good.select("vector").limit(1).collect()
    pivots = np.zeros((len(rows), size.width))
    for i, r in enumerate(rows):
        pivots[i, :len(r.vector)] = r.vector
    placed = scratch.keep(good.select("id", "vector").mapInArrow(_assign(pivots), "id long, vector array<double>, cell int, distance double"), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
    radius = np.full(len(pivots), -1.0)
    for c in cells:
        radius[c.cell] = c.radius
    close = Window.partitionBy("cell").orderBy("distance")
    nearest = placed.select("cell", "distance", "id").withColumn("r", F.row_number().over(close)).filter(F.col("r") <= k + 1).collect()  # pivots x (k + 1) rows
    nearest = (np.array([r.distance for r in nearest]) * (1 + 1e-12), np.array([r.cell for r in nearest]), np.array([r.id for r in nearest], np.int64))

    block = min(BLOCK_ROWS[1], max(BLOCK_ROWS[0], size.n // (2 * len(pivots))))
    asked = good.filter("ask").select("id", "vector").dropDuplicates(["id"])
    needs = asked.mapInArrow(_needed(pivots, radius, nearest, k), "query long, vector array<double>, cell int, own int, new boolean")
    needs = scratch.keep(needs, "needs")
    lie = np.zeros(len(pivots), int)
    for r in needs.filter("new").groupBy("own").count().collect():  # one row per pivot
        lie[r.own] = r["count"]
    first, number = _chunks(pivots, lie, CHUNK_QUERIES)
    of = lambda values: F.create_map(*[F.lit(int(x)) for c in np.flatnonzero(lie) for x in (c, values[c])])[F.col("own")]
    needs = needs.withColumn("chunk", (of(first) + F.pmod(F.xxhash64("query"), of(number))).cast("int")).drop("own", "new")
    blocks = F.create_map(*[F.lit(x) for c in cells for x in (c.cell, -(-c.n // block))])
    queries = (needs.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
               .select(F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("chunk").alias("q_chunk"), "query", F.col("vector").alias("q_vector")))
    wanted = needs.select("cell", "chunk").distinct()  # at most pivots x chunks rows
    data = (placed.withColumn("block", F.pmod(F.xxhash64("id", "distance"), blocks[F.col("cell")]).cast("int"))
            .join(wanted, "cell").select("cell", "block", "chunk", "id", "vector"))
    found = (data.groupBy("cell", "block", "chunk").cogroup(queries.groupBy("q_cell", "q_block", "q_chunk"))
             .applyInArrow(_solve(k, size.width), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
