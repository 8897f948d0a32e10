"""Exact top-k by inner product over a pivot-distance index.

Vectors are whole numbers.  With one more coordinate, sqrt(R2 - |v|2), where R2
is the largest squared norm, inner products order as distances do, so a metric
index serves.  Every vector is keyed by its nearest pivot and its distance from
it; a cell is a pivot and an annulus of distances, and its rows are kept sorted
by distance.  The triangle inequality bounds a query's distance to all of an
annulus from below, so its inner product from above.

Queries first expand the nearest annuli until they have enough candidates; the
k-th score so found stops all annuli that cannot beat it.  The rest are searched
in tiles of at most ``BLOCK`` rows by ``BLOCK`` queries, annulus by annulus,
with the bound tightened on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut

#: Rows and queries in a tile; pivots; annuli a pivot at most; rows that pivots are fitted on.
BLOCK, PIVOTS, ANNULI, SAMPLE = 4096, 32, 12, 4096


def _matrix(column, dim: int) -> np.ndarray:
    """Packed vectors as rows, missing trailing components 0."""
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column):
        v = np.frombuffer(x.as_py(), np.float64)
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, r2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(r2 - (x * x).sum(1, keepdims=True), 0))], 1)


def _fit(x: np.ndarray, rng) -> np.ndarray:
    """Pivots: a few rounds of k-means from random rows."""
    p = np.unique(x[rng.permutation(len(x))[:PIVOTS]], axis=0)
    for _ in range(5):
        near = _far2(x, p).argmin(1)
        p = np.stack([x[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def _far2(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each row; both arrays are rows by candidates."""
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, 1)[:, -k]
        out_s, out_i = np.empty((len(scores), k)), np.empty((len(scores), k), np.int64)
        for r in range(len(scores)):
            c = np.flatnonzero(scores[r] >= edge[r])
            c = c[np.lexsort((ids[r, c], -scores[r, c]))[:k]]
            out_s[r], out_i[r] = scores[r, c], ids[r, c]
        return out_s, out_i
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _search(q, q_ids, floor, dq, x, x_ids, dist, bound_const, k, step=256):
    """Best k candidates above ``floor`` for each query of a tile, expanding annuli of sorted distances."""
    order = np.argsort(dist, kind="stable")
    x, x_ids, dist = x[order], x_ids[order], dist[order]
    scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    floor = floor.copy()
    chunks = [(a, min(a + step, len(x))) for a in range(0, len(x), step)]
    middle = np.median(dq)
    for a, b in sorted(chunks, key=lambda c: max(dist[c[0]] - middle, middle - dist[c[1] - 1], 0)):
        low = np.maximum(0, np.maximum(dq - dist[b - 1], dist[a] - dq))
        alive = np.flatnonzero((bound_const - low * low) / 2 + 1e-3 + 1e-9 * np.abs(bound_const) >= floor)
        if not len(alive):
            continue
        s = q[alive] @ x[a:b].T
        s[x_ids[a:b] == q_ids[alive][:, None]] = -np.inf
        s = np.concatenate([scores[alive], s], 1)
        i = np.concatenate([ids[alive], np.broadcast_to(x_ids[a:b], (len(alive), b - a))], 1)
        scores[alive], ids[alive] = _best(s, i, k)
        floor[alive] = np.maximum(floor[alive], scores[alive][:, -1])
    return scores, ids


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 31) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products for every row of ``queries``.

    Both: vec_id (long) and vector (array<double>, whole numbers below 2**20 or
    so, for which sums are exact).  Returns query_id, rank from 1, vec_id, score;
    ties go to the smaller vec_id; fewer rows if there are fewer candidates.  A
    query's own vec_id isn't a candidate (nor are rows that repeat it; a repeated
    query row counts once).  Candidate rows that repeat a vec_id are candidates
    each and take a rank each.  Rows with a null vec_id, a null vector, or null
    or non-finite components take no part.  Shorter vectors are padded with 0, so
    an empty vector scores 0.  Other columns are not read; empty tables give no row.

    The driver gets the largest norm and length, a sample of at most 4,096 rows
    for the pivots and at most 32 x 13 cells' bounds, whatever the input.  Cells
    are split into blocks of rows by hash, and queries into blocks, so no task
    holds more than a tile.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    fine = lambda df: df.where("vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").select("vec_id", "vector")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    v = fine(vectors).withColumn("n2", norm2)
    q = fine(queries).dropDuplicates(["vec_id"])
    r2, dim, q_dim, n_q = v.agg(F.max("n2"), F.max(F.size("vector"))).crossJoin(q.agg(F.max(F.size("vector")), F.count(F.lit(1)))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if r2 is None or not n_q:
        return spark.createDataFrame([], schema)
    dim = max(dim, q_dim, 1)
    q_blocks = -(-n_q // BLOCK)

    def unpack(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    sample = v.select("vector", F.xxhash64(F.lit(seed), "vec_id").alias("h")).orderBy("h").limit(SAMPLE).collect()
    pivots = _fit(_lift(unpack([r.vector for r in sample]), r2), np.random.default_rng(seed))
    width = max(2 * np.sqrt(r2) / ANNULI, 1e-9)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column(1).to_pylist())
            d2 = _far2(_lift(x, r2), pivots)
            p = d2.argmin(1)
            dist = np.sqrt(d2[np.arange(len(x)), p])
            ring = np.minimum((dist / width).astype(np.int64), ANNULI)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(p * (ANNULI + 1) + ring, pa.int64()), pa.array(dist)], ["vec_id", "packed", "cell", "dist"])

    idx = cut(v.select("vec_id", "vector").mapInArrow(index, "vec_id long, packed binary, cell long, dist double"))
    cells = np.array([tuple(r) for r in idx.groupBy("cell").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).collect()])
    cells = cells[np.argsort(cells[:, 0])]
    cell, inner, outer, count = cells[:, 0].astype(np.int64), cells[:, 1], cells[:, 2], cells[:, 3].astype(np.int64)
    n_blocks = -(-count // BLOCK)
    blocks_of = F.element_at(F.create_map(*[F.lit(int(x)) for c, b in zip(cell, n_blocks, strict=True) for x in (c, b)]), F.col("cell"))
    idx = idx.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks_of).cast("int"))

    def bounds(x: np.ndarray):
        """Of each query: distance to its pivots, the constant of its bound, and the bound of each cell."""
        dq = np.sqrt(_far2(np.concatenate([x, np.zeros((len(x), 1))], 1), pivots))
        own = dq[:, cell // (ANNULI + 1)]
        low = np.maximum(0, np.maximum(own - outer, inner - own))
        const = (x * x).sum(1) + r2
        return dq, const, (const[:, None] - low * low) / 2 + 1e-3 + 1e-9 * const[:, None]

    ask_schema = "cell long, block int, q_block int, query_id long, q_packed binary, floor double"

    def ask(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unpack(batch.column(1).to_pylist())
                floor = np.full(len(x), -np.inf) if first else np.array(batch.column(2).to_pylist(), float)
                _, _, most = bounds(x)
                if first:
                    # the nearest annuli, until they hold enough rows; one block of each
                    order = np.argsort(-most, 1)
                    before = np.cumsum(np.minimum(count[order], BLOCK), 1) - np.minimum(count[order], BLOCK)
                    r, c = np.nonzero(before < 8 * (k + 1))
                    c, times = order[r, c], np.ones(len(r), np.int64)
                else:
                    r, c = np.nonzero(most >= floor[:, None])
                    times = n_blocks[c]
                block = np.concatenate([np.arange(t) for t in times]) if len(times) else np.empty(0, int)
                r, c = np.repeat(r, times), np.repeat(c, times)
                ids, packed = batch.column(0).to_pylist(), [y.tobytes() for y in x]
                for a in range(0, len(r), 4096):
                    rr, cc = r[a : a + 4096], c[a : a + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[cc]), pa.array(block[a : a + 4096].astype(np.int32)), pa.array([hash(ids[i]) % q_blocks for i in rr], pa.int32()), pa.array([ids[i] for i in rr], pa.int64()), pa.array([packed[i] for i in rr], pa.binary()), pa.array(floor[rr])],
                        ["cell", "block", "q_block", "query_id", "q_packed", "floor"],
                    )

        return run

    def tile(left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q_ids, q_ = np.array(left.column("query_id")), _matrix(left.column("q_packed"), dim)
        x_ids, x = np.array(right.column("vec_id")), _matrix(right.column("packed"), dim)
        dq, const, _ = bounds(q_)
        dq = dq[:, left.column("cell")[0].as_py() // (ANNULI + 1)]
        floor = np.array(left.column("floor"))
        s, i = _search(q_, q_ids, floor, dq, x, x_ids, np.array(right.column("dist")), const, k)
        r, c = np.nonzero(np.isfinite(s) & (s >= floor[:, None]))
        return pa.table({"query_id": pa.array(q_ids[r]), "vec_id": pa.array(i[r, c]), "score": pa.array(s[r, c].astype(np.int64))})

    def search(asked: DataFrame) -> DataFrame:
        keys = ["cell", "block", "q_block"]
        # a block of the index goes where a block of queries asked for it, and nowhere else
        wanted = asked.select(*keys).distinct().select(F.col("cell").alias("w_cell"), F.col("block").alias("w_block"), F.col("q_block").alias("w_q_block"))
        rows = idx.join(wanted, (F.col("cell") == F.col("w_cell")) & (F.col("block") == F.col("w_block"))).select(*idx.columns, F.col("w_q_block").alias("q_block"))
        return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score long")

    q = q.select("vec_id", "vector")
    found = search(q.mapInArrow(ask(True), ask_schema))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    floors = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "score")
    asked = q.join(floors, q.vec_id == F.col("query_id"), "left").select("vec_id", "vector", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("floor"))
    found = search(asked.mapInArrow(ask(False), ask_schema))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
