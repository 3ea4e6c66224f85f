"""Exact top-k search by inner product: a Voronoi join of queries and vectors.

Vectors are turned into integers, floor(SCALE * x) for each component. A bounded sample (the square root of the number
of rows) gives pivots; each vector goes to the cell of its nearest pivot. A cell's summary is its size, its radius and
the k + 1 smallest distances to its pivot. From the summaries alone each query gets a score that k other vectors reach
for sure, and for each cell the highest score that any member can have (Cauchy-Schwarz); only cells that can reach the
sure score get the query. Cells are cut into blocks of BLOCK rows, so a hot cell doesn't meet in one task. Every vector
is sent once, to its block; queries are copied to the blocks that they must see, and stream past a block's vectors in
batches, so no number of queries is held. Each batch is one exact matrix product; block results are merged per query.

The sample only places the pivots: any pivots give the same, exact, result.

Data are grouped by pivots and sent once; queries, each with bounds of its own, are what is replicated.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without
vec_id; scores are exact, and those that don't fit 64 bits count as the largest or smallest number that does (a component
that is no longer finite times SCALE counts as the largest double); vectors of another length than the query's are no
candidates of it; ties go to the smaller vec_id; a query is no candidate of itself (rows that repeat its vec_id aren't
either); rows that repeat a candidate's vec_id with the same score count once; fewer candidates than k give fewer rows;
an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE, TOP = 1024, 10
LEAST_PIVOTS, BLOCK = 16, 8192
#: Components from here on are large: products of smaller ones are exact as doubles for up to 2,048 dimensions.
PLAIN = 2.0**21
#: Scores stop at 64 bits, and so do bounds: beyond, ties go by vec_id.
EDGE = 2.0**63


def valid_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)


def integers(column: pa.Array) -> list[np.ndarray]:
    """floor(SCALE * x), x as double, of each vector of a list column."""
    with np.errstate(over="ignore"):
        flat = np.nan_to_num(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    return np.split(flat, ends[:-1]) if len(ends) else []


def assign(vectors: DataFrame, pivots: dict[int, np.ndarray], key: str, vector: str) -> DataFrame:
    """(vec_id, dim, cell, dist, v): each vector with its nearest pivot of its length (cell -1: the origin)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = integers(batch.column(1))
            dims = np.array([len(v) for v in found], np.int32)
            cell, dist = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = np.stack([found[r] for r in rows])
                p = shared.value.get(d)
                with np.errstate(over="ignore", invalid="ignore"):  # a distance that isn't finite bounds nothing
                    if p is None:
                        dist[rows] = np.sqrt((x * x).sum(1))
                        continue
                    near = np.nan_to_num((p * p).sum(1)[None] - 2 * x @ p.T, nan=np.inf, posinf=np.inf, neginf=-np.inf).argmin(axis=1)
                    cell[rows] = near
                    dist[rows] = np.nan_to_num(np.sqrt(((x - p[near]) ** 2).sum(1)), nan=np.inf, posinf=np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(dims), pa.array(cell), pa.array(dist), pa.array([v.astype("<f8").tobytes() for v in found], pa.binary())], names=["vec_id", "dim", "cell", "dist", "v"])

    return vectors.select(key, vector).mapInArrow(nearest, "vec_id long, dim int, cell int, dist double, v binary")


def reach(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, sure: np.ndarray, closest: np.ndarray) -> np.ndarray:
    """Which cells (columns) can hold one of the best scores of queries (rows).

    closest: for each cell the smallest distances to its pivot (inf where it has fewer); sure: how many a query needs.
    """
    with np.errstate(over="ignore", invalid="ignore"):  # where sizes aren't finite any more, anything can be reached and nothing is sure
        at, size = q @ centres.T, np.sqrt((q * q).sum(1))[:, None]
        slack = 1e-9 * (size * (np.sqrt((centres * centres).sum(1)) + radius)[None] + 1)
        most = np.maximum(np.nan_to_num(at + size * radius[None] + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf), -EDGE)
        least = at[:, :, None] - size[:, :, None] * closest[None] - slack[:, :, None]
        least = np.where(np.isfinite(closest)[None] & ~np.isnan(least), np.minimum(least, EDGE), -np.inf).reshape(len(q), -1)
    there = least.shape[1]
    bound = np.partition(least, there - sure, axis=1)[:, there - sure] if there >= sure else np.full(len(q), -np.inf)
    return most >= bound[:, None]


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles; those beyond 64 bits become the largest or smallest that fit.

    Rows and columns with large components are multiplied apart, so that one such vector doesn't slow its block down.
    """
    rows, columns = (np.abs(x).max(axis=1, initial=0) >= PLAIN for x in (v, q))
    out = np.zeros((len(v), len(q)), np.int64)
    for r in filter(len, (np.flatnonzero(~rows), np.flatnonzero(rows))):
        for c in filter(len, (np.flatnonzero(~columns), np.flatnonzero(columns))):
            out[np.ix_(r, c)] = _products(v[r], q[c])
    return out


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    most = v.shape[1] * int(np.abs(v).max(initial=0)) * int(np.abs(q).max(initial=0))
    if most < 2**53:
        return (v @ q.T).astype(np.int64)
    if most < 2**63:
        return v.astype(np.int64) @ q.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in v], object) @ np.array([[int(x) for x in row] for row in q], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(ids: np.ndarray, v: np.ndarray, queries: np.ndarray, q: np.ndarray, top: int) -> list[tuple[np.ndarray, ...]]:
    """(query_id, vec_id, score) of the best of a block for each query."""
    out, scores = [], products(v, q)
    for k, query in enumerate(queries.tolist()):
        s = scores[:, k]
        rows = np.flatnonzero(ids != query)
        if len(rows) > top:
            edge = np.partition(s[rows], len(rows) - top)[len(rows) - top]
            rows = rows[s[rows] >= edge]
        rows = rows[np.lexsort((ids[rows], -s[rows]))][:top]
        out.append((np.full(len(rows), query), ids[rows], s[rows]))
    return out


def _solve(top: int):
    """Rows (dim, cell, block, kind, id, v) by block and kind: a block's vectors (kind 0), then its queries (kind 1)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, table = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            kind, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])) + 1
            found = []
            for a, z in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if a == z:
                    continue
                if block != (now := tuple(keys[:, a].tolist())):
                    block, ids, vectors, table = now, [], [], None
                x = np.stack([np.frombuffer(batch.column(5)[k].as_buffer(), "<f8") for k in range(a, z)])
                if kind[a] == 0:
                    ids.append(own[a:z])
                    vectors.append(x)
                elif ids:
                    if table is None:
                        table = np.concatenate(ids), np.concatenate(vectors)
                    found += _best(*table, own[a:z], x, top)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in (zip(*found) if found else [()] * 3)], names=["query_id", "vec_id", "score"])

    return solve


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", top: int = TOP, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the best `top` other vectors of each row for which is_query (a Column) holds."""
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, vector, key)
    pivots = pivots or max(LEAST_PIVOTS, int(rows.count() ** 0.5))
    sample = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(pivots).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for v in integers(sample.column(vector).combine_chunks()) if sample.num_rows else []:
        found.setdefault(len(v), []).append(v)
    centres = {d: np.unique(np.stack(vs), axis=0) for d, vs in found.items()}
    table = common.stored(spark, assign(rows, centres, key, vector), "cells")
    nearest = Window.partitionBy("dim", "cell").orderBy("dist", "vec_id")
    closest = table.select("dim", "cell", "dist", F.row_number().over(nearest).alias("i")).where(F.col("i") <= top + 1)
    summary = table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # a row for each pivot
    small: dict[tuple[int, int], list[float]] = {}
    for r in closest.collect():  # top + 1 rows for each pivot
        small.setdefault((r["dim"], r["cell"]), []).append(r["dist"])
    cells: dict[int, tuple] = {}
    for d in {r["dim"] for r in summary}:
        own = sorted((r for r in summary if r["dim"] == d), key=lambda r: r["cell"])
        number = np.array([r["cell"] for r in own])
        centre = np.stack([centres[d][c] if c >= 0 else np.zeros(d) for c in number.tolist()])
        close = np.full((len(own), top + 1), np.inf)
        for k, r in enumerate(own):
            x = sorted(small[d, r["cell"]])
            close[k, : len(x)] = x
        cells[d] = number, centre, np.array([r["radius"] for r in own]), close, np.array([-(-r["n"] // BLOCK) for r in own])
    queries = table.where(is_query)
    shared = spark.sparkContext.broadcast(cells)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the blocks of all cells that they must see."""
        cells = shared.value
        for batch in batches:
            ids, dims = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for d in np.unique(dims).tolist():
                number, centre, radius, close, blocks = cells[d]
                mine = np.flatnonzero(dims == d)
                step = max(1, (1 << 21) // max(1, close.size))
                for s in range(0, len(mine), step):
                    rows = mine[s : s + step]
                    q = np.stack([np.frombuffer(batch.column(2)[r].as_buffer(), "<f8") for r in rows.tolist()])
                    i, c = np.nonzero(reach(q, centre, radius, top + 1, close))
                    times = blocks[c]
                    i, c = np.repeat(i, times), np.repeat(c, times)
                    block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    for a in range(0, len(i), 4096):
                        k, e = rows[i[a : a + 4096]], c[a : a + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), d, np.int32)), pa.array(number[e].astype(np.int32)), pa.array(block[a : a + 4096].astype(np.int32)), pa.array(np.ones(len(k), np.int32)), pa.array(ids[k]), batch.column(2).take(pa.array(k))], names=["dim", "cell", "block", "kind", "id", "v"])

    sent = queries.select("vec_id", "dim", "v").mapInArrow(send, "dim int, cell int, block int, kind int, id long, v binary")
    sizes = spark.createDataFrame([(d, int(c), int(b)) for d, (number, *_, blocks) in cells.items() for c, b in zip(number, blocks)], "dim int, cell int, blocks int")
    dealt = table.select("dim", "cell", "vec_id", "v").join(F.broadcast(sizes), ["dim", "cell"])  # a row for each pivot
    dealt = dealt.select("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v")
    group = ["dim", "cell", "block"]
    best = sent.unionByName(dealt).repartition(*group).sortWithinPartitions(*group, "kind", "id").mapInArrow(_solve(top), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
