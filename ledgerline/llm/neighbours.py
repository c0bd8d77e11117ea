"""Nearest neighbours by inner product: a block matrix join of int8 tiles.

Vectors are packed into blocks, as floats where that is how they are stored. In
every tile (block of queries, block of candidates) they are rounded to int8 with
a scale each, and all products of int8 values are taken exactly, DIMS dimensions at a
time; the true product lies within a bound that follows from the lengths of
the rounding errors. Per query, pairs whose upper bound reaches the k-th largest
lower bound are computed again in double precision from the block's own vectors,
so that even a third of all rows within each other's bounds stay in their tiles,
and the tile keeps its k best. Tiles' lists are merged by heaps, so a query's
rows are k a tile at most.

Vectors that are null, empty, zero, of another length than most, or that hold
null or non-finite components take no part, nor do null ids. Equal products go
by smaller id. Rows that repeat an id are candidates each; an id is searched for
once, with its smallest vector. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a block of queries and of candidates, at most, and bytes of either; a product is held for ROWS queries at once.
QUERY_ROWS, CANDIDATE_ROWS, BLOCK_BYTES, ROWS = 4096, 16_384, 8 << 20, 256
#: Dimensions whose int8 products single precision adds up exactly: 1024 * 127 * 127 < 2^24.
DIMS = 1024
#: Tasks for the tiles, at most; further tiles queue up in them.
TASKS = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """Ids and vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & (F.coalesce(F.size("v"), F.lit(-1)) > 0) & ~bad & F.exists("v", lambda x: x != 0))


def _blocks(rows: DataFrame, n_blocks: int, of: str, kind: str) -> DataFrame:
    """(block, ids, vectors) with each block's rows packed in one row; hashing keeps blocks even."""

    def pack(key, table):
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        v = flat.reshape(len(ids), -1)[order].astype(kind)
        return pa.table({of: [key[0].as_py()], f"{of}_ids": [ids[order].tobytes()], f"{of}_v": [v.tobytes()]}, schema=pa.schema([(of, pa.int32()), (f"{of}_ids", pa.binary()), (f"{of}_v", pa.binary())]))

    salted = rows.withColumn(of, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    return salted.groupBy(of).applyInArrow(pack, f"{of} int, {of}_ids binary, {of}_v binary")


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as float32 for the product), scales, lengths of the rounded vectors and of their errors."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1.0  # components too small to divide
    q = np.rint(v / scale[:, None])
    error = v - q * scale[:, None]
    return q.astype(np.float32), scale, scale * np.sqrt((q**2).sum(axis=1)), np.sqrt((error**2).sum(axis=1))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of int8 values, without rounding."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], DIMS):
        out += a[:, d : d + DIMS] @ b[:, d : d + DIMS].T
    return out


@np.errstate(over="ignore", invalid="ignore")
def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """Each query's k best candidates of one tile: a list of (query, candidates, scores)."""
    out = []
    ci, cs, cn, ce = quantise(c)
    k_th = min(k, len(c_ids))
    for a in range(0, len(q_ids), ROWS):
        ids, own_q = q_ids[a : a + ROWS], q[a : a + ROWS]
        qi, qs, qn, qe = quantise(own_q)
        near = exact_products(qi, ci)
        near *= qs[:, None]
        near *= cs[None, :]
        slack = 1e-12 * (qn + qe).max() * (cn + ce).max() * max(1.0, q.shape[1] / 1000)
        error = qn[:, None] * ce[None, :] + qe[:, None] * (cn + ce)[None, :] + slack
        unknown = ~(np.isfinite(near) & np.isfinite(error))  # out of range: always computed again
        near[unknown], error[unknown] = 0.0, np.inf
        own = ids[:, None] == c_ids[None, :]
        near[own] = -np.inf
        lower = near - error
        floor = -np.partition(-lower, k_th - 1, axis=1)[:, k_th - 1]
        for r in range(len(ids)):
            left = np.flatnonzero((near[r] + error[r] >= floor[r]) & ~own[r])
            if len(left):
                score = np.cumsum(c[left] * own_q[r], axis=1)[:, -1]  # added up in order, as SQL does
                best = np.lexsort((c_ids[left], -score))[:k]
                out.append((ids[r], c_ids[left[best]], score[best]))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest `vectors` of each of `queries`: query_id, rank, vec_id, score."""
    rows, asked = usable(vectors), usable(queries)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    d = dims["d"]
    rows = rows.filter(F.size("v") == d)
    asked = asked.filter(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    kind = "<f4" if all("float" in x.schema["embedding"].dataType.simpleString() for x in (vectors, queries)) else "<f8"
    fit = max(1, BLOCK_BYTES // (d * np.dtype(kind).itemsize))
    n_query = max(1, math.ceil(asked.count() / min(QUERY_ROWS, fit)))
    few = math.ceil(2 * spark.sparkContext.defaultParallelism / n_query)  # a small table is cut finer, for all cores
    n_cand = max(1, math.ceil(dims["count"] / min(CANDIDATE_ROWS, fit)), min(few, dims["count"] // 1024))
    left = _blocks(asked, n_query, "q", kind).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))))
    right = _blocks(rows, n_cand, "c", kind).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    tasks = min(n_query * n_cand, TASKS)
    tiles = left.repartition(tasks, "q", "c").join(right.repartition(tasks, "q", "c"), ["q", "c"]).select("q_ids", "q_v", "c_ids", "c_v")

    def products(batches):
        for batch in batches:
            for q_ids, q_v, c_ids, c_v in zip(*(batch.column(i) for i in range(4)), strict=True):
                qi, ci = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(c_ids.as_py(), np.int64)
                q, c = (np.frombuffer(v.as_py(), kind).reshape(-1, d).astype(np.float64) for v in (q_v, c_v))
                out = tile(qi, q, ci, c, k)
                if out:
                    sizes = [len(x[1]) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], sizes)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], names=["query_id", "vec_id", "score"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip((-frame["score"]).tolist(), frame["vec_id"].tolist(), strict=True))
        return pd.DataFrame({"query_id": key[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [x[1] for x in best], "score": [-x[0] for x in best]})

    return tiles.mapInArrow(products, "query_id long, vec_id long, score double").groupBy("query_id").applyInPandas(merge, schema)


SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
