"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Query blocks meet candidate blocks on a grid; both sides are replicated to the cells of their row or column. In a cell
each dimension is a term: its postings (candidates with a nonzero weight) are scattered, times the queries' weights,
into a dense score array. A partition selects the k best of each query, and cells are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, EVERY = 5, 50
#: Rows of a candidate block and of a query block, and queries whose scores are held at once.
CANDIDATES, QUERIES, HELD = 2_048, 1_024, 256


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): components as floor(scale * x); vectors that are null or hold null or non-finite components are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = rows.flatten().to_numpy()
    return out


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best candidates but itself; ties go to the smaller id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    terms = min(q.shape[1], c.shape[1])
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, terms)
    kind = np.int32 if largest < 2**31 - 1 else np.int64
    postings = [(ids := np.flatnonzero(c[:, t]), c[ids, t].astype(kind)) for t in range(terms)]
    out: tuple[list, list, list] = ([], [], [])
    low = np.iinfo(kind).min
    for a in range(0, len(q), HELD):
        some, names = q[a : a + HELD].astype(kind), q_ids[a : a + HELD]
        scores = np.zeros((len(c), len(some)), kind)
        for t, (ids, weights) in enumerate(postings):
            on = np.flatnonzero(some[:, t])
            if len(on) == len(some):
                scores[ids] += weights[:, None] * some[:, t]
            elif len(on):
                scores[ids[:, None], on[None, :]] += weights[:, None] * some[on, t]
        scores = np.ascontiguousarray(scores.T)
        lo, hi = np.searchsorted(c_ids, names, "left"), np.searchsorted(c_ids, names, "right")
        for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            scores[i, x:y] = low
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        else:
            kth = np.full(len(some), low, kind)
        for i, bound in enumerate(kth):
            row = scores[i]
            above = np.flatnonzero(row > bound)
            pick = np.concatenate([above, np.flatnonzero(row == bound)[: k - len(above)]]) if bound > low else above
            out[0].append(np.full(len(pick), names[i]))
            out[1].append(c_ids[pick])
            out[2].append(row[pick].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``queries(vec_id, x)`` against all of ``candidates(vec_id, x)``.

    Shorter vectors count as zero beyond their end. A query meets no candidate of its own vec_id. Repeated candidate
    rows are candidates each; a repeated query id is one query with the results of all its rows. Scores are 64-bit.
    """
    n, m = candidates.count(), queries.count()
    cols, rows = -(-max(1, n) // CANDIDATES), -(-max(1, m) // QUERIES)
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    left = queries.select("vec_id", "x", block(rows).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    right = candidates.select("vec_id", "x", block(cols).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        found = best(q.column("vec_id").to_numpy(), _matrix(q.column("x")), c.column("vec_id").to_numpy(), _matrix(c.column("x")), k) if len(q) and len(c) else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(cell, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose vec_id is divisible by 50; an empty table gives an empty result."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) x FROM embeddings),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= {K}
"""
