"""Nearest neighbours by largest inner product: stable projections, a kd-tree, incremental search, chi-square stop.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) for rows (M: the largest norm) and 0 for
queries. Gaussian (2-stable) projections to ``PROJ`` dimensions make squared projected distance over squared
distance a chi-square variable of ``PROJ`` degrees. Rows are dealt to blocks; in a block a kd-tree over the
projections gives its leaves, and a query takes them in order of projected distance, verifies their rows in double
precision, and stops once a row as near as the k-th best would, with probability ``STOP``, have been met already.
Each block gives its k best for a query; the best k of those are the result.

Queries go to every block in chunks (a stated query set against all rows); the index holds every row, none is
sampled. A worker holds one block and one chunk of queries. Equal scores order by smaller key.

Defined results: rows with null key or unusable vectors take no part; shorter vectors are padded with zeros;
repeated rows are candidates of their own, except for a query with the same key; no queries or rows: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import written
from .vectors import matrix, padded, take_part

PROJ, LEAF, STOP, SEED = 8, 128, 0.95, 20
#: Rows of a block and queries of a chunk, at most; blocks at least.
BLOCK_ROWS, CHUNK, MIN_BLOCKS = 32_768, 8192, 16
#: Relative slack under which a row is scored again term by term before it is ranked.
SLACK = 1e-9

SCHEMA = "query_key long, key long, score double"


def chi2_cdf(x: np.ndarray, dof: int) -> np.ndarray:
    """Of an even number of degrees of freedom."""
    h = x / 2
    return 1 - np.exp(-h) * sum(h**i / factorial(i) for i in range(dof // 2))


def kd_leaves(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """kd-tree by median cuts of the widest dimension: rows of each leaf, and the leaves' lower and upper corners."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        p = points[rows]
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        d = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argpartition(p[:, d], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves, np.array([points[r].min(0) for r in leaves]), np.array([points[r].max(0) for r in leaves])


def search_block(keys: np.ndarray, rows: np.ndarray, qkeys: np.ndarray, queries: np.ndarray, k: int, top: float, stop: float = STOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one block for each query, as (query key, key, score); ``top`` is the largest norm of all rows."""
    dim = rows.shape[1]
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    lift = np.sqrt(np.maximum(0.0, top * top - (rows * rows).sum(1)))
    g = np.random.default_rng(SEED).normal(size=(dim + 1, PROJ))
    leaves, low, high = kd_leaves(rows @ g[:dim] + lift[:, None] * g[dim], LEAF)
    leaves = [np.sort(x) for x in leaves]
    pq, base = queries @ g[:dim], (queries * queries).sum(1) + top * top
    best_score = np.full((len(queries), k), -np.inf)
    best_row = np.full((len(queries), k), -1)
    gap = np.empty((len(queries), len(leaves)))
    for i in range(len(leaves)):
        d = np.maximum(0.0, np.maximum(low[i] - pq, pq - high[i]))
        gap[:, i] = (d * d).sum(1)
    turn = np.argsort(gap, axis=1, kind="stable")
    gap = np.take_along_axis(gap, turn, 1)
    live = np.arange(len(queries))
    for step in range(len(leaves)):
        kth = best_score[live, -1]
        far = np.where(np.isfinite(kth), np.maximum(base[live] - 2 * kth, 1e-300), np.inf)
        live = live[chi2_cdf(gap[live, step] / far, PROJ) < stop]
        if not len(live):
            break
        own = turn[live, step]
        by = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[by])) + 1
        for q in np.split(live[by], cuts):
            r = leaves[turn[q[0], step]]
            s = queries[q] @ rows[r].T
            s[qkeys[q][:, None] == keys[r][None]] = -np.inf
            slack = SLACK * (np.abs(best_score[q, -1:]) + 1e-300)
            at, col = np.nonzero(np.isfinite(s) & (s >= np.where(np.isfinite(best_score[q, -1:]), best_score[q, -1:] - slack, -np.inf)))
            if not len(at):
                continue
            exact = (queries[q[at]] * rows[r[col]]).sum(1)
            for i in np.unique(at):
                mine = at == i
                sc = np.concatenate([best_score[q[i]], exact[mine]])
                rw = np.concatenate([best_row[q[i]], r[col[mine]]])
                first = np.lexsort((rw, -sc))[:k]  # rows are in order of their keys
                best_score[q[i]], best_row[q[i]] = sc[first], rw[first]
    ok = best_row >= 0
    return np.repeat(qkeys, k)[ok.ravel()], keys[best_row[ok]], best_score[ok]


def nearest(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, stop: float = STOP) -> DataFrame:
    """(query_key, rank, key, score): for each row of ``is_query`` (over ``key``, ``vector``) its k nearest other rows."""
    spark = df.sparkSession
    d = written(take_part(df, key, vector), "ann")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    query = is_query
    n, nq, dim, top = d.agg(F.count("*"), F.sum(query.cast("long")), F.max(F.size("vector")), F.max(F.sqrt(norm))).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_key long, rank int, key long, score double")
    blocks, chunks = max(MIN_BLOCKS, -(-n // BLOCK_ROWS)), -(-nq // CHUNK)
    d = d.select("key", padded(F.col("vector"), dim).alias("vector"), query.alias("query"))
    part = lambda m, s: F.pmod(F.xxhash64(F.lit(s), "key"), F.lit(m)).cast("int")
    rows = d.select("key", "vector", part(blocks, 1).alias("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    queries = d.filter("query").select("key", "vector", part(chunks, 2).alias("chunk")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, s = (np.array([], t) for t in (np.int64, np.int64, np.float64))
        if len(left) and len(right):
            q, c, s = search_block(left["key"].to_numpy(), matrix(left["vector"], dim), right["key"].to_numpy(), matrix(right["vector"], dim), k, top * (1 + 1e-12), stop)
        return pa.table({"query_key": pa.array(q, pa.int64()), "key": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    found = rows.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(run, SCHEMA)
    w = Window.partitionBy("query_key").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_key", "rank", "key", "score")
