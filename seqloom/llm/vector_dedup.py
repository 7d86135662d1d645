"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference points in order (pivots: a bounded, hash-chosen set of
vectors that are apart, see :func:`reference_points`). Inverted lists are kept for pairs of pivots, so two vectors meet in a list exactly when they share two
pivots or more. A pair is verified in the one list of its two smallest shared pivots: cosine in double precision.
Equal vectors are one class first. Lists longer than ``LIST_ROWS`` are cut into chunks and verified chunk against
chunk. A list gives, per vector, its number of links and one edge to the smallest id it reaches there, never pairs.

The pivots are fixed by the rows' hashes; every row is indexed. Recall for random pairs at cosine 0.951 is 0.997
(tests measure it against brute force).

Defined results: unusable vectors and rows without a key link with nothing (component: themselves); shorter vectors
are padded with zeros; repeated rows are equal vectors; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected, joined
from .runtime import lean, written
from .vectors import kind, matrix, padded, take_part, usable

NEAREST, MIN_PIVOTS, MAX_PIVOTS, LIST_ROWS = 7, 512, 32_768, 4096
SCHEMA = "id long, links long, root long"


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots by cosine, nearest first, ties to the smaller number."""
    s = vectors @ pivots.T
    k = min(nearest, len(pivots))
    part = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def reference_points(sample: np.ndarray, want: int, apart: float = 0.8) -> np.ndarray:
    """Vectors of the sample that are no near copies of one another, filled up with random directions.

    So a large group of near copies has one reference point, and its members agree on their nearest others.
    """
    kept: list[int] = []
    near = np.zeros(len(sample), bool)
    for i in range(len(sample)):
        if not near[i]:
            kept.append(i)
            if len(kept) == want:
                break
            near |= sample @ sample[i] >= apart
    g = np.random.default_rng(10).normal(size=(want - len(kept), sample.shape[1]))
    return np.concatenate([sample[kept], g / np.linalg.norm(g, axis=1, keepdims=True)])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def verify_list(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray, perm: np.ndarray, chunk: np.ndarray, cross: bool, shared: int, base: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of one list (or of two chunks of it): per linked id the rows linked and the smallest id reached."""
    order = np.argsort(ids, kind="stable")
    ids, sizes, unit, perm, chunk = ids[order], sizes[order], unit[order], perm[order], chunk[order]
    links, ends = np.zeros(len(ids), np.int64), []
    for at in range(0, len(ids), 1024):
        s = unit[at : at + 1024] @ unit[at:].T
        i, j = np.nonzero(s >= least - 1e-9)
        keep = i < j
        if cross:
            keep &= chunk[at + i] != chunk[at + j]
        i, j = at + i[keep], at + j[keep]
        for lo in range(0, len(i), 1 << 18):
            a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            both = (perm[a][:, :, None] == perm[b][:, None, :]).any(2)  # perm rows ascend here
            first = np.argsort(~both, axis=1, kind="stable")[:, :2]
            p = np.take_along_axis(perm[a], first, 1)
            ok = (p[:, 0] * base + p[:, 1] == shared) & ((unit[a] * unit[b]).sum(1) >= least)
            a, b = a[ok], b[ok]
            if len(a):
                np.add.at(links, a, sizes[b])
                np.add.at(links, b, sizes[a])
                r = joined(len(ids), a, b)
                ends.append(np.stack([np.arange(len(ids)), r], 1)[r != np.arange(len(ids))])
    if not ends:
        return None
    e = np.concatenate(ends)
    r = joined(len(ids), e[:, 0], e[:, 1])
    on = links > 0
    return ids[on], links[on], ids[r[on]]


def link(df: DataFrame, key: str, vector: str, least: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``df``; see the module."""
    spark = df.sparkSession
    every = df.select(F.col(key).cast("long").alias("key"))
    d = written(take_part(df, key, vector), "vectors")
    classes = written(d.groupBy("vector").agg(F.min("key").alias("id"), F.count("*").alias("size")), "classes")
    n, dim = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return every.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    want = min(MAX_PIVOTS, max(MIN_PIVOTS, 1 << int(2 * n**0.5).bit_length()))
    member = d.join(classes.select("vector", "id"), "vector").select("key", "id")
    classes = classes.select("id", "size", padded(F.col("vector"), dim).alias("vector"))
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64(F.lit(10), "id"), "id").limit(2 * want).select("vector").collect()], dtype=np.float64)
    pivots = reference_points(_unit(sample), want)
    base = len(pivots)
    sent = spark.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(matrix(b.column("vector"), dim)) if len(b) else np.zeros((0, dim))
            p = describe(x, sent.value, NEAREST) if len(b) else np.zeros((0, NEAREST), int)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("vector"), flat], ["id", "size", "vector", "perm"])

    a = written(classes.mapInArrow(lean(assign), f"id long, size long, vector {kind(df, vector)}, perm array<int>"), "permutations")
    # pairs of the vector's pivots, as smaller * base + larger
    up = F.array_sort("perm").alias("up")
    pairs = F.flatten(F.transform(F.col("up"), lambda p, i: F.transform(F.slice(F.col("up"), i + 2, F.size("up")), lambda q: p.cast("long") * base + q)))
    lists = a.select("id", "size", "vector", up).withColumn("list", F.explode(pairs))
    long = written(a.select(up).select(F.explode(pairs).alias("list")).groupBy("list").count().filter(F.col("count") > LIST_ROWS), "long")
    lists = lists.join(long, "list", "left")
    chunks = F.coalesce(F.ceil(F.col("count") / LIST_ROWS), F.lit(1)).cast("int")
    lists = lists.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), "id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    lists = lists.select("list", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "id", "size", "vector", "up")
    cells = lists.repartition("list", "a", "b").sortWithinPartitions("list", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            out: list = []
            if len(t):
                cell = np.stack([t[c].to_numpy() for c in ("list", "a", "b")], 1)
                cuts = np.flatnonzero((np.diff(cell, axis=0) != 0).any(1)) + 1
                ids, sizes, chunk = (t[c].to_numpy() for c in ("id", "size", "chunk"))
                x = _unit(matrix(t["vector"], dim))
                perm = matrix(t["up"], min(NEAREST, base)).astype(np.int64)
                for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
                    if hi - lo > 1:
                        r = verify_list(ids[lo:hi], sizes[lo:hi], x[lo:hi], perm[lo:hi], chunk[lo:hi], bool(cell[lo, 1] != cell[lo, 2]), int(cell[lo, 0]), base, least)
                        if r:
                            out.append(r)
            cols = [np.concatenate([o[i] for o in out]) if out else np.array([], np.int64) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "links", "root"])

        for b in batches:
            if not len(b):
                continue
            ends = [c[-1].as_py() for c in (b.column("list"), b.column("a"), b.column("b"))]
            cell = np.stack([b.column(c).to_numpy() for c in ("list", "a", "b")], 1)
            tail = int(((cell != np.array(ends)).any(1)).sum())  # rows are sorted: the last cell may go on
            if tail:
                yield done(pa.Table.from_batches([*held, b.slice(0, tail)]))
                held = [b.slice(tail)]
            elif held and [c[-1].as_py() for c in (held[0].column("list"), held[0].column("a"), held[0].column("b"))] != ends:
                yield done(pa.Table.from_batches(held))
                held = [b]
            else:
                held.append(b)
        if held:
            yield done(pa.Table.from_batches(held))

    found = written(cells.mapInArrow(lean(verify), SCHEMA), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    of = classes.select("id", "size").join(links, "id", "left").join(comp, "id", "left")
    of = of.select("id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    part = member.join(of, "id").select("key", "n_links", "component_id")
    rest = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind(df, vector)).alias("vector"))
    rest = rest.filter(~(F.col("key").isNotNull() & usable(F.col("vector")))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return part.unionByName(rest).withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))
