"""Connected components of an edge table.

*Small* edge tables (``LOCAL_NUMBERS`` numbers at most, counted first) are solved by one task over the written edges,
by minima with pointer jumping. *Larger* ones take alternating large-star and small-star rounds until they are small:
a round links every neighbour to the smallest id around it, first the larger neighbours, then the smaller, and rounds
grow with the logarithm of a component's diameter. Neighbourhoods are never gathered: each round is minima
(pre-aggregated) joined back to the edges, so a centre with a third of all edges is a join key that Spark splits. What
a round makes is written to the shared folder. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import written

#: Numbers (ends of edges, times their fields) that one task holds: 16 MB of them.
LOCAL_NUMBERS = 2_000_000


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def numbered(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the distinct rows in ascending order, number of each row among them)."""
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in cols], axis=0)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _local(e: DataFrame) -> DataFrame:
    kind = e.schema["hi"].dataType
    fields = kind.names if isinstance(kind, T.StructType) else None
    schema = T.StructType([T.StructField("id", kind), T.StructField("component", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([t["hi"].combine_chunks(), t["lo"].combine_chunks()])
        one, at = numbered([ends.field(f).to_numpy() for f in fields] if fields else [ends.to_numpy()])
        root = joined(len(one), at[: len(t)], at[len(t) :])
        for i in range(0, len(one), 100_000):
            yield pa.RecordBatch.from_arrays([ends.take(pa.array(one[i : i + 100_000])), ends.take(pa.array(one[root[i : i + 100_000]]))], schema=pa.schema([("id", ends.type), ("component", ends.type)]))

    return e.coalesce(1).mapInArrow(run, schema)


def connected(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id that edges reach.

    Ids are longs or structs of longs. Loops and repeated edges change nothing, null ends are no edge, no edge gives
    an empty table.
    """
    e = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = written(e.distinct(), "edges")
    kind = e.schema["hi"].dataType
    wide = 2 * (len(kind) if isinstance(kind, T.StructType) else 1)

    def mark() -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    last, now = None, mark()
    for _ in range(max_rounds):
        if now[0] * wide <= LOCAL_NUMBERS:
            return _local(e)
        if now == last:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(e.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct(), "large")
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        j = large.join(least, "hi")
        small = j.select("hi", F.col("m").alias("lo")).unionByName(j.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        e = written(small.distinct(), "edges")
        last, now = now, mark()
    raise RuntimeError("components did not settle")
