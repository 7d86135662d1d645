"""Selection over all rows: exact medians by range partitions, and reservoirs that merge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.shared import fresh, written


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``a`` with the other columns of ``b``, which has at most one row of each key; null keys agree."""
    own = fresh([*a.columns, *b.columns], *by)
    on = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(by, own, strict=True)]
    right = b.select(*(F.col(x).alias(y) for x, y in zip(by, own, strict=True)), *(c for c in b.columns if c not in by))
    return a.join(right, on, "left").drop(*own)


def medians(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by..., one column a name of ``values``) the exact medians; null and NaN are left out, a group without values is null.

    Equal values of a group are counted before they are shuffled; the counted values are dealt by range of (group, value) and
    ranked within their range, behind the sums of the ranges before. So a group of any size is many tasks and no aggregator
    grows with it.
    """
    name, v, m, part, s, before, total, run = fresh([*by, *values], "name", "v", "m", "part", "s", "before", "total", "run")
    flat = F.array(*(F.struct(F.lit(n).alias(name), c.cast("double").alias(v)) for n, c in values.items()))
    d = df.select(*by, F.inline(flat)).filter(F.col(v).isNotNull() & ~F.isnan(v))
    group = [*by, name]
    c = d.groupBy(*group, v).agg(F.count("*").alias(m))
    r = written(c.repartitionByRange(*group, v).withColumn(part, F.spark_partition_id()), "ranks")
    along = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = r.groupBy(*group, part).agg(F.sum(m).alias(s))
    per = per.select(*group, part, F.coalesce(F.sum(s).over(along), F.lit(0)).alias(before), F.sum(s).over(Window.partitionBy(*group)).alias(total))
    w = Window.partitionBy(*group, part).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    x = beside(r.withColumn(run, F.sum(m).over(w)), per, [*group, part])
    first = F.col(before) + F.col(run) - F.col(m)  # rank of the first of the equal values
    holds = lambda rank: (first <= rank) & (rank < first + F.col(m))
    lo, hi = holds(F.floor((F.col(total) - 1) / 2)), holds(F.floor(F.col(total) / 2))
    g = x.filter(lo | hi).groupBy(*group).agg(((F.max(F.when(lo, F.col(v))) + F.max(F.when(hi, F.col(v)))) / 2).alias(v))
    return g.groupBy(*by).agg(*(F.max(F.when(F.col(name) == n, F.col(v))).alias(n) for n in values))


class Reservoir:
    """k rows of a stream, each equally likely, with skips between the rows that enter (Li 1994, algorithm L)."""

    def __init__(self, k: int, rng: np.random.Generator) -> None:
        self.k, self.rng, self.seen, self.rows = k, rng, 0, []
        self.w, self.next = 1.0, 0

    def _skip(self) -> None:
        self.w *= math.exp(math.log(1 - self.rng.random()) / self.k)
        self.next += 1 + (math.floor(math.log(1 - self.rng.random()) / math.log1p(-self.w)) if self.w < 1 else 0)

    def add(self, b: pa.RecordBatch) -> None:
        slots, at = [], []
        while self.k and self.next < self.seen + len(b):
            if self.next < self.k:
                slots.append(self.next)
                at.append(self.next - self.seen)
                self.next += 1
                if self.next == self.k:
                    self.next -= 1  # the last of the first k rows; from here on by skips
                    self._skip()
            else:
                slots.append(int(self.rng.integers(self.k)))
                at.append(self.next - self.seen)
                self._skip()
        if at:
            own = b.take(pa.array(at))  # a copy, so that the batch can go
            self.rows += [None] * (min(self.k, self.seen + len(b)) - len(self.rows))
            for i, slot in enumerate(slots):
                self.rows[slot] = own.slice(i, 1)
        self.seen += len(b)


def reservoir_sample(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """K rows of ``df``, every set of k equally likely; all rows where there are fewer.

    Each partition keeps a reservoir in one pass. The driver sees a row a partition, its number of rows, and draws how many
    of the k come from each; these are taken from the reservoirs in random order. Nothing is sorted, and only the reservoirs
    (k rows a partition at most) leave the pass. The same rows in the same partitions give the same sample.
    """
    part, slot, seen = fresh(df.columns, "part", "slot", "seen")
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in df.schema), *(StructField(c, LongType()) for c in (part, slot, seen))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, number])
        r = Reservoir(k, rng)
        for b in batches:
            r.add(b)
        if r.rows:
            t = pa.Table.from_batches(r.rows)
            order = rng.permutation(len(t))
            for c, x in ((part, np.full(len(t), number)), (slot, order), (seen, np.full(len(t), r.seen))):
                t = t.append_column(c, pa.array(x.astype(np.int64)))
            yield from t.combine_chunks().to_batches(max_chunksize=10_000)

    if k <= 0:
        return df.limit(0)
    kept = written(df.mapInArrow(run, schema), "reservoirs")
    sizes = sorted(kept.filter(F.col(slot) == 0).select(part, seen).collect())  # a row a partition
    counts = np.array([n for _, n in sizes], np.int64)
    take = _drawn(counts, min(k, int(counts.sum())), np.random.default_rng([seed, 1 << 32]))
    share = df.sparkSession.createDataFrame([(int(p), int(n)) for (p, _), n in zip(sizes, take, strict=True)], f"{part} long, {seen} long")
    return kept.drop(seen).join(F.broadcast(share), part).filter(F.col(slot) < F.col(seen)).select(*df.columns)


def _drawn(counts: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """How many of k rows drawn without replacement fall to each of some sets of rows."""
    out, left = [], int(counts.sum())
    for n in counts.tolist():
        rest = left - n
        x = n if k >= left else int(_hypergeometric(rng, n, rest, k)) if k else 0
        out.append(x)
        k, left = k - x, rest
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, k))
    x = 0  # numpy refuses larger sets: row by row, k draws over all sets together at most
    for i in range(k):
        x += rng.random() * (good + bad - i) < good - x
    return x
