"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Every source gets a target number of tokens (:func:`targets`).
2. The mix's tokens are handed to sources one by one (blocks of one token, so that a small source comes as near its target as a
   large one) to the highest quotient target/(2*seats+1) (:func:`apportion`), then a source's tokens to its shards
   in the same way, so each shard knows an integer quota before anything is selected.
3. A shard is a seeded hash class of a source's documents, in a seeded order. Its tokens are cut into
   blocks of ``BLOCK`` and a rest; the quota is met by whole passes and, for what is left, by the blocks that a seeded
   affine permutation of the block numbers puts first, the last of them in part. So every source takes its target, rounded.

The driver gets a row for each shard, some 24 bytes for ``SHARD`` tokens, and one for each source (``MAX_SOURCES``
at most, a bound of its memory). A hot source is many shards, so no task holds a source; documents are shuffled once.

Defined results: a null text has size 0, an empty table gives an empty result, a null source is a source
of its own (last in order), repeated rows count each, equal keys are ordered by size; where a source has less than two
blocks its first tokens are taken.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bytewords import counts
from .runtime import fresh, lean, written

#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Tokens of a block that is selected, and of a shard, about.
BLOCK, SHARD = 16, 1 << 20
MAX_SOURCES = 5_000_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Tokens for each source: by weight, at most ``cap`` times its size, the excess reshared by weight."""
    n, w = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_ = cap * n, np.ones(len(n), bool)
    total = share * n.sum()
    while open_.any():
        rest = max(0.0, total - out[~open_].sum())
        over = open_ & (rest * w > cap * n * w[open_].sum())
        if not over.any():
            out[open_] = rest * w[open_] / w[open_].sum()
            break
        open_ &= ~over
    return out.tolist()


def apportion(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Lague: ``seats`` by highest votes/(2*seats+1), at most ``caps`` each; ties to the first.

    The rule passes through every state min(cap, number of quotients above x). Bisection finds the last such
    state within ``seats``; only the seats that are left, ties mostly, are handed out one by one.
    """
    v, c = np.asarray(votes, float), np.asarray(caps, np.int64)
    c = np.where(v > 0, c, 0)
    seats = int(min(seats, c.sum()))
    if seats <= 0:
        return [0] * len(v)

    def above(x: float) -> np.ndarray:
        return np.minimum(c, np.ceil((v / x - 1) / 2).clip(0, 2.0**62).astype(np.int64))

    low, high = 0.0, float(v.max()) * 2  # low gives more than seats, high none
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if above(mid).sum() > seats else (low, mid)
    got = above(high)
    heap = [(-v[i] / (2 * int(got[i]) + 1), i) for i in np.flatnonzero(got < c)]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < c[i]:
            heapq.heappush(heap, (-v[i] / (2 * int(got[i]) + 1), i))
    return got.tolist()


def _stride(n: int, seed: int) -> tuple[int, int]:
    """Factor and offset of a seeded permutation k -> (a*k + b) mod n."""
    a = (0x9E3779B1 * (2 * seed + 1)) % n if n > 1 else 0
    while n > 1 and math.gcd(a, n) != 1:
        a = (a + 1) % n
    return a, (0x85EBCA77 * (seed + 1)) % n if n else 0


def quotas(shards: list[tuple[str | None, int, int]], weights: tuple[float, ...], share: float, cap: int, block: int, seed: int) -> list[tuple]:
    """(source, shard, tokens) -> (source, shard, source's tokens, target, whole blocks, quota in tokens, permutation factor, offset)."""
    by: dict[str | None, list[tuple[int, int]]] = {}
    for source, shard, size in shards:
        by.setdefault(source, []).append((shard, size))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    sizes = [sum(n for _, n in by[s]) for s in order]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, cap)
    seats = apportion(goal, round(sum(goal)), [cap * n for n in sizes])
    out: list[tuple] = []
    for s, n, t, q in zip(order, sizes, goal, seats, strict=True):
        own = sorted(by[s])
        each = [q] if len(own) == 1 else apportion([float(x) for _, x in own], q, [cap * x for _, x in own])
        for (shard, x), mine in zip(own, each, strict=True):
            out.append((s, shard, n, float(t), x // block, mine, *_stride(x // block, (seed * 1_000_003 + shard * 7919 + len(out)) % 2**31)))
    return out


def token_count(text: Column) -> Column:
    """Number of words of a text, off whole buffers; null: 0."""

    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in col:
            yield pa.array(counts(t))

    return F.arrow_udf(lean(run), "long")(text.cast("string"))


def mix(docs: DataFrame, key: str, size: str, source: str, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: key, size, source, source_size, target, and ``spans``, the (first, end, times) token ranges that the mix takes.

    With ``carry`` also a struct of those columns. Other columns are not read and may have any name.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), *([F.struct(*carry).alias("carry")] if carry else []))
    narrow = written(d.select("key", "size", "source"), "sizes")
    d = d if carry else narrow  # carried columns are read again rather than written
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).toArrow()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # a source's number of shards hangs on its own size only
    n_of = [(("n" if s is None else "s" + s), max(1, -(-n // shard))) for s, n in zip(*(totals[c].to_pylist() for c in ("source", "source_size")), strict=True)]
    skey = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    per = spark.createDataFrame([x for x in n_of if x[1] > 1], "skey string, n_shards long")  # those of one shard are left out

    def sharded(x: DataFrame) -> DataFrame:
        x = x.withColumn("skey", skey).withColumn("h", F.xxhash64(F.lit(seed), F.col("key")))
        x = x.join(F.broadcast(per), "skey", "left")  # a row for each source of SHARD tokens or more
        return x.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "h", "size"), F.coalesce("n_shards", F.lit(1))).cast("long")).drop("n_shards")

    d = sharded(d)
    sums = sharded(narrow).groupBy("source", "shard").agg(F.sum("size").alias("n")).toArrow()
    sums = list(zip(*(sums[c].to_pylist() for c in ("source", "shard", "n")), strict=True))
    plan = quotas(sums, weights, share, cap, block, seed)
    shard_sizes = {(s, k): n for s, k, n in sums}
    q = spark.createDataFrame(
        [("n" if s is None else "s" + s, *rest, shard_sizes[s, rest[0]]) for s, *rest in plan],
        "skey string, shard long, source_size long, target double, blocks long, quota long, fa long, fb long, shard_size long",
    )
    at = Window.partitionBy("skey", "shard").orderBy("h", "key", "size")
    d = d.withColumn("end", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(q, ["skey", "shard"], "left")
    start, n, b = F.col("end") - F.col("size"), F.col("shard_size"), F.col("blocks")
    passes = F.floor(F.col("quota") / F.greatest(n, F.lit(1))).cast("int")
    rest = F.col("quota") - passes * n
    whole = F.least(F.floor(rest / block), b)  # blocks that are taken once more, then one in part (of the rest behind the blocks, if all are)
    part = rest - whole * block

    def spans_of(k: Column) -> Column:
        """The block's first words, which are taken once more, and its others."""
        turn = F.when(b > 0, F.pmod(k * F.col("fa") + F.col("fb"), F.greatest(b, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        turn = F.when(k < b, turn).otherwise(b)
        more = F.when(turn < whole, F.lit(block).cast("long")).when(turn == whole, part).otherwise(F.lit(0).cast("long"))
        first, last = k * block, F.when(k < b, (k + 1) * block).otherwise(n)

        def span(lo: Column, hi: Column, times: Column) -> Column:
            return F.struct((F.greatest(lo, start) - start).cast("long").alias("first"), (F.least(hi, F.col("end")) - start).cast("long").alias("end"), times.cast("int").alias("times"))

        return F.array(span(first, F.least(first + more, last), passes + 1), span(F.least(first + more, last), last, passes))

    # tokens behind the whole blocks are the block of number ``blocks``
    k0 = F.least(F.floor(start / block), b).cast("long")
    k1 = F.least(F.floor((F.col("end") - 1) / block), b).cast("long")
    spans = F.filter(F.flatten(F.transform(F.sequence(k0, k1), spans_of)), lambda s: (s["times"] > 0) & (s["first"] < s["end"]))
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("times", T.IntegerType())])))
    return d.select("key", "size", "source", "source_size", "target", F.when(F.col("size") > 0, spans).otherwise(none).alias("spans"), *(["carry"] if carry else []))


def taken(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]) * s["times"])


_WORD = re.compile(WORD)


def cut(text: str, spans: list[dict], size: int, cap: int = 2) -> list[str]:
    """One text for each time round that takes any of the words; a whole text stays as it is."""
    out, starts = [], None
    for turn in range(1, cap + 1):
        runs: list[list[int]] = []
        for s in spans:
            if s["times"] >= turn:
                if runs and runs[-1][1] == s["first"]:
                    runs[-1][1] = s["end"]
                else:
                    runs.append([s["first"], s["end"]])
        if not runs:
            break
        if runs == [[0, size]]:
            out.append(text)
            continue
        if starts is None:
            starts = [m.span() for m in _WORD.finditer(text)]
        out.append("\n".join(text[starts[a][0] : starts[b - 1][1]] for a, b in runs))
    return out


def mixed(docs: DataFrame, key: str, text: str, source: str, length: str | None = None, **how) -> DataFrame:
    """The mix as rows of ``docs``: a row for each time round, with the words taken; ``length`` follows the text.

    All columns of ``docs`` are kept, whatever their names.
    """
    names = docs.columns
    size = fresh(names, "size")[0]
    sized = docs.withColumn(size, token_count(F.col(text)))
    m = mix(sized, key, size, source, carry=names, **how).select("size", "spans", "carry").filter(F.size("spans") > 0)
    schema, cap = docs.schema, how.get("cap", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("carry")
            cols = dict(zip(names, rows.flatten(), strict=True))
            texts, at = [], []
            for i, (t, s, n) in enumerate(zip(cols[text].to_pylist(), b.column("spans").to_pylist(), b.column("size").to_pylist(), strict=True)):
                own = cut(t, s, n, cap)
                texts += own
                at += [i] * len(own)
            take = pa.array(at, pa.int64())
            out = {c: v.take(take) for c, v in cols.items() if c != text}
            out[text] = pa.array(texts, cols[text].type)
            if length:
                out[length] = pa.array([len(t) for t in texts], cols[length].type)
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return m.mapInArrow(lean(run), schema)
