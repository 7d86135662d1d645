"""Token statistics: counts, enrichment, shuffled background, distances, agreement and classification metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import normal_p, not_nan
from ..functions.shared import fresh, written
from .selection import beside, medians


def token_counts(tokens: DataFrame, by: list[str], token: str = "token") -> DataFrame:
    """Occurrences of each token within each set."""
    return tokens.groupBy(*by, F.col(token).alias("token")).agg(F.count("*").alias("cnt"))


_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)  # A, C, G, T
#: Sets whose counts a worker holds before it sends them on.
SETS_AT_ONCE = 256


def _letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its rows' offsets; nulls are empty."""
    c = pc.fill_null(col.cast(pa.binary()), b"")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(c).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8), ends


def _windows(code: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer at each place as a number in base 4, whether it lies in one row and has only A, C, G and T)."""
    n = max(0, len(code) - k + 1)
    x, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        x = x * 4 + code[j : j + n]
        ok &= code[j : j + n] < 4
    cuts = ends[(ends > 0) & (ends < len(code))]
    for j in range(1, k):
        at = cuts - j
        ok[at[(at >= 0) & (at < n)]] = False
    return x, ok


def _spelled(k: int) -> list[str]:
    return ["".join(t) for t in product("ACGT", repeat=k)]


def kmer_counts(df: DataFrame, by: list[str], seq: str, ks: list[int]) -> DataFrame:
    """(by..., token, cnt) of the overlapping k-mers of A, C, G and T, for each k up to 12.

    A worker counts whole buffers and sends a row a (set, token), so what is shuffled follows the sets and not the text.
    Windows with another letter, and those that would span rows, count nowhere; null sequences are empty.
    """
    if max(ks) > 12:
        raise ValueError("k-mers beyond 12 letters are not counted densely")
    kinds = [df.schema[c] for c in by]
    base = np.concatenate([[0], np.cumsum([4**k for k in ks])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array([t for k in ks for t in _spelled(k)], dtype=object)
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, n in held.items():
                on = np.flatnonzero(n)
                cols = [pa.array([v] * len(on), b_type) for v, b_type in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(tokens[on], pa.string()), pa.array(n[on])], [*by, "token", "cnt"])
            held.clear()

        for b in batches:
            types = [b.column(i).type for i in range(len(by))]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * len(b)
            number: dict[tuple, int] = {}
            group = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
            data, ends = _letters(b.column(len(by)))
            code = _CODE[data]
            own = np.repeat(group, np.diff(ends))
            for key in number:
                held.setdefault(key, np.zeros(base[-1], np.int64))
            for k, lo, hi in zip(ks, base[:-1], base[1:], strict=True):
                x, ok = _windows(code, ends, k)
                n = np.bincount(own[: len(x)][ok] * 4**k + x[ok], minlength=len(number) * 4**k).reshape(-1, 4**k)
                for key, g in number.items():
                    held[key][lo:hi] += n[g]
            if len(held) > SETS_AT_ONCE:
                yield from out()
        if held:
            yield from out()

    schema = T.StructType([*kinds, T.StructField("token", T.StringType()), T.StructField("cnt", T.LongType())])
    return df.select(*by, F.col(seq).alias("__seq")).mapInArrow(run, schema).groupBy(*by, "token").agg(F.sum("cnt").alias("cnt"))


def two_sets(counts: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Counts of two sets side by side, absent tokens 0, in one aggregation; totals on each row."""
    d = counts.filter(F.col(key).isin(a, b)).groupBy("token").agg(F.sum(F.when(F.col(key) == a, F.col("cnt")).otherwise(0)).alias("na"), F.sum(F.when(F.col(key) == b, F.col("cnt")).otherwise(0)).alias("nb"))
    t = counts.agg(F.sum(F.when(F.col(key) == a, F.col("cnt"))).alias("ta"), F.sum(F.when(F.col(key) == b, F.col("cnt"))).alias("tb"))
    return d.crossJoin(F.broadcast(t))  # one row of totals


def enrichment(counts: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """log2 ratio with half counts, pooled z, its two-sided p, and the richer side."""
    d = two_sets(counts, key, a, b)
    fa, fb = F.col("na") / F.col("ta"), F.col("nb") / F.col("tb")
    lfc = F.log2((fa + 0.5 / F.col("ta")) / (fb + 0.5 / F.col("tb")))
    pool = (F.col("na") + F.col("nb")) / (F.col("ta") + F.col("tb"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("ta") + 1 / F.col("tb")))
    z = F.when(se > 0, (fa - fb) / se).otherwise(0.0)
    return d.select("token", "na", "nb", fa.alias("freq_a"), fb.alias("freq_b"), lfc.alias("log2fc"), z.alias("z")).withColumn("p_value", normal_p("z")).withColumn("side", F.when(F.col("log2fc") > 0, a).when(F.col("log2fc") < 0, b).otherwise("equal"))


def bh(df: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q, stable on ties by ``key``."""
    parts = by or []
    w = Window.partitionBy(*parts).orderBy(p, key)
    n = F.count("*").over(Window.partitionBy(*parts))
    d = df.withColumn("__rank", F.row_number().over(w)).withColumn("__raw", F.col(p) * n / F.col("__rank"))
    down = Window.partitionBy(*parts).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__rank", "__raw")


def bh_large(df: DataFrame, p: str, key: str) -> DataFrame:
    """W5 for tables that no task should sort alone: ranks from range partitions, the running minimum carried between them.

    All columns are kept, whatever their names; ``q`` is added.
    """
    part, n, off, total, rank, raw, low, later = fresh([*df.columns, "q"], "part", "n", "off", "total", "rank", "raw", "low", "later")
    r = written(df.repartitionByRange(p, key).withColumn(part, F.spark_partition_id()), "ranks")
    sizes = r.groupBy(part).agg(F.count("*").alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offs = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off), F.sum(n).over(Window.partitionBy()).alias(total))
    w = Window.partitionBy(part).orderBy(p, key)
    d = r.join(F.broadcast(offs), part).withColumn(rank, F.row_number().over(w) + F.col(off)).withColumn(raw, F.col(p) * F.col(total) / F.col(rank))
    lows = d.groupBy(part).agg(F.min(raw).alias(low)).select(part, F.min(low).over(Window.orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)).alias(later))
    down = Window.partitionBy(part).orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(raw).over(down), F.col(later))
    return d.join(F.broadcast(lows), part).withColumn("q", q).select(*(c for c in df.columns if c != "q"), "q")


def enriched(counts: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Enrichment with the false-discovery rate, by it and the token."""
    return bh(enrichment(counts, key, a, b), "p_value", "token").withColumnRenamed("q", "fdr_bh").orderBy("fdr_bh", "token")


def volcano(counts: DataFrame, key: str, merged: str, baseline: str) -> DataFrame:
    """Enrichment with p, q and -log10(q), by q, then the larger effect, then the token."""
    d = bh(enrichment(counts, key, merged, baseline), "p_value", "token").withColumnRenamed("q", "fdr_bh")
    return d.withColumn("neglog10_fdr", -F.log10(F.greatest("fdr_bh", F.lit(1e-300)))).orderBy("fdr_bh", -F.abs("log2fc"), "token")


def top_labels(rows: DataFrame, n: int = 15, most: float = 0.05) -> DataFrame:
    """The first ``n`` significant rows of a volcano table."""
    return rows.filter(F.col("fdr_bh") <= most).orderBy("fdr_bh", -F.abs("log2fc"), "token").limit(n)


def mean_log2fc(cells: DataFrame, background: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean of log2 ratios over the union vocabulary of each cell and the background, (c+.5)/(N+.5V)."""
    totals = cells.groupBy(*by).agg(F.sum("cnt").alias("nc"))
    bg = background.select("token", F.col("cnt").alias("bc"))
    bn = background.agg(F.sum("cnt").alias("nb"), F.count("*").alias("vb"))
    own = cells.select(*by, "token", "cnt").join(bg, "token", "left")
    per = own.groupBy(*by).agg(F.sum(F.col("bc").isNull().cast("long")).alias("only"), F.sum(F.log2(F.col("cnt") + 0.5) - F.log2(F.coalesce("bc", F.lit(0)) + 0.5)).alias("s"), F.sum(F.when(F.col("bc").isNotNull(), F.log2(F.col("bc") + 0.5)).otherwise(0.0)).alias("met"))
    whole = background.agg(F.sum(F.log2(F.col("cnt") + 0.5)).alias("all_bg"))
    j = per.join(totals, by).crossJoin(F.broadcast(bn)).crossJoin(F.broadcast(whole))  # one row each
    v = F.col("only") + F.col("vb")
    # background tokens that the cell lacks: log2(.5) - log2(bc + .5)
    lack = F.col("vb") - (F.col("own") - F.col("only"))
    j = j.join(own.groupBy(*by).agg(F.count("*").alias("own")), by)
    s = F.col("s") + lack * F.log2(F.lit(0.5)) - (F.col("all_bg") - F.col("met"))
    return j.select(*by, (s / v + F.log2((F.greatest("nb", F.lit(1)) + 0.5 * v) / (F.greatest("nc", F.lit(1)) + 0.5 * v))).alias("mean_log2fc"))


def importance(observed: DataFrame, replicates: DataFrame, k: int) -> DataFrame:
    """Observed counts against K shuffled replicates; absent replicates count as zero.

    ``observed`` (token, cnt), ``replicates`` (rep, token, cnt). Squares of counts are exact decimals: those of their sums leave 64 bits at a few gigabytes.
    """
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    t_obs = observed.agg(F.sum("cnt").alias("t"))
    t_bg = replicates.groupBy("rep").agg(F.sum("cnt").alias("tr"))
    mean_t = t_bg.agg((F.sum("tr") / k).alias("tb"))
    o = observed.withColumnRenamed("cnt", "n").crossJoin(F.broadcast(t_obs)).withColumn("f", F.col("n") / F.col("t"))
    r = replicates.join(F.broadcast(t_bg), "rep").withColumn("fr", F.col("cnt") / F.col("tr"))  # a row a replicate
    j = r.join(o.select("token", "f"), "token", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    b = j.groupBy("token").agg(
        F.sum("cnt").alias("sc"), F.sum(exact("cnt") * exact("cnt")).alias("sc2"), F.sum("fr").alias("sf"), F.sum(F.col("fr") * F.col("fr")).alias("sf2"), F.count("*").alias("rows"),
        F.sum((F.col("fr") >= F.col("f")).cast("long")).alias("ge"),
    )
    d = o.select("token", "n", "f").join(b, "token", "full_outer").na.fill(0).crossJoin(F.broadcast(t_obs)).crossJoin(F.broadcast(mean_t))
    sd = lambda square: F.sqrt(F.greatest(F.lit(0.0), square.cast("double") / (k * (k - 1)))) if k > 1 else F.lit(0.0)
    ge = F.col("ge") + F.when(F.col("f") == 0, k - F.col("rows")).otherwise(0)
    sdc, sdf = sd(k * F.col("sc2") - exact("sc") * exact("sc")), sd(k * F.col("sf2") - F.col("sf") * F.col("sf"))
    lfc = F.log2((F.col("f") + 0.5 / F.col("t")) / (F.col("sf") / k + 0.5 / F.greatest(F.lit(1.0), F.col("tb"))))
    d = d.select(
        "token", F.col("n").alias("count_observed"), (F.col("sc") / k).alias("count_bg_mean"), sdc.alias("count_bg_sd"), F.col("f").alias("freq_observed"), (F.col("sf") / k).alias("freq_bg_mean"),
        sdf.alias("freq_bg_sd"), lfc.alias("log2_enrichment"), F.when(sdf > 0, (F.col("f") - F.col("sf") / k) / sdf).otherwise(0.0).alias("z"), ((ge + 1) / (k + 1)).alias("p_ge"),
    )
    d = bh(d, "p_ge", "token").withColumnRenamed("q", "fdr_bh")
    return d.withColumn("important", ((F.col("log2_enrichment") > 0) & (F.col("fdr_bh") <= 0.05)).cast("int"))


#: A prime below 2**31 that is not 1 modulo 3, so that cubes modulo it are all different (a fixed value).
PRIME = 2_147_483_579


def _factors(seed: int, rep: int, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below 2**28 for each key, from md5 of seed, replicate and key."""
    h = [hashlib.md5(f"{seed}:{rep}:{x}".encode()).hexdigest() for x in keys]
    return np.array([int(x[:7], 16) for x in h], np.int64), np.array([int(x[7:14], 16) + 1 for x in h], np.int64)


def _orders(ends: np.ndarray, seed: int, reps: int, keys: list[str]) -> Iterator[np.ndarray]:
    """For each replicate the order of all letters: within a row by the cube of place plus a, times b, modulo ``PRIME``; then by place."""
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    for rep in range(reps):
        a, b = _factors(seed, rep, keys)
        x = (place + a[row]) % PRIME
        x = x * x % PRIME * x % PRIME * b[row] % PRIME
        yield np.lexsort((x, row)) if len(size) >= 1 << 32 else np.argsort(row << 31 | x, kind="stable")


def shuffled(df: DataFrame, key: str, seq: str, k: int, seed: int = 0) -> DataFrame:
    """K letter-shuffled copies of each sequence, seeded by (seed, replicate, key); null sequences are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _letters(b.column(1))
            for rep, order in enumerate(_orders(ends, seed, k, b.column(0).to_pylist())):
                out = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[order]))])
                yield pa.RecordBatch.from_arrays([pa.array([rep] * len(b), pa.int32()), b.column(0), out.cast(pa.string())], ["rep", "key", "seq"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq")).mapInArrow(run, "rep int, key string, seq string")


#: Letters, of all replicates together, that are shuffled at a time: they stay in a core's cache. A longer row is taken a replicate at a time.
SHUFFLE_LETTERS = 1 << 15


class _Shuffles:
    """K-mers of rows in the orders of :func:`_orders`, counted by replicate.

    The cube of place plus a, times b, is a polynomial of the place: its powers are the same for all rows and replicates, so
    a letter costs three products and one remainder. Letters are packed behind it, so that one sort moves them.
    """

    def __init__(self, k: int, reps: int, seed: int) -> None:
        self.k, self.seed, self.n = k, seed, np.zeros((reps, 4**k), np.int64)
        self.powers = np.zeros((3, 0), np.uint64)

    def _powers(self, size: int) -> np.ndarray:
        if self.powers.shape[1] < size:
            i = np.arange(max(size, SHUFFLE_LETTERS), dtype=np.uint64) % np.uint64(PRIME)
            square = i * i % np.uint64(PRIME)
            made = np.stack([i, square, square * i % np.uint64(PRIME)])
            if size > 1 << 20:  # not kept
                return made
            self.powers = made
        return self.powers[:, :size]

    def add(self, code: np.ndarray, key: str) -> None:
        u, reps, size = np.uint64, len(self.n), len(code)
        if size < self.k:
            return
        p = u(PRIME)
        i, square, cube = self._powers(size)
        h = [hashlib.md5(f"{self.seed}:{rep}:{key}".encode()).hexdigest() for rep in range(reps)]  # as in _factors
        a, b = np.array([int(x[:7], 16) for x in h], u)[:, None], np.array([int(x[7:14], 16) + 1 for x in h], u)[:, None]
        c0, c1, c2 = a * a % p * a % p * b % p, u(3) * a * a % p * b % p, u(3) * a * b % p
        other, code, each = bool((code > 3).any()), code.astype(u), max(1, SHUFFLE_LETTERS // size)
        spare = np.empty((min(each, reps), size), u)
        for lo in range(0, reps, each):
            own = slice(lo, min(lo + each, reps))
            t = spare[: own.stop - lo]
            x = b[own] * cube
            x += np.multiply(c2[own], square, out=t)
            x += np.multiply(c1[own], i, out=t)
            x += c0[own]  # below 2**64: 2**28 and twice 2**31 times 2**31
            np.floor_divide(x, p, out=t)
            t *= p
            x -= t
            x <<= u(3)
            x |= code
            x.sort(axis=1)
            self._count(x, lo, other)

    def _count(self, x: np.ndarray, lo: int, other: bool) -> None:
        m, size = x.shape
        kind = np.uint8 if self.k <= 4 else np.uint16 if self.k <= 8 else np.uint32
        c = x.ravel().astype(kind)
        token, ok = c & kind(3), c & kind(4)
        code = token.copy()
        for j in range(1, self.k):  # windows over the end of a row are left out below
            token <<= kind(2)
            token[:-j] |= code[j:]
            if other:
                ok[:-j] |= c[j:] & kind(4)
        at = token.reshape(m, size)[:, : size - self.k + 1] + (np.arange(m) * 4**self.k)[:, None]
        at = at[ok.reshape(m, size)[:, : size - self.k + 1] == 0] if other else at.ravel()
        self.n[lo : lo + m] += np.bincount(at, minlength=m * 4**self.k).reshape(m, -1)


def shuffled_counts(df: DataFrame, key: str, seq: str, k: int, reps: int, seed: int = 0) -> DataFrame:
    """(rep, token, cnt) of the k-mers of :func:`shuffled` copies of sequences over A, C, G and T; no shuffled text leaves a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Shuffles(k, reps, seed)
        for b in batches:
            data, ends = _letters(b.column(1))
            code = _CODE[data]
            for i, key in enumerate(b.column(0).to_pylist()):
                got.add(code[ends[i] : ends[i + 1]], key)
        n = got.n
        rep, token = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int32)), pa.array(np.array(_spelled(k), dtype=object)[token], pa.string()), pa.array(n[rep, token])], ["rep", "token", "cnt"])

    d = df.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq"))
    return d.mapInArrow(run, "rep int, token string, cnt long").groupBy("rep", "token").agg(F.sum("cnt").alias("cnt"))


def js_divergence(p: list[Column], q: list[Column]) -> Column:
    """In bits; terms with a share of 0 or less are left out."""
    out = F.lit(0.0)
    for x, y in zip(p, q, strict=True):
        m = (x + y) / 2
        out = out + F.when((x > 0) & (m > 0), 0.5 * x * F.log2(x / m)).otherwise(0.0) + F.when((y > 0) & (m > 0), 0.5 * y * F.log2(y / m)).otherwise(0.0)
    return out


def js_distance(p: list[Column], q: list[Column], published: bool = False) -> Column:
    """Root of the divergence, which ``published`` rounds to 4 digits before."""
    d = js_divergence(p, q)
    return F.sqrt(F.round(d, 4) if published else F.greatest(d, F.lit(0.0)))


def length_bins(counts: DataFrame, by: list[str]) -> DataFrame:
    """A10: shares in percent of occurrences by token length 1-2, 3-5, 6-8, 9 and more; 0 without tokens."""
    n = F.length("token")
    total = F.sum("cnt")
    pct = lambda cond, name: F.when(total > 0, F.sum(F.when(cond, F.col("cnt")).otherwise(0)) * 100.0 / total).otherwise(0.0).alias(name)
    return counts.groupBy(*by).agg(pct(n <= 2, "pct_len1_2"), pct(n.between(3, 5), "pct_len3_5"), pct(n.between(6, 8), "pct_len6_8"), pct(n >= 9, "pct_len9plus"))


def entropy(counts: DataFrame, by: list[str], bases: DataFrame) -> DataFrame:
    """Bases per token, tokens per kilobase, Shannon entropy and its share of the maximum (1 for a single token)."""
    t = counts.groupBy(*by).agg(F.sum("cnt").alias("total_tokens"), F.count("*").alias("vocab_size_used"), F.sum(F.col("cnt") * F.log2("cnt")).alias("s"))
    n = F.col("total_tokens")
    h = F.log2(n) - F.col("s") / n
    j = t.join(bases, by)
    return j.select(*by, "total_tokens", "vocab_size_used", (F.col("bases") / n).alias("bp_per_token"), (n * 1000.0 / F.col("bases")).alias("tokens_per_kb"), h.alias("shannon_h_bits"), F.when(F.col("vocab_size_used") > 1, h / F.log2("vocab_size_used")).otherwise(1.0).alias("h_normalized"))


def token_profile(counts: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences, distinct tokens, mean and median length and GC over occurrences."""
    from ..functions.columns import gc_fraction

    d = counts.withColumn("len", F.length("token")).withColumn("gc", gc_fraction("token"))
    n = F.sum("cnt")
    return d.groupBy(*by).agg(n.alias("total_tokens"), F.count("*").alias("unique_tokens"), (F.sum(F.col("len") * F.col("cnt")) / n).alias("mean_len"), F.expr("percentile(len, 0.5, cnt)").alias("median_len"), (F.sum(F.col("gc") * F.col("cnt")) / n).alias("mean_gc"), F.expr("percentile(gc, 0.5, cnt)").alias("median_gc"))


def span_moments(occ: DataFrame, span: str) -> DataFrame:
    """Mean and variance (ddof 0) of the scores under a token; nulls and NaN are skipped, none left gives null."""

    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in col:
            n = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
            x = np.asarray(c.flatten().to_numpy(zero_copy_only=False), float)
            row = np.repeat(np.arange(len(c)), n)
            row, x = row[~np.isnan(x)], x[~np.isnan(x)]
            many = np.bincount(row, minlength=len(c))
            none = many == 0
            mean = np.bincount(row, x, len(c)) / np.maximum(many, 1)
            var = np.bincount(row, (x - mean[row]) ** 2, len(c)) / np.maximum(many, 1)
            yield pa.StructArray.from_arrays([pa.array(mean, mask=none), pa.array(var, mask=none)], ["mean_score", "var_score"])

    moments = F.arrow_udf(run, "mean_score double, var_score double")(F.col(span).cast("array<double>"))
    return occ.withColumn("__m", moments).withColumns({"mean_score": F.col("__m.mean_score"), "var_score": F.col("__m.var_score")}).drop("__m")


def score_profile(occ: DataFrame, by: list[str]) -> DataFrame:
    """Per token mean and median of the occurrences' mean and variance; NaN is skipped there, not in the count."""
    m, v = not_nan("mean_score"), not_nan("var_score")
    g = occ.groupBy(*by, "token").agg(F.avg(m).alias("mean_mean"), F.avg(v).alias("mean_var"), F.count("*").alias("count"))
    return beside(g, medians(occ, [*by, "token"], {"median_mean": m, "median_var": v}), [*by, "token"]).select(*by, "token", "mean_mean", "mean_var", "median_mean", "median_var", "count")


def tokenizer_summary(profile: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted over tokens."""
    pct = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100
    g = profile.groupBy(*by).agg(
        F.count("*").alias("num_tokens"), F.avg("mean_mean").alias("mean_of_mean"), F.avg("mean_var").alias("mean_of_var"),
        pct(F.col("mean_mean") > 0).alias("pct_mean_pos"), pct(F.col("mean_var") < 0.1).alias("pct_var_low"), F.avg("count").alias("mean_count"),
    )
    return beside(g, medians(profile, by, {"median_of_mean": F.col("mean_mean"), "median_of_var": F.col("mean_var"), "median_count": F.col("count")}), by)


def best_tokens(stats: DataFrame, by: list[str]) -> DataFrame:
    """Significant tokens of each side, and the one of least q (ties: larger effect, then token)."""
    return stats.groupBy(*by).agg(F.sum((F.col("q") <= 0.05).cast("long")).alias("n_significant"), F.min_by("token", F.struct("q", -F.abs("log2fc"), "token")).alias("best_token"))


def classification(preds: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1 (0 where undefined), multiclass MCC; label -100 is left out."""
    c = preds.filter((F.col(label) != -100) & F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("y"), F.col(pred).alias("h")).agg(F.count("*").alias("n"))
    t = c.groupBy("y").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("h"), F.col("n")).otherwise(0)).alias("hit"))
    p = c.groupBy("h").agg(F.sum("n").alias("p"))
    k = t.join(p, t["y"] == p["h"], "full_outer").select(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("hit", F.lit(0)).alias("hit"))
    prec = F.when(F.col("p") > 0, F.col("hit") / F.col("p")).otherwise(0.0)
    rec = F.when(F.col("t") > 0, F.col("hit") / F.col("t")).otherwise(0.0)
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("hit") / (F.col("t") + F.col("p"))).otherwise(0.0)
    s = F.sum("t").cast("double")
    a = k.agg(s.alias("s"), F.sum("hit").alias("c"), F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"), F.sum(F.col("t").cast("double") * F.col("t")).alias("tt"), F.sum(F.col("p").cast("double") * F.col("p")).alias("pp"), F.avg(prec).alias("precision"), F.avg(rec).alias("recall"), F.avg(f1).alias("f1"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return a.select((F.col("c") / F.col("s")).alias("accuracy"), "precision", "recall", "f1", F.when(den > 0, (F.col("c") * F.col("s") - F.col("tp")) / den).otherwise(0.0).alias("mcc"))


def masked_accuracy(preds: DataFrame, label: str, pred: str, loss: str) -> DataFrame:
    """Accuracy over unmasked labels and the perplexity of the mean loss (infinite on overflow)."""
    d = preds.filter(F.col(label) != -100)
    m = F.avg(loss)
    return d.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), F.when(m > 709, F.lit(float("inf"))).otherwise(F.exp(m)).alias("perplexity"), F.count("*").alias("n"))
