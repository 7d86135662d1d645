"""Intervals (chrom, start, end), 0-based half-open: merge, overlap joins by bucket, fetch, validation, imputation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import canonical_chrom
from ..functions.shared import fresh, literal


#: Positions of a tile in which intervals are ordered.
TILE = 1 << 20


def merge_bed(iv: DataFrame, by: tuple[str, ...] = ("chrom",), tile: int = TILE) -> DataFrame:
    """Overlapping and book-ended intervals become one.

    Intervals are ordered within tiles of their start. What reaches into a tile from before it, the furthest end and the
    start of the open block, is carried over from the tiles' summaries (a row a tile), so a crowded chrom is many tasks.
    """
    d = iv.select(*by, "start", "end").withColumn("tile", F.floor(F.col("start") / tile).cast("long"))
    along = Window.partitionBy(*by).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "tile"]
    reach = d.groupBy(*keys).agg(F.max("end").alias("top")).withColumn("far", F.max("top").over(along)).drop("top")
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.join(reach, keys).withColumn("reach", F.greatest("far", before))  # greatest skips nulls
    d = d.withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start")))
    last = d.groupBy(*keys).agg(F.max("opens").alias("m")).withColumn("open_before", F.last("m", ignorenulls=True).over(along)).drop("m")
    own = F.last("opens", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("own", own).join(last, keys).withColumn("block", F.coalesce("own", "open_before"))
    return d.groupBy(*by, "block").agg(F.max("end").alias("end"), F.count("*").alias("n")).withColumnRenamed("block", "start").select(*by, "start", "end", "n")


#: Rows of one side in a slice of an overlap join from which it is split, in multiples of the mean.
DENSE = 2


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", slices: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals of the same chrom, with the clipped overlap (o_start, o_end).

    Each chrom is cut where equal shares of all starts lie, so a crowded place is many slices and an empty one none. An
    interval stands in every slice it touches (``slices`` at most, by default as many as shuffle partitions), and a pair is kept in the slice where its overlap begins,
    which is the later of the two first slices. A slice that holds more than ``DENSE`` times the mean of a's rows all the same
    (equal starts, or many that reach across) is dealt: its rows of a to several parts, those of b to each of them.

    Columns of b get the prefix b_. ``left_semi`` and ``left_anti`` keep rows of a. Columns of a may have any name; a null
    start or end overlaps nothing. Rows are dealt by a hash of all their columns, so rows that agree in all of them stay together.
    """
    if how in ("left_semi", "left_anti"):
        place = ["chrom", "start", "end"]  # all that an overlap hangs on
        return a.join(overlap_join(a.select(*place).distinct(), b, slices=slices).select(*place).distinct(), place, how).select(*a.columns)
    made = ["o_start", "o_end"]
    key, cuts, at, low, low_b, at_b, deal, deal_b, n, many = fresh([*a.columns, *(f"b_{c}" for c in b.columns), *made], "key", "cuts", "slice", "low", "low_b", "slice_b", "deal", "deal_b", "n", "many")
    spark = a.sparkSession
    slices = max(2, slices or int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = a.select("chrom", "start", F.lit(1).alias(n)).unionByName(b.select("chrom", "start", F.lit(0).alias(n))).filter("chrom IS NOT NULL AND start IS NOT NULL")
    every = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    edges = starts.groupBy("chrom").agg(F.array_distinct(F.percentile_approx("start", every, 10 * slices)).alias(cuts), F.sum(n).alias(n)).collect()  # a row a chrom
    rows, mean = [(r["chrom"], r[cuts]) for r in edges], sum(r[n] for r in edges) / max(1, sum(len(r[cuts]) + 1 for r in edges))
    edges = F.broadcast(literal(spark, rows, f"{key} {a.schema['chrom'].dataType.simpleString()}, {cuts} array<bigint>"))

    def dealt(iv: DataFrame, first: str) -> DataFrame:
        place = lambda x: F.size(F.filter(cuts, lambda c: c <= x))
        last = F.greatest(F.col("start"), F.col("end") - 1)
        d = iv.filter("start IS NOT NULL AND `end` IS NOT NULL").join(edges, F.col("chrom") == F.col(key)).drop(key).withColumn(first, place(F.col("start")))
        return d.withColumn(at, F.explode(F.sequence(F.col(first), F.greatest(F.col(first), place(last))))).drop(cuts)

    left, right = dealt(a, low), dealt(b, low_b)
    full = left.groupBy("chrom", at).agg(F.count("*").alias(n)).filter(F.col(n) > DENSE * max(1.0, mean)).collect()  # 1/DENSE of the slices, and those that many reach across
    parts = [(r["chrom"], r[at], math.ceil(r[n] / (DENSE * max(1.0, mean)))) for r in full]
    if parts:
        load = F.broadcast(literal(spark, parts, f"chrom {a.schema['chrom'].dataType.simpleString()}, {at} int, {many} int"))
        left = left.join(load, ["chrom", at], "left").withColumn(deal, F.coalesce(F.pmod(F.xxhash64(*a.columns), F.col(many)), F.lit(0)).cast("int")).drop(many)
        right = right.join(load, ["chrom", at], "left").withColumn(deal, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(many), F.lit(1)) - 1))).drop(many)
    else:
        left, right = left.withColumn(deal, F.lit(0)), right.withColumn(deal, F.lit(0))
    right = right.select(*(F.col(c).alias(f"b_{c}") for c in b.columns if c != "chrom"), F.col("chrom").alias(key), F.col(at).alias(at_b), F.col(deal).alias(deal_b), low_b)
    j = left.join(right, (F.col("chrom") == F.col(key)) & (F.col(at) == F.col(at_b)) & (F.col(deal) == F.col(deal_b)))
    lo, hi = F.greatest("start", "b_start"), F.least("end", "b_end")
    j = j.filter((lo < hi) & (F.col(at) == F.greatest(low, low_b))).withColumn("o_start", lo).withColumn("o_end", hi)
    return j.select(*a.columns, *(f"b_{c}" for c in b.columns if c != "chrom"), *made)


def validate(iv: DataFrame) -> DataFrame:
    """Whether a row is a usable interval, and why not."""
    reason = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "not-integer").when(~canonical_chrom("chrom"), "chrom").when(F.col("start") < 0, "negative").when(F.col("end") <= F.col("start"), "empty")
    )
    return iv.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def clamp(iv: DataFrame, length: Column) -> DataFrame:
    """cut to the reference's length; what is then empty goes."""
    return iv.withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least(F.col("end"), length)).filter("end > start")


def chunked(seqs: DataFrame, size: int) -> DataFrame:
    """(chrom, seq) as rows (chrom, chunk_id, seq) of ``size`` letters."""
    n = F.length("seq")
    ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long")))
    return seqs.select("chrom", "seq", F.explode(ids).alias("chunk_id")).select("chrom", "chunk_id", F.expr(f"substring(seq, cast(chunk_id * {size} + 1 as int), {size})").alias("seq"))


def fetch(iv: DataFrame, chunks: DataFrame, size: int, key: list[str]) -> DataFrame:
    """The letters of each interval, joined on (chrom, chunk_id) and put together in order.

    ``key`` names columns that tell the intervals apart. Intervals beyond the reference give no row.
    """
    q = iv.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long"))))
    base = F.col("chunk_id") * size
    j = q.join(chunks, ["chrom", "chunk_id"]).withColumn("from", F.greatest(F.col("start") - base, F.lit(0))).withColumn("to", F.least(F.col("end") - base, F.lit(size)))
    piece = F.expr("substring(seq, cast(`from` + 1 as int), cast(`to` - `from` as int))")
    g = j.groupBy(*key, "chrom", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", piece.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    return g.filter(F.length("seq") == F.col("end") - F.col("start"))


def nearest_impute(points: DataFrame, by: str = "chrom", pos: str = "pos", value: str = "value", tile: int = TILE) -> DataFrame:
    """Missing values take the nearest known one by position, the lower on ties; edges beyond the known stay missing.

    Points are ordered within tiles of their position; the nearest known points before and behind a tile come from the
    tiles' summaries (a row a tile), so a long track is many tasks.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))
    d = points.withColumn("__tile", F.floor(F.col(pos) / tile).cast("long")).withColumn("__known", known)
    along = Window.partitionBy(by).orderBy("__tile")
    ends = d.groupBy(by, "__tile").agg(F.min("__known").alias("low"), F.max("__known").alias("high"))
    ends = ends.select(
        by, "__tile", F.last("high", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("low", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__behind")
    )
    w = Window.partitionBy(by, "__tile").orderBy(pos)
    back = F.coalesce(F.last("__known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    ahead = F.coalesce(F.first("__known", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("__behind"))
    d = d.join(ends, [by, "__tile"]).withColumn("__back", back).withColumn("__ahead", ahead)
    nearer = F.when(F.col("__back").isNull() | F.col("__ahead").isNull(), F.lit(None)).when(F.col(pos) - F.col("__back.p") <= F.col("__ahead.p") - F.col(pos), F.col("__back.v")).otherwise(F.col("__ahead.v"))
    return d.withColumn("imputed", F.coalesce(F.col(value), nearer)).select(*points.columns, "imputed")
