"""Corpora for training: windows, packing, splits, samples, label ids, padding, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import salted
from ..functions.shared import fresh, written


def count_windows(tokens: Column, size: int) -> Column:
    """Consecutive windows of ``size`` tokens, the rest dropped."""
    n = F.floor(F.size(tokens) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def n_share(window: Column) -> Column:
    """share of the tokens that contain an N."""
    return F.size(F.filter(window, lambda t: F.contains(t, F.lit("N")))) / F.size(window)


def pack(df: DataFrame, order: str, tokens: str, size: int, batch: int = 1000) -> DataFrame:
    """Tokens of each run of ``batch`` rows joined in order and cut into blocks of ``size``; a run's rest is dropped.

    Rows are numbered by range partitions, so no task sorts the table; each row is cut where its blocks end, so a block gathers a few slices.
    Empty and null rows count among the rows of a run, and give no token.
    """
    r = numbered(df.select(F.col(order).alias("__o"), F.col(tokens).alias("t")), "__o")
    g = r.withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("long")).withColumn("n", F.when(F.col("t").isNull(), 0).otherwise(F.size("t")).cast("long"))
    w = Window.partitionBy("batch").orderBy("rank")
    g = g.withColumn("off", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).filter("n > 0")
    off, n = F.col("off"), F.col("n")

    def part(b: Column) -> Column:
        lo, hi = F.greatest(b * size - off, F.lit(0)), F.least((b + 1) * size - off, n)
        return F.struct(b.alias("block"), (off + lo).alias("at"), F.slice("t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    first, last = F.floor(off / size).cast("long"), F.floor((off + n - 1) / size).cast("long")
    e = g.select("batch", F.inline(F.transform(F.sequence(first, last), part)))
    b = e.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x"))
    b = b.select("batch", "block", F.flatten(F.transform("x", lambda s: s["part"])).alias("tokens"))
    return b.filter(F.size("tokens") == size)


def numbered(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Global row numbers from 1 in an order, by range partitions and their offsets (a row a partition); columns of any name are kept."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    part, n, off, *keys = fresh([*df.columns, name], "part", "n", "off", *(f"o{i}" for i in range(len(cols))))
    r = df.withColumns(dict(zip(keys, cols, strict=True)))
    r = written(r.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "numbered")
    offs = r.groupBy(part).agg(F.count("*").alias(n)).select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(off))
    w = Window.partitionBy(part).orderBy(*keys)
    return r.join(F.broadcast(offs), part).withColumn(name, F.row_number().over(w) + F.col(off)).drop(part, off, *keys)


def split(df: DataFrame, key: str, train: float, val: float, salt: str = "42") -> DataFrame:
    """Exact sizes floor(n*r), the rest is test; order by salted hash."""
    n = df.count()
    r = numbered(df, salted(key, salt), key)
    a, b = int(n * train), int(n * val)
    return r.withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test")).drop("rank")


def head_split(df: DataFrame, order: str, pct: int = 5) -> DataFrame:
    """Validation is the first pct percent in an explicit order."""
    n = df.count()
    return numbered(df, order).withColumn("split", F.when(F.col("rank") <= n * pct // 100, "validation").otherwise("train")).drop("rank")


def sample_k(df: DataFrame, key: str, k: int, salt: str = "42") -> DataFrame:
    """K rows, uniform, the same in any partitioning (a top-k, so no full sort)."""
    return df.orderBy(salted(key, salt), key).limit(k)


def balanced(df: DataFrame, label: str, key: str, salt: str = "42") -> DataFrame:
    """Every class cut to the smallest, by salted hash; ranks by (class, salt slice), so that no class is one task."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    h = salted(key, salt)
    slices = F.substring(h, 1, 2)
    d = df.withColumn("__h", h).withColumn("__s", slices)
    per = d.groupBy(label, "__s").agg(F.count("*").alias("n"))
    before = per.withColumn("off", F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(label, "__s", "off")  # 256 slices a class
    r = d.join(before, [label, "__s"]).withColumn("__r", F.row_number().over(Window.partitionBy(label, "__s").orderBy("__h", key)) + F.col("off"))
    return r.filter(F.col("__r") <= least).drop("__h", "__s", "__r", "off")


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """id = rank among the sorted distinct labels (a bounded dimension), joined back."""
    ids = df.select(label).distinct().withColumn("label_id", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(ids, label)


def pad(ids: Column, size: int, pad_id: int) -> Column:
    """Cut to ``size`` and filled up."""
    return F.concat(F.slice(ids, 1, size), F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(size) - F.size(ids))))


def attention(ids: Column, pad_id: int) -> Column:
    """1 where the id is not padding."""
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def mask(ids: Column, key: Column, mask_id: int, vocab: int, special: list[int], rate: float = 0.15, salt: str = "42") -> Column:
    """Struct of masked ids and labels; 15 % chosen by md5 of (key, position), of them 80 % mask, 10 % random, 10 % kept; -100 elsewhere."""

    def below(h: Column, at: int, share: float) -> Column:  # 28 bits of the place's md5, as hexadecimal digits
        return F.substring(h, at, 7) < f"{int(share * (1 << 28)):07x}"

    def one(x: Column, h: Column) -> Column:
        hit = below(h, 1, rate) & ~x.isin(*special)
        drawn = (F.conv(F.substring(h, 15, 7), 16, 10).cast("long") % vocab).cast("int")
        new = F.when(below(h, 8, 0.8), F.lit(mask_id)).when(below(h, 8, 0.9), drawn).otherwise(x)
        return F.struct(F.when(hit, new).otherwise(x).alias("id"), F.when(hit, x).otherwise(F.lit(-100)).alias("label"))

    hashes = F.transform(ids, lambda x, i: F.md5(F.concat_ws(":", F.lit(salt), key.cast("string"), i.cast("string"))))
    return F.zip_with(ids, hashes, one)
