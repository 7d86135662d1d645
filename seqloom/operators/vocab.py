"""Vocabularies (pool, token, id): partition by membership, priority merge, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import salted

#: Special tokens by id, and the order in which missing ones are appended (fixed values of the file formats).
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
ESSENTIALS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
BASES = ["A", "T", "C", "G", "N"]
C, N, A = 1, 2, 4  # bits of the pools: conserved, neutral, accelerated


def partition(vocab: DataFrame, c: str = "c", n: str = "n", a: str = "a") -> DataFrame:
    """Each token with the set of pools that have it (bits) and its id in the neutral pool."""
    bit = F.when(F.col("pool") == c, C).when(F.col("pool") == n, N).when(F.col("pool") == a, A)
    return vocab.groupBy("token").agg(F.bit_or(bit).alias("mask"), F.min(F.when(F.col("pool") == n, F.col("id"))).alias("neutral_id"))


def tier(mask: Column) -> Column:
    """All three, conserved only, conserved and neutral, neutral only; others are dropped (null)."""
    return F.when(mask == C | N | A, 1).when(mask == C, 2).when(mask == C | N, 3).when(mask == N, 4)


def priority_merge(parts: DataFrame, capacity: int) -> DataFrame:
    """Tokens by tier (neutral-only ones by their id, others by token), cut at the capacity."""
    t = parts.withColumn("tier", tier(F.col("mask"))).filter("tier IS NOT NULL")
    key = F.when(F.col("tier") == 4, F.col("neutral_id"))
    w = Window.orderBy("tier", F.coalesce(key, F.lit(0)), "token")  # vocabulary-sized, after aggregation
    return t.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < capacity).select("token", "tier", "rank")


def random_merge(parts: DataFrame, capacity: int, salt: str = "42") -> DataFrame:
    """The union of the pools in a salted order."""
    w = Window.orderBy(salted("token", salt), "token")
    return parts.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < capacity).select("token", "rank")


def with_essentials(ranked: DataFrame, capacity: int) -> DataFrame:
    """U8: special tokens and bases are added behind where missing, in the order of ``ESSENTIALS``, then the capacity applies again."""
    spark = ranked.sparkSession
    extra = spark.createDataFrame([(t, i) for i, t in enumerate(ESSENTIALS + BASES)], "token string, ord int").join(ranked, "token", "left_anti")
    both = ranked.select("token", F.lit(0).alias("g"), F.col("rank").alias("o")).unionByName(extra.select("token", F.lit(1).alias("g"), F.col("ord").cast("long").alias("o")))
    w = Window.orderBy("g", "o")
    return both.withColumn("id", (F.row_number().over(w) - 1).cast("long")).filter(F.col("id") < capacity).select("token", "id")


def score(kind: str, token: Column | str = "token") -> Column:
    """len2 (length squared), length, or uniform."""
    n = F.length(token).cast("double")
    return {"len2": n * n, "length": n, "uniform": F.lit(1.0)}[kind]


def jaccard_pairs(vocab: DataFrame) -> DataFrame:
    """Sizes of intersection and union of each pair of pools, a before b by name."""
    sizes = vocab.groupBy("pool").agg(F.countDistinct("token").alias("n"))
    met = vocab.select(F.col("pool").alias("pool_a"), "token").distinct().join(vocab.select(F.col("pool").alias("pool_b"), "token").distinct(), "token").filter("pool_a < pool_b").groupBy("pool_a", "pool_b").agg(F.count("*").alias("m"))
    pairs = sizes.select(F.col("pool").alias("pool_a"), F.col("n").alias("na")).join(sizes.select(F.col("pool").alias("pool_b"), F.col("n").alias("nb")), F.col("pool_a") < F.col("pool_b"))  # a row a pool
    j = pairs.join(met, ["pool_a", "pool_b"], "left")
    i = F.coalesce("m", F.lit(0))
    u = F.col("na") + F.col("nb") - i
    return j.select("pool_a", "pool_b", i.alias("intersection"), u.alias("union"), F.when(u > 0, F.round(i / u, 4)).otherwise(0.0).alias("jaccard"))


def vocab_sizes(text: str, allowed: tuple[str, ...]) -> list[str]:
    """a comma list of vocabulary sizes; others than the allowed ones are an error."""
    sizes = [v.strip() for v in text.split(",") if v.strip()]
    bad = [v for v in sizes if v not in allowed]
    if bad:
        raise ValueError(f"vocabulary sizes {bad} are not among {sorted(allowed)}")
    return sizes


def with_suffix(names: list[str], suffixes: list[str]) -> list[str]:
    """the names that end in one of the suffixes; none is an error."""
    out = [n for n in names if n.endswith(tuple(suffixes))]
    if not out:
        raise ValueError(f"no name ends in {suffixes}")
    return out


def configurations(spark: SparkSession, names: list[str]) -> DataFrame:
    """(config, model, size) of names as model_size."""
    return spark.createDataFrame([(n, *n.rsplit("_", 1)) for n in names], "config string, model string, size string").withColumn("size", F.col("size").cast("long"))


def sweep(config: DataFrame, ranked: DataFrame, counts: DataFrame) -> DataFrame:
    """Per configuration and region the tokens and occurrences that the vocabulary of that model and size has, as keys of one plan.

    ``ranked`` (model, token, id), ``counts`` (region, token, cnt).
    """
    total = counts.groupBy("region").agg(F.sum("cnt").alias("total"))
    j = F.broadcast(config).join(ranked, "model").filter("id < size").select("config", "token").join(counts, "token")  # a row a configuration
    g = j.groupBy("config", "region").agg(F.count("*").alias("n_tokens"), F.sum("cnt").alias("n_met"), F.max_by("token", F.struct("cnt", "token")).alias("top_token"))
    return g.join(F.broadcast(total), "region").select("config", "region", "n_tokens", "n_met", (F.col("n_met") / F.col("total")).alias("share"), "top_token")
