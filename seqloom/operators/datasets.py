"""Labelled datasets: peaks and label policies, file pairing, chat records, experiment manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chunks, label_from_name, parse_coord, slug, split_labels


def peak_rows(peaks: DataFrame) -> DataFrame:
    """Coordinates to 0-based half-open and labels to a list; rows without either are dropped."""
    p = peaks.withColumn("c", parse_coord("coord")).withColumn("labels", split_labels("labels"))
    return p.filter(F.col("c").isNotNull() & F.col("c.start").isNotNull() & (F.size("labels") > 0)).select("peak_id", F.col("c.chrom").alias("chrom"), (F.col("c.start") - 1).alias("start"), F.col("c.end").alias("end"), "labels")


def expand_labels(peaks: DataFrame, policy: str = "explode") -> DataFrame:
    """drop (single labels only), first, or one row per label."""
    if policy == "drop":
        return peaks.filter(F.size("labels") == 1).withColumn("label", F.element_at("labels", 1)).drop("labels")
    if policy == "first":
        return peaks.withColumn("label", F.element_at("labels", 1)).drop("labels")
    if policy != "explode":
        raise ValueError(policy)
    return peaks.withColumn("label", F.explode("labels")).drop("labels")


def shared_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels that both sets have."""
    return a.select("label").intersect(b.select("label"))


def allow(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of allowed labels; an empty list allows all."""
    return df if labels.limit(1).count() == 0 else df.join(labels, "label", "left_semi")


def eval_windows(df: DataFrame, chrom: str, seq: str, scores: str, size: int) -> DataFrame:
    """(chrom, start, end, length, seq, scores) of consecutive windows of ``size`` letters; windows with an N go.

    Sequence and scores are cut to the shorter of the two; null scores have no window.
    """
    n = F.least(F.length(seq), F.size(scores))
    d = df.filter(F.col(scores).isNotNull()).select(F.col(chrom), F.substring(F.col(seq), F.lit(1), n).alias("__seq"), F.col(scores).alias("__scores"))
    d = d.select(chrom, "__scores", F.posexplode(chunks("__seq", size)).alias("__i", "seq")).filter(~F.contains("seq", F.lit("N")))
    start, length = F.col("__i").cast("long") * size, F.length("seq").cast("long")
    return d.select(chrom, start.alias("start"), (start + length).alias("end"), length.alias("length"), "seq", F.slice("__scores", F.col("__i") * size + 1, F.length("seq")).alias("scores"))


def pair_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Positive and negative file of each label; a missing side is null."""
    d = files.withColumn("label", label_from_name(name)).withColumn("side", F.regexp_extract(name, r"_(positive|negative)\.", 1))
    return d.groupBy("label").agg(F.max(F.when(F.col("side") == "positive", F.col(name))).alias("positive"), F.max(F.when(F.col("side") == "negative", F.col(name))).alias("negative"))


def chat(df: DataFrame, system: str, question: str, answer: str) -> DataFrame:
    """Three messages as one JSON record."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("json", F.to_json(F.struct(F.array(m("system", F.lit(system)), m("user", F.col(question)), m("assistant", F.col(answer))).alias("messages"))))


def manifest_row(manifest: DataFrame, **want: str) -> DataFrame:
    """F16: rows that match trimmed and in any case; unless it is exactly one, an error."""
    d = manifest
    for c, v in want.items():
        d = d.filter(F.lower(F.trim(c)) == v.strip().lower())
    n = d.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} row for {want}")
    return d


def run_tag(*parts: str) -> Column:
    """Folder name of a run."""
    return F.concat_ws("_", *(slug(F.col(p).cast("string")) for p in parts))
