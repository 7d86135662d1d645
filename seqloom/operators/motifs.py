"""Motifs with wildcards: cleaning, expansion, coverage of tokenisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenizers import Tokenizer, names

#: Letters a motif may hold (fixed values of the file format).
ALLOWED = "ACGTNRYWSMKBDHV*"


def clean(lines: DataFrame, line: str, least: int = 1) -> DataFrame:
    """First field, upper-cased, other letters dropped, long enough, distinct."""
    m = F.regexp_replace(F.upper(F.element_at(F.split(F.trim(line), r"\s+"), 1)), f"[^{ALLOWED}]", "")
    return lines.select(m.alias("motif")).filter(F.length("motif") >= least).distinct()


def expand(motifs: DataFrame, max_stars: int = 5) -> DataFrame:
    """Each * as A, C, G and T; motifs with more stars than allowed are dropped."""
    k = F.length("motif") - F.length(F.regexp_replace("motif", r"\*", ""))
    parts = F.split("motif", r"\*", -1)
    base = F.array(*(F.lit(x) for x in "ACGT"))
    d = motifs.withColumn("k", k).filter(F.col("k") <= max_stars).withColumn("code", F.explode(F.sequence(F.lit(0), F.pow(F.lit(4), F.col("k")).cast("int") - 1)))
    letter = lambda i: F.element_at(base, F.floor(F.col("code") / F.pow(F.lit(4), F.col("k") - 1 - i)).cast("int") % 4 + 1)
    tail = F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat(letter(i), F.element_at(parts, i + 2)))).otherwise(F.array().cast("array<string>"))
    return d.select("motif", F.concat(F.element_at(parts, 1), F.array_join(tail, "")).alias("variant"))


def sources(expanded: DataFrame) -> DataFrame:
    """The motif of each variant; of several the last by name."""
    return expanded.groupBy("variant").agg(F.max("motif").alias("motif"))


def coverage(variants: DataFrame, tokenize: dict[str, Callable[[Column], Column]], vocab: dict[str, set[str]]) -> DataFrame:
    """Per tokenizer and variant its tokens' number, whether one token covers it, is in the vocabulary, and the mean length share."""
    out = None
    for name, f in tokenize.items():
        known = F.col("variant").isin(*sorted(vocab[name])) if vocab[name] else F.lit(False)
        n = F.size("tokens")
        d = variants.withColumn("tokens", names(f(F.col("variant")))).select(
            F.lit(name).alias("tokenizer"), "motif", "variant", n.alias("n_tokens"), (n == 1).cast("int").alias("perfect"), known.cast("int").alias("in_vocab"), F.when(n > 0, 1 / n).cast("double").alias("mean_token_share")
        )
        out = d if out is None else out.unionByName(d)
    return out


def coverage_of(variants: DataFrame, tokenizers: dict[str, Tokenizer]) -> DataFrame:
    """:func:`coverage` by tokenizer objects."""
    return coverage(variants, {n: t.tokenize for n, t in tokenizers.items()}, {n: t.vocab for n, t in tokenizers.items()})


def summary(rows: DataFrame) -> DataFrame:
    """Means, medians and shares per tokenizer."""
    pct = lambda c: (F.avg(F.col(c).cast("double")) * 100).alias(f"pct_{c}")
    return rows.groupBy("tokenizer").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean_tokens"), F.median("n_tokens").alias("median_tokens"), pct("perfect"), pct("in_vocab")).orderBy("mean_tokens", F.desc("pct_in_vocab"))


def consistency(rows: DataFrame) -> DataFrame:
    """Sample deviation of the token counts of a motif's variants, 0 for a single one."""
    return rows.groupBy("tokenizer", "motif").agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp("n_tokens"), F.lit(0.0)).alias("sd_tokens"))
