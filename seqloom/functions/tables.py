"""Table functions for SQL: a motif's variants, a peak's labels."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

BASES = "ACGT"
POLICIES = ("drop", "first", "explode")


@udtf(returnType="variant string")
class ExpandMotif:
    """``expand_motif(motif, max_stars)``: each * as A, C, G and T, the last one fastest; nothing for null or for more stars than allowed."""

    def eval(self, motif: str, max_stars: int) -> Iterator[tuple]:
        if motif is None or motif.count("*") > max_stars:
            return
        head, *tail = motif.split("*")
        for letters in product(BASES, repeat=len(tail)):
            yield (head + "".join(a + b for a, b in zip(letters, tail, strict=True)),)


def _labels(text: str | None, policy: str) -> list[str]:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; there are {POLICIES}")
    found = [x for x in ((y.strip(" ") for y in text.split(",")) if text is not None else ()) if x]
    return found if policy == "explode" or len(found) == 1 else found[:1] if policy == "first" else []


@udtf(returnType="label string")
class ExpandLabels:
    """``expand_labels(labels, policy)``: the labels of a comma-separated text: all (explode), the first, or those of texts with one (drop)."""

    def eval(self, labels: str, policy: str) -> Iterator[tuple]:
        for x in _labels(labels, policy):
            yield (x,)


@udtf(returnType="peak_id bigint, label string")
class PeakLabels:
    """``peak_labels(TABLE(...), policy)`` over rows with columns peak_id and labels, whatever others there are."""

    def eval(self, row: Row, policy: str) -> Iterator[tuple]:
        for x in _labels(row["labels"], policy):
            yield row["peak_id"], x


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("expand_motif", ExpandMotif)
    spark.udtf.register("expand_labels", ExpandLabels)
    spark.udtf.register("peak_labels", PeakLabels)
