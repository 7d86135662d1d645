"""Column functions: sequence, label, coordinate and ordering helpers (JVM-side unless noted)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUCLEOTIDES = "ACGT"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- sequences
def strip_n(seq: Column | str) -> Column:
    """Removes N; the flanks join."""
    return F.replace(col(seq), F.lit("N"), F.lit(""))


def only_acgt(seq: Column | str) -> Column:
    """non-empty and nothing but ACGT, after upper-casing."""
    return F.coalesce(F.upper(col(seq)).rlike("^[ACGT]+$"), F.lit(False))


def lacks_n(seq: Column | str) -> Column:
    """F8: no upper-case N."""
    return ~F.contains(col(seq), F.lit("N"))


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C, 0 for the empty sequence."""
    s = F.upper(col(seq))
    n = F.length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, "[^GC]", "")) / n).otherwise(0.0)


def complement(seq: Column | str) -> Column:
    """Complement, in the order of the input."""
    return F.translate(col(seq), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def kmers(seq: Column | str, k: int) -> Column:
    """Overlapping k-mers, none if the sequence is shorter; one linear scan of the string."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def chunks(seq: Column | str, size: int) -> Column:
    """Consecutive pieces, the last partial one kept; one linear scan of the string."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


# --- coordinates and labels
def canonical_chrom(c: Column | str) -> Column:
    """chr1 to chr22, X, Y; leading zeros pass."""
    return F.coalesce(col(c).rlike(r"^chr(0*([1-9]|1[0-9]|2[0-2])|X|Y)$"), F.lit(False))


CANONICAL = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]


def canonical_chrom_set(c: Column | str) -> Column:
    """F3, set form: the exact names only."""
    return F.coalesce(col(c).isin(CANONICAL), F.lit(False))


def parse_coord(c: Column | str) -> Column:
    """X7: 'chrom-start-end' (1-based inclusive) to a struct; null unless it has three parts and integers."""
    p = F.split(col(c), "-", -1)
    s = F.struct(p[0].alias("chrom"), F.try_to_number(p[1], F.lit("999999999999")).cast("long").alias("start"), F.try_to_number(p[2], F.lit("999999999999")).cast("long").alias("end"))
    return F.when(F.size(p) == 3, s)


def split_labels(c: Column | str) -> Column:
    """Comma list, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(col(c), ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def label_from_name(name: Column | str) -> Column:
    """Label in a FASTA file name, without suffix and chromosome prefix."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(col(name), r"([^/]*)$", 1), r"\.[^.]*$", ""), r"_(positive|negative)$", "")
    return F.regexp_replace(stem, r"^chr([1-9]|1[0-9]|2[0-2]|X|Y|M)_", "")


# --- ordering that is the same in any engine and partitioning
def salted(key: Column | str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt + ":"), col(key).cast("string")))


# --- numbers
def z_cutoff(p: float) -> float:
    """Two-tailed quantile of the normal distribution."""
    return NormalDist().inv_cdf(1 - p / 2)


#: Rational approximations of erf and erfc in three ranges (W. J. Cody, Math. Comp. 23, 1969): fixed values, ascending powers;
#: numerators and denominators in x*x up to 0.46875, in x up to 4, in 1/(x*x) beyond.
ERF_LOW = ([3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560e00, 1.85777706184603153e-1], [2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01, 1.0])
ERFC_MID = (
    [1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01, 8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8],
    [1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01, 1.0],
)
ERFC_HIGH = ([6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2], [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725e00, 2.56852019228982242e00, 1.0])


def _ratio(parts: tuple[list[float], list[float]], x: Column) -> Column:
    def horner(c: list[float]) -> Column:
        out = F.lit(c[-1])
        for v in c[-2::-1]:
            out = out * x + v
        return out

    return horner(parts[0]) / horner(parts[1])


def erfc(x: Column | str) -> Column:
    """Complementary error function of numbers from 0 up, as an expression of the engine."""
    v = col(x).cast("double")
    w = v * v
    high = F.exp(-w) / v * (F.lit(1 / math.sqrt(math.pi)) - _ratio(ERFC_HIGH, 1 / w) / w)
    return F.when(v <= 0.46875, 1 - v * _ratio(ERF_LOW, w)).when(v <= 4, F.exp(-w) * _ratio(ERFC_MID, v)).otherwise(high)


def normal_p(z: Column | str) -> Column:
    """Two-sided p of a z score; NaN and null stay."""
    return F.when(F.isnan(col(z)), col(z)).otherwise(erfc(F.abs(col(z)) / math.sqrt(2)))


def not_nan(c: Column | str) -> Column:
    """NaN as null, as missing values count."""
    return F.when(~F.isnan(col(c)), col(c))


def slug(c: Column | str) -> Column:
    """A name that can be a folder."""
    return F.replace(col(c), F.lit("/"), F.lit("_"))


def truthy(c: Column | str) -> Column:
    """True, 1 and yes in any case."""
    return F.coalesce(F.lower(F.trim(col(c))).isin("true", "1", "yes"), F.lit(False))
