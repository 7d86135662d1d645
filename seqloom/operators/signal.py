"""Signal tracks (chrom, start, end, score): bins, three-way classes, segments, window diagnostics.

Everything shuffles by (chrom, bin) or finer; per-track statistics are one row a track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import not_nan, z_cutoff
from .selection import beside, medians

#: Bins of a tile in which runs are merged before a track's tiles are joined.
TILE_BINS = 4096
CONSERVED, NEUTRAL, ACCELERATED = "conserved", "neutral", "accelerated"


def bins(track: DataFrame, size: int) -> DataFrame:
    """F1, F2, A1: mean score of the rows that start in a bin; bins without rows stay absent."""
    b = F.floor(F.col("start") / size).cast("long")
    return (
        track.withColumn("bin", b).groupBy("chrom", "bin").agg(F.avg(not_nan("score")).alias("binned_score"))
        .withColumn("genomic_start", F.col("bin") * size).withColumn("genomic_end", F.col("bin") * size + size)
    )


def three_way(score: Column, mean: Column, sd: Column, z: float) -> Column:
    """strictly above or below the cut-offs; ties and missing scores are neutral."""
    return F.when(score > mean + z * sd, CONSERVED).when(score < mean - z * sd, ACCELERATED).otherwise(NEUTRAL)


def classify(b: DataFrame, p: float = 0.1, z: float | None = None, ddof: int = 1, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """A2, F4 (ddof 1) or F5 (ddof 0): category of each bin against its track's mean and deviation."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    stats = b.groupBy(*by).agg(F.avg("binned_score").alias("mu"), sd("binned_score").alias("sd"))
    return b.join(stats, list(by)).withColumn("category", three_way(F.col("binned_score"), F.col("mu"), F.coalesce("sd", F.lit(0.0)), z_cutoff(p) if z is None else z)).withColumn("is_important", F.col("category") != NEUTRAL)


def merge_adjacent(b: DataFrame, tile: int | None = None) -> DataFrame:
    """Runs of touching bins of one category become one segment.

    With ``tile`` (positions) a long track is cut: runs are merged within tiles, and only runs that reach a tile's edge,
    two a tile at most, are merged along the track. No task orders a track.
    """
    if tile is None:
        return _runs(b, ["chrom", "category"])
    t = F.floor(F.col("genomic_start") / tile).cast("long")
    part = _runs(b.select("chrom", "category", "genomic_start", "genomic_end", t.alias("tile")), ["chrom", "category", "tile"])
    lo = F.col("tile") * tile
    edge = (F.col("genomic_start") <= lo) | (F.col("genomic_end") >= lo + tile)
    whole = part.filter(~edge).drop("tile")
    return whole.unionByName(_runs(part.filter(edge).drop("tile"), ["chrom", "category"]))


def _runs(b: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("genomic_start")
    new = F.coalesce((F.col("genomic_start") != F.lag("genomic_end").over(w)).cast("int"), F.lit(1))
    return (
        b.withColumn("new", new).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "block").agg(F.min("genomic_start").alias("genomic_start"), F.max("genomic_end").alias("genomic_end"))
        .select(*(c for c in by if c != "category"), "genomic_start", "genomic_end", "category")
    )


def segments(track: DataFrame, size: int, p: float = 0.1) -> DataFrame:
    """The stratification query: bins, classes, merged segments of all categories."""
    return merge_adjacent(classify(bins(track, size), p), TILE_BINS * size)


# --- window diagnostics
def grid(track: DataFrame, sizes: list[int]) -> DataFrame:
    """Full windows of each size over each track from its first position, with their means; windows without rows have a null mean."""
    ends = track.groupBy("chrom").agg(F.min("start").alias("origin"), F.max("end").alias("stop"))
    every = ends.withColumn("window", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes)))).withColumn("n", F.floor((F.col("stop") - F.col("origin")) / F.col("window")).cast("long"))
    # tiles first, dealt out, then their windows: no row holds a track's numbers
    tiles = every.filter("n > 0").select("chrom", "window", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / TILE_BINS).cast("long"))).alias("tile")).repartition("chrom", "window", "tile")
    slots = tiles.select("chrom", "window", F.explode(F.sequence(F.col("tile") * TILE_BINS, F.least(F.col("n"), (F.col("tile") + 1) * TILE_BINS) - 1)).alias("idx"))
    means = track.join(every, "chrom").withColumn("idx", F.floor((F.col("start") - F.col("origin")) / F.col("window")).cast("long")).filter("idx < n")
    means = means.groupBy("chrom", "window", "idx").agg(F.avg(not_nan("score")).alias("mean"))
    return slots.join(means, ["chrom", "window", "idx"], "left")


def grid_classes(g: DataFrame, z: float = 1.645) -> DataFrame:
    """F5 over a grid: deviation with ddof 0 within (track, window); windows without rows are neutral."""
    return classify(g.withColumnRenamed("mean", "binned_score"), z=z, ddof=0, by=("chrom", "window")).withColumnRenamed("binned_score", "mean")


def sweep(g: DataFrame, z: float = 1.645) -> DataFrame:
    """Per (track, window) number of windows, mean, deviation and shares of the categories."""
    pct = lambda c: (F.avg((F.col("category") == c).cast("double")) * 100).alias(f"pct_{c}")
    return grid_classes(g, z).groupBy("chrom", "window").agg(
        F.count("*").alias("n_windows"), F.count("mean").alias("n_valid"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"), pct(CONSERVED), pct(NEUTRAL), pct(ACCELERATED)
    )


def _with_previous(g: DataFrame, tile: int | None = None) -> DataFrame:
    """The grid with ``prev``, the mean of the window before; ordered within tiles, the last window of each standing in the next one, too."""
    tile = TILE_BINS if tile is None else tile
    own = F.floor(F.col("idx") / tile).cast("long")
    ends = F.when(F.col("idx") % tile == tile - 1, F.array(own, own + 1)).otherwise(F.array(own))
    d = g.withColumn("tile", F.explode(ends))
    w = Window.partitionBy("chrom", "window", "tile").orderBy("idx")
    return d.withColumn("prev", F.lag("mean").over(w)).filter(own == F.col("tile")).drop("tile")


def adjacent_change(g: DataFrame) -> DataFrame:
    """Median absolute difference of neighbouring windows; a missing window breaks the pair."""
    d = _with_previous(g).withColumn("d", F.abs(F.col("mean") - F.col("prev")))
    return beside(d.groupBy("chrom", "window").agg(F.count("d").alias("n_pairs")), medians(d, ["chrom", "window"], {"median_abs_change": F.col("d")}), ["chrom", "window"])


def lag1_autocorrelation(g: DataFrame) -> DataFrame:
    """Pearson correlation of neighbouring windows; null below three pairs."""
    p = _with_previous(g).filter("mean IS NOT NULL AND prev IS NOT NULL")
    return p.groupBy("chrom", "window").agg(F.count("*").alias("n_pairs"), F.corr("prev", "mean").alias("r")).withColumn("lag1_r", F.when(F.col("n_pairs") >= 3, not_nan("r"))).drop("r")


def stability(g: DataFrame, a: int, b: int, z: float = 1.645) -> DataFrame:
    """Base-level agreement and Cohen's kappa of the classes at two window sizes, a dividing b.

    Joined window by window and weighted by width, so no base is a row; bases beyond the last full window are neutral.
    """
    if b % a:
        raise ValueError("the larger window must be a multiple of the smaller")
    c = grid_classes(g, z)
    fine = c.filter(F.col("window") == a).select("chrom", "idx", F.col("category").alias("ca")).withColumn("big", F.floor(F.col("idx") / (b // a)).cast("long"))
    coarse = c.filter(F.col("window") == b).select("chrom", F.col("idx").alias("big"), F.col("category").alias("cb"))
    both = fine.join(coarse, ["chrom", "big"], "left").withColumn("cb", F.coalesce("cb", F.lit(NEUTRAL)))
    cells = both.groupBy("chrom", "ca", "cb").agg((F.count("*") * a).alias("w"))
    return kappa(cells, ["chrom"], "ca", "cb", "w")


def kappa(cells: DataFrame, by: list[str], a: str, b: str, weight: str) -> DataFrame:
    """Agreement and Cohen's kappa of a weighted confusion table."""
    total = cells.groupBy(*by).agg(F.sum(weight).alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col(weight)).otherwise(0)).alias("same"))
    ma = cells.groupBy(*by, F.col(a).alias("__class")).agg(F.sum(weight).alias("wa"))
    mb = cells.groupBy(*by, F.col(b).alias("__class")).agg(F.sum(weight).alias("wb"))
    pe = ma.join(mb, [*by, "__class"]).groupBy(*by).agg(F.sum(F.col("wa").cast("double") * F.col("wb")).alias("cross"))
    j = total.join(pe, by, "left")
    po, e = F.col("same") / F.col("total"), F.coalesce("cross", F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    return j.select(*by, F.col("total").alias("n"), po.alias("agreement"), F.when(e >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - e) / (1 - e)).alias("kappa"))


def heterogeneity(track: DataFrame, size: int, z: float = 1.645) -> DataFrame:
    """Spread and signs of the scores within bins, summed up per track and category."""
    s = not_nan("score")
    b = track.withColumn("bin", F.floor(F.col("start") / size).cast("long")).groupBy("chrom", "bin").agg(
        F.avg(s).alias("binned_score"), F.stddev_pop(s).alias("sd_in"), F.avg((s > 0).cast("double")).alias("pos"), F.avg((s < 0).cast("double")).alias("neg")
    ).withColumn("mixed", ((F.col("pos") > 0) & (F.col("neg") > 0)).cast("double"))
    c = classify(b, z=z, ddof=0)
    g = c.groupBy("chrom", "category").agg(
        F.count("*").alias("n_bins"), F.avg("sd_in").alias("mean_sd"), F.avg("pos").alias("mean_frac_pos"), F.avg("neg").alias("mean_frac_neg"), F.avg("mixed").alias("frac_mixed")
    )
    return beside(g, medians(c, ["chrom", "category"], {"median_sd": F.col("sd_in")}), ["chrom", "category"])


def boundary_probability(sizes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chance that a motif of ``motif_length`` crosses, or lies within, a bin of ``bin_size``, for each distinct pair of them.

    Both are dimensions of a few values (bin widths, lengths up to the longest motif), whatever the rows they are taken from.
    """
    d = sizes.select("bin_size").distinct().crossJoin(F.broadcast(lengths.select("motif_length").distinct()))
    b, n = F.col("bin_size"), F.col("motif_length")
    return d.select("bin_size", "motif_length", F.round(F.when(n > b, 1.0).otherwise((n - 1) / b), 4).alias("p_cross"), F.round(F.when(n > b, 0.0).otherwise((b - n + 1) / b), 4).alias("p_contain"))
