"""Queries over the signal track: stratification, diagnostics, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.shared import folder, written
from ..operators import intervals as I
from ..operators import signal as S
from ..sources import bigwig
from ..sources.fasta_index import fetch as fasta_fetch
from ..sources.fasta_index import write_indexed
from .bindings import HOUR, REGIONS, SEQS, SIGNAL, read, regions, seqs, signal
from .registry import query

Z = repr(C.z_cutoff(0.1))

BINS = f"""{SIGNAL}, bins AS (SELECT chrom, CAST(floor(s / {HOUR}.0) AS BIGINT) AS bin, avg(score) AS binned_score FROM signal GROUP BY ALL)"""
CLASSES = f"""{BINS}, st AS (SELECT chrom, avg(binned_score) AS mu, stddev_samp(binned_score) AS sd FROM bins GROUP BY chrom),
cls AS (SELECT chrom, bin, bin * {HOUR} AS gs, bin * {HOUR} + {HOUR} AS ge, binned_score, CASE WHEN binned_score > mu + {Z} * coalesce(sd, 0) THEN 'conserved' WHEN binned_score < mu - {Z} * coalesce(sd, 0) THEN 'accelerated' ELSE 'neutral' END AS category FROM bins JOIN st USING (chrom))"""
SEGMENTS = f"""{CLASSES}, isl AS (SELECT *, bin - row_number() OVER (PARTITION BY chrom, category ORDER BY bin) AS isl FROM cls),
segments AS (SELECT chrom, min(gs) AS genomic_start, max(ge) AS genomic_end, category FROM isl GROUP BY chrom, category, isl)"""


@query("signal_bins", f"WITH {BINS} SELECT chrom, bin, round(binned_score, 6) AS binned_score, bin * {HOUR} AS genomic_start, bin * {HOUR} + {HOUR} AS genomic_end FROM bins")
def signal_bins(spark, sf_dir):
    """Hourly means of each track."""
    return S.bins(signal(spark, sf_dir), HOUR).withColumn("binned_score", F.round("binned_score", 6))


@query("signal_segments", f"WITH {SEGMENTS} SELECT * FROM segments")
def signal_segments(spark, sf_dir):
    """Two-tailed classes merged to segments."""
    return S.segments(signal(spark, sf_dir), HOUR).orderBy("chrom", "genomic_start")


@query("segment_category_summary", f"WITH {CLASSES} SELECT chrom, category, count(*) AS n_bins, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY chrom), 6) AS pct FROM cls GROUP BY chrom, category")
def segment_category_summary(spark, sf_dir):
    """Bins of each category and their share."""
    from pyspark.sql.window import Window

    c = S.classify(S.bins(signal(spark, sf_dir), HOUR)).groupBy("chrom", "category").agg(F.count("*").alias("n_bins"))
    return c.withColumn("pct", F.round(F.col("n_bins") * 100.0 / F.sum("n_bins").over(Window.partitionBy("chrom")), 6))


MERGED = """w AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS block FROM w)"""


@query("bed_merge", f"""WITH {SIGNAL}, {REGIONS}, {MERGED} SELECT chrom, min(s) AS "start", max(e) AS "end", count(*) AS n FROM b GROUP BY chrom, block""")
def bed_merge(spark, sf_dir):
    """Regions merged where they overlap or touch."""
    return I.merge_bed(regions(spark, sf_dir)).orderBy("chrom", "start")


def _segments(spark, sf_dir):
    d = S.segments(signal(spark, sf_dir), HOUR).select("chrom", F.col("genomic_start").alias("start"), F.col("genomic_end").alias("end"), "category")
    return written(d, "segments")  # the join reads them three times: their starts, their number in each slice, themselves


OVER = "ov AS (SELECT r.event_id, r.chrom, r.kind, g.category, greatest(r.s, g.genomic_start) AS o_start, least(r.e, g.genomic_end) AS o_end FROM regions r JOIN segments g ON r.chrom = g.chrom AND r.s < g.genomic_end AND g.genomic_start < r.e)"


@query("interval_overlap", f"WITH {SEGMENTS}, {REGIONS}, {OVER} SELECT * FROM ov")
def interval_overlap(spark, sf_dir):
    """Clipped overlaps of regions and segments."""
    j = I.overlap_join(regions(spark, sf_dir), _segments(spark, sf_dir))
    return j.select("event_id", "chrom", "kind", F.col("b_category").alias("category"), "o_start", "o_end")


GRID = """m AS (SELECT kind, category, o_start AS s, o_end AS e, max(o_end) OVER (PARTITION BY kind, category, chrom ORDER BY o_start, o_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, chrom FROM ov),
mb AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY kind, category, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS block FROM m),
mm AS (SELECT kind, category, chrom, block, max(e) - min(s) AS len FROM mb GROUP BY ALL)"""


@query("region_conservation_grid", f"""WITH {SEGMENTS}, {REGIONS}, {OVER}, {GRID}
SELECT kind, CAST(coalesce(sum(len) FILTER (category = 'conserved'), 0) AS BIGINT) AS conserved, CAST(coalesce(sum(len) FILTER (category = 'neutral'), 0) AS BIGINT) AS neutral, CAST(coalesce(sum(len) FILTER (category = 'accelerated'), 0) AS BIGINT) AS accelerated FROM mm GROUP BY kind""")
def region_conservation_grid(spark, sf_dir):
    """Bases of each region kind within each category, overlaps merged, as a matrix."""
    j = I.overlap_join(regions(spark, sf_dir), _segments(spark, sf_dir))
    m = I.merge_bed(j.select("kind", F.col("b_category").alias("category"), "chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end")), ("kind", "category", "chrom"))
    p = m.groupBy("kind").pivot("category", [S.CONSERVED, S.NEUTRAL, S.ACCELERATED]).agg(F.sum(F.col("end") - F.col("start")))
    return p.na.fill(0)


@query("interval_anti_semi", f"WITH {SEGMENTS}, {REGIONS} SELECT event_id, EXISTS (SELECT 1 FROM segments g WHERE g.category <> 'neutral' AND g.chrom = r.chrom AND r.s < g.genomic_end AND g.genomic_start < r.e) AS touches FROM regions r")
def interval_anti_semi(spark, sf_dir):
    """Regions with and without an important segment."""
    r, g = regions(spark, sf_dir), _segments(spark, sf_dir).filter(F.col("category") != S.NEUTRAL)
    yes = I.overlap_join(r, g, "left_semi").select("event_id", F.lit(True).alias("touches"))
    return yes.unionByName(I.overlap_join(r, g, "left_anti").select("event_id", F.lit(False).alias("touches")))


FETCHED = f"""WITH {SEQS}, q AS (SELECT doc_id, seq, s, s + 20 + doc_id % 300 AS e FROM (SELECT doc_id, seq, (doc_id * 7919 + j * length(seq) // 3) % length(seq) AS s FROM seqs, (SELECT unnest(range(3)) AS j) WHERE length(seq) > 0))
SELECT doc_id, s AS "start", e AS "end", substring(seq, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS seq FROM q WHERE e <= length(seq)"""


def _spread(spark, sf_dir):
    """Three intervals of each sequence, spread over all of it; some reach beyond its end."""
    n = F.length("seq").cast("long")
    at = seqs(spark, sf_dir).filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    s = (F.col("doc_id") * 7919 + F.floor(F.col("j") * F.col("n") / 3)) % F.col("n")
    return at.select("doc_id", F.col("doc_id").cast("string").alias("chrom"), s.alias("start"), (s + 20 + F.col("doc_id") % 300).alias("end"))


#: Letters of a chunk of the reference that intervals are joined to.
CHUNK = 4096


@query("interval_fetch", FETCHED)
def interval_fetch(spark, sf_dir):
    """Intervals, spread over all of each sequence, read out of a chunked reference."""
    ref = seqs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    return I.fetch(_spread(spark, sf_dir), I.chunked(ref, CHUNK), CHUNK, ["doc_id"]).select("doc_id", "start", "end", "seq")


@query("fasta_index_fetch", FETCHED)
def fasta_index_fetch(spark, sf_dir):
    """The same intervals by offset arithmetic from indexed FASTA files of all sequences; only the bytes they touch are read."""
    path = folder(spark, "fasta")
    index = written(write_indexed(seqs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "seq"), path), "fai")
    return fasta_fetch(_spread(spark, sf_dir), index).filter("reason IS NULL").select("doc_id", "start", "end", "seq")


@query("bigwig_scan", f"""WITH {SIGNAL} SELECT chrom, s AS "start", s + 1 AS "end", round(CAST(CAST(avg(score) AS FLOAT) AS DOUBLE), 4) AS score FROM signal GROUP BY chrom, s""")
def bigwig_scan(spark, sf_dir):
    """All tracks, a value a second, written as bigWig files and read back through their indexes."""
    path = folder(spark, "bigwig")
    bigwig.write(signal(spark, sf_dir).groupBy("chrom", "start", "end").agg(F.avg("score").alias("score")), path)
    return bigwig.scan(spark, path).withColumn("score", F.round("score", 4))


_IV = """iv AS (SELECT o_orderkey, concat('chr', CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '' END, o_custkey % 26) AS chrom, o_orderkey % 100 - 10 AS s, o_orderkey % 100 - 10 + o_custkey % 9 - 1 AS e FROM orders)"""


def _iv(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("chr"), F.when(k % 7 == 0, "0").otherwise(""), c % 26).alias("chrom"), (k % 100 - 10).alias("start"), (k % 100 - 10 + c % 9 - 1).alias("end"))


@query("canonical_filter", rf"WITH {_IV} SELECT chrom, count(*) AS n, regexp_matches(chrom, '^chr(0*([1-9]|1[0-9]|2[0-2])|X|Y)$') AS by_number, regexp_matches(chrom, '^chr([1-9]|1[0-9]|2[0-2]|X|Y)$') AS by_name FROM iv GROUP BY chrom")
def canonical_filter(spark, sf_dir):
    """both forms of the canonical-chromosome predicate."""
    return _iv(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n")).select("chrom", "n", C.canonical_chrom("chrom").alias("by_number"), C.canonical_chrom_set("chrom").alias("by_name"))


@query("interval_validation", rf"""WITH {_IV} SELECT coalesce(CASE WHEN NOT regexp_matches(chrom, '^chr(0*([1-9]|1[0-9]|2[0-2])|X|Y)$') THEN 'chrom' WHEN s < 0 THEN 'negative' WHEN e <= s THEN 'empty' END, 'valid') AS outcome, count(*) AS n,
CAST(sum(greatest(0, least(e, 60) - greatest(s, 0))) AS BIGINT) AS clamped FROM iv GROUP BY 1""")
def interval_validation(spark, sf_dir):
    """Interval rows by outcome, and their bases within a reference of 60."""
    d = I.validate(_iv(spark, sf_dir))
    n = F.greatest(F.lit(0), F.least("end", F.lit(60)) - F.greatest("start", F.lit(0)))
    return d.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(n).alias("clamped"))


# --- window diagnostics
SIZES = [3600, 7200, 21_600, 86_400]
GRIDS = f"""{SIGNAL}, en AS (SELECT chrom, min(s) AS origin, max(e) AS stop FROM signal GROUP BY chrom),
ev AS (SELECT chrom, origin, w, (stop - origin) // w AS n FROM en, (SELECT unnest(CAST({SIZES} AS BIGINT[])) AS w)),
sl AS (SELECT chrom, w, unnest(range(0, n)) AS idx FROM ev WHERE n > 0),
mn AS (SELECT ev.chrom, ev.w, (s - origin) // w AS idx, avg(score) AS mean FROM signal JOIN ev ON signal.chrom = ev.chrom AND (s - origin) // w < n GROUP BY ALL),
grid AS (SELECT sl.chrom, sl.w AS "window", sl.idx, mean FROM sl LEFT JOIN mn ON sl.chrom = mn.chrom AND sl.w = mn.w AND sl.idx = mn.idx)"""
GCLS = f"""{GRIDS}, gst AS (SELECT chrom, "window", avg(mean) AS mu, stddev_pop(mean) AS sd FROM grid GROUP BY ALL),
gcls AS (SELECT chrom, "window", idx, mean, CASE WHEN mean > mu + 1.645 * coalesce(sd, 0) THEN 'conserved' WHEN mean < mu - 1.645 * coalesce(sd, 0) THEN 'accelerated' ELSE 'neutral' END AS category FROM grid JOIN gst USING (chrom, "window"))"""


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query("window_sweep", f"""WITH {GCLS} SELECT chrom, "window", count(*) AS n_windows, count(mean) AS n_valid, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS sd,
round(100.0 * count(*) FILTER (category = 'conserved') / count(*), 6) AS pct_conserved, round(100.0 * count(*) FILTER (category = 'neutral') / count(*), 6) AS pct_neutral, round(100.0 * count(*) FILTER (category = 'accelerated') / count(*), 6) AS pct_accelerated FROM gcls GROUP BY ALL""")
def window_sweep(spark, sf_dir):
    """Means, deviations and category shares at several window sizes."""
    d = S.sweep(S.grid(signal(spark, sf_dir), SIZES))
    return _rounded(d, "mean", "sd", "pct_conserved", "pct_neutral", "pct_accelerated")


@query("window_adjacent_change", f"""WITH {GRIDS}, d AS (SELECT chrom, "window", abs(mean - lag(mean) OVER (PARTITION BY chrom, "window" ORDER BY idx)) AS d FROM grid)
SELECT chrom, "window", count(d) AS n_pairs, round(median(d), 6) AS median_abs_change FROM d GROUP BY ALL""")
def window_adjacent_change(spark, sf_dir):
    """Median absolute change between neighbouring windows."""
    return _rounded(S.adjacent_change(S.grid(signal(spark, sf_dir), SIZES)), "median_abs_change")


@query("window_lag1_autocorr", f"""WITH {GRIDS}, d AS (SELECT chrom, "window", mean, lag(mean) OVER (PARTITION BY chrom, "window" ORDER BY idx) AS prev FROM grid)
SELECT chrom, "window", count(*) AS n_pairs, CASE WHEN count(*) >= 3 THEN round(corr(prev, mean), 6) END AS lag1_r FROM d WHERE mean IS NOT NULL AND prev IS NOT NULL GROUP BY ALL""")
def window_lag1_autocorr(spark, sf_dir):
    """Lag-1 autocorrelation of window means."""
    return _rounded(S.lag1_autocorrelation(S.grid(signal(spark, sf_dir), SIZES)), "lag1_r")


@query("label_stability_kappa", f"""WITH {GCLS}, f AS (SELECT chrom, idx // 6 AS big, category AS ca FROM gcls WHERE "window" = 3600), g AS (SELECT chrom, idx AS big, category AS cb FROM gcls WHERE "window" = 21600),
x AS (SELECT f.chrom, ca, coalesce(cb, 'neutral') AS cb, 3600 * count(*) AS w FROM f LEFT JOIN g ON f.chrom = g.chrom AND f.big = g.big GROUP BY ALL),
t AS (SELECT chrom, sum(w) AS n, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS same FROM x GROUP BY chrom),
a AS (SELECT chrom, ca AS k, sum(w) AS wa FROM x GROUP BY ALL), b AS (SELECT chrom, cb AS k, sum(w) AS wb FROM x GROUP BY ALL),
p AS (SELECT a.chrom, sum(CAST(wa AS DOUBLE) * wb) AS c FROM a JOIN b ON a.chrom = b.chrom AND a.k = b.k GROUP BY a.chrom)
SELECT t.chrom, CAST(n AS BIGINT) AS n, round(same / n, 6) AS agreement, round(CASE WHEN coalesce(c, 0) / (CAST(n AS DOUBLE) * n) >= 1 THEN CASE WHEN same = n THEN 1.0 ELSE 0.0 END ELSE (same / n - coalesce(c, 0) / (CAST(n AS DOUBLE) * n)) / (1 - coalesce(c, 0) / (CAST(n AS DOUBLE) * n)) END, 6) AS kappa FROM t LEFT JOIN p ON t.chrom = p.chrom""")
def label_stability_kappa(spark, sf_dir):
    """Agreement of the classes at one and six hours, weighted by width."""
    return _rounded(S.stability(S.grid(signal(spark, sf_dir), [3600, 21_600]), 3600, 21_600), "agreement", "kappa")


@query("within_bin_heterogeneity", f"""WITH {SIGNAL}, b AS (SELECT chrom, s // 21600 AS bin, avg(score - 50) AS m, stddev_pop(score - 50) AS sd_in, avg(CASE WHEN score > 50 THEN 1.0 ELSE 0 END) AS pos, avg(CASE WHEN score < 50 THEN 1.0 ELSE 0 END) AS neg FROM signal GROUP BY ALL),
st AS (SELECT chrom, avg(m) AS mu, stddev_pop(m) AS sd FROM b GROUP BY chrom),
c AS (SELECT b.*, CASE WHEN m > mu + 1.645 * sd THEN 'conserved' WHEN m < mu - 1.645 * sd THEN 'accelerated' ELSE 'neutral' END AS category FROM b JOIN st USING (chrom))
SELECT chrom, category, count(*) AS n_bins, round(avg(sd_in), 6) AS mean_sd, round(median(sd_in), 6) AS median_sd, round(avg(pos), 6) AS mean_frac_pos, round(avg(neg), 6) AS mean_frac_neg, round(avg(CASE WHEN pos > 0 AND neg > 0 THEN 1.0 ELSE 0 END), 6) AS frac_mixed FROM c GROUP BY ALL""")
def within_bin_heterogeneity(spark, sf_dir):
    """Spread and sign mix of scores (around 50) within six-hour bins, by category."""
    t = signal(spark, sf_dir).withColumn("score", F.col("score") - 50)
    return _rounded(S.heterogeneity(t, 21_600), "mean_sd", "median_sd", "mean_frac_pos", "mean_frac_neg", "frac_mixed")


@query("boundary_probability", f"""WITH {SIGNAL}, w AS (SELECT DISTINCT {HOUR} * (1 + user_id % 5) AS b FROM signal), m AS (SELECT DISTINCT length(p_name) * 60 AS l FROM part)
SELECT b AS bin_size, l AS motif_length, round(CASE WHEN l > b THEN 1.0 ELSE CAST(l - 1 AS DOUBLE) / b END, 4) AS p_cross, round(CASE WHEN l > b THEN 0.0 ELSE CAST(b - l + 1 AS DOUBLE) / b END, 4) AS p_contain FROM w, m""")
def boundary_probability(spark, sf_dir):
    """Closed form for the motif lengths (of ``part`` names, a minute a letter) at the borders of the tracks' bin widths."""
    sizes = signal(spark, sf_dir).select((HOUR * (1 + F.col("user_id") % 5)).alias("bin_size"))
    return S.boundary_probability(sizes, read(spark, sf_dir, "part").select((F.length("p_name") * 60).cast("long").alias("motif_length")))


@query("nearest_impute", f"""WITH {SIGNAL}, p AS (SELECT chrom, s // 3600 AS pos, avg(score) AS v FROM signal GROUP BY ALL), t AS (SELECT chrom, pos, CASE WHEN pos % 3 = 0 THEN v END AS value FROM p),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS bp, last_value(value IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER z AS ap, first_value(value IGNORE NULLS) OVER z AS av
 FROM t WINDOW a AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT chrom, pos, round(value, 6) AS value, round(coalesce(value, CASE WHEN bp IS NULL OR ap IS NULL THEN NULL WHEN pos - bp <= ap - pos THEN bv ELSE av END), 6) AS imputed FROM n""")
def nearest_impute(spark, sf_dir):
    """Gaps take the nearest known value."""
    p = signal(spark, sf_dir).groupBy("chrom", F.floor(F.col("start") / 3600).cast("long").alias("pos")).agg(F.avg("score").alias("v"))
    return _rounded(I.nearest_impute(p.select("chrom", "pos", F.when(F.col("pos") % 3 == 0, F.col("v")).alias("value"))), "value", "imputed")
