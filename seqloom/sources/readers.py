"""Readers of the domain's text formats as DataFrames. Paths go through Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import canonical_chrom
from ..functions.shared import folder

BEDGRAPH = "chrom string, start bigint, end bigint, score double"
SEGMENT_COLUMNS = ["chrom", "genomic_start", "genomic_end", "category"]


_MALFORMED = "n <> 4 OR (start IS NULL AND start_text <> '') OR (end IS NULL AND end_text <> '') OR (score IS NULL AND score_text <> '')"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank: their number of fields, and the four typed columns beside their texts; a field that is no number is null."""
    d = spark.read.text(path).filter("trim(value) <> ''").withColumn("p", F.split("value", "\t")).withColumn("file", F.col("_metadata.file_path"))
    d = d.select("file", F.col("value").alias("line"), F.size("p").alias("n"), F.nullif(F.get("p", F.lit(0)), F.lit("")).alias("chrom"), *(F.trim(F.coalesce(F.get("p", F.lit(i)), F.lit(""))).alias(f"{c}_text") for i, c in ((1, "start"), (2, "end"), (3, "score"))))
    return d.withColumns({c: F.expr(f"try_cast({c}_text AS {t})") for c, t in (("start", "bigint"), ("end", "bigint"), ("score", "double"))})


def bedgraph(spark: SparkSession, path: str, strict: bool = False, chrom: str | None = None) -> DataFrame:
    """One file or a glob of them; malformed rows are dropped, or fail the read if ``strict``."""
    if strict:
        d = spark.read.schema(BEDGRAPH).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    else:
        d = _fields(spark, path).filter(f"NOT ({_MALFORMED})").select("chrom", "start", "end", "score")
    d = d.filter("chrom IS NOT NULL")
    return d if chrom is None else d.filter(F.col("chrom") == chrom)


def skipped(spark: SparkSession, path: str) -> int:
    """How many rows of a bedGraph are malformed."""
    return _fields(spark, path).filter(_MALFORMED).count()


def bedgraph_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The good rows, the malformed lines (file, line) and how many there are of each, from one reading of the files.

    One job writes both kinds side by side under the shared folder and counts them on the way; the two tables are read from there.
    """
    seen = Observation("bedgraph")
    d = _fields(spark, path).withColumn("bad", F.expr(_MALFORMED) | F.col("chrom").isNull())
    d = d.observe(seen, F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("malformed"))
    out = folder(spark, "bedgraph")
    kept = F.struct("chrom", "start", "end", "score")
    d.select(F.when(~F.col("bad"), kept).alias("row"), F.when(F.col("bad"), F.struct("file", "line")).alias("skipped"), "bad").write.partitionBy("bad").parquet(out)
    both = spark.read.schema(f"row struct<{BEDGRAPH.replace(' ', ':').replace(',:', ',')}>, skipped struct<file:string,line:string>, bad boolean").parquet(out)
    return both.filter("NOT bad").select("row.*"), both.filter("bad").select("skipped.*"), dict(seen.get)


def parse_fasta(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(header, seq) of FASTA text in a column; lines are joined, blanks go, text before the first header is dropped."""
    recs = F.filter(F.split(text, ">", -1), lambda x: x != "")
    d = df.select(*keep, F.explode(recs).alias("rec"))
    head = F.regexp_extract("rec", r"^([^\n]*)", 1)
    return d.select(*keep, head.alias("header"), F.regexp_replace(F.substring("rec", F.length(head) + 2, F.length("rec")), r"[ \n\t\r]", "").alias("seq"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, split at '>' by the reader, so a file is read in parallel."""
    d = spark.read.option("lineSep", ">").text(path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    head = F.trim(F.regexp_extract("value", r"^([^\n]*)", 1))
    body = F.regexp_replace(F.substring("value", F.length(F.regexp_extract("value", r"^([^\n]*)", 1)) + 2, F.length("value")), r"\s", "")
    return d.select(head.alias("header"), body.alias("seq"))


def fasta_clean(spark: SparkSession, path: str) -> DataFrame:
    """Upper-cased, without N, empties dropped."""
    return fasta(spark, path).withColumn("seq", F.replace(F.upper("seq"), F.lit("N"), F.lit(""))).filter("seq <> ''")


def fai(spark: SparkSession, path: str) -> DataFrame:
    """FASTA index (name, length, offset, line_blen, line_len)."""
    return spark.read.schema("name string, length bigint, offset bigint, line_blen bigint, line_len bigint").option("sep", "\t").csv(path)


def bed(spark: SparkSession, path: str, canonical: bool = True) -> DataFrame:
    """(chrom, start, end); comments, short lines, bad numbers, empty and negative intervals are dropped."""
    p = F.split("value", "\t")
    d = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.size(p) >= 3))
    d = d.select(p[0].alias("chrom"), F.expr("try_cast(split(value, '\t')[1] as bigint)").alias("start"), F.expr("try_cast(split(value, '\t')[2] as bigint)").alias("end"))
    d = d.filter("start >= 0 AND end > start")
    return d.filter(canonical_chrom("chrom")) if canonical else d


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment CSVs; required columns are checked."""
    d = spark.read.option("header", True).csv(path)
    if missing := [c for c in SEGMENT_COLUMNS if c not in d.columns]:
        raise ValueError(f"missing columns {missing}")
    return d.select("chrom", F.col("genomic_start").cast("bigint"), F.col("genomic_end").cast("bigint"), "category")


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, min_start, max_end) after one header line; the last line of a chrom wins."""
    d = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    p = F.split(F.trim("value"), r"\s+")
    d = d.filter(F.size(p) >= 3).select(p[0].alias("chrom"), F.expr(r"try_cast(split(trim(value), '\\s+')[1] as bigint)").alias("min_start"), F.expr(r"try_cast(split(trim(value), '\\s+')[2] as bigint)").alias("max_end"), "n")
    d = d.filter("min_start IS NOT NULL AND max_end IS NOT NULL")
    return d.groupBy("chrom").agg(F.max_by(F.struct("min_start", "max_end"), "n").alias("b")).select("chrom", "b.*")


def peaks(spark: SparkSession, path: str, coord: str, label: str = "celltype") -> DataFrame:
    """Peak TSV by column names, as (peak_id, coord, labels)."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    return d.select(F.monotonically_increasing_id().alias("peak_id"), F.col(coord).alias("coord"), F.col(label).alias("labels"))


def motifs(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """S16."""
    from ..operators.motifs import clean

    return clean(spark.read.text(path).filter("trim(value) <> ''"), "value", least)


def table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """A typed statistics table with a header."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def tokenizer(spark: SparkSession, path: str) -> dict:
    """A tokenizer JSON (a vocabulary is driver-sized)."""
    from ..operators.tokenizers import load_tokenizer

    return load_tokenizer("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Csv, tsv, json or txt by extension."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if ext == "tsv" else ",").csv(path)
    if ext in ("json", "jsonl"):
        return spark.read.json(path)
    if ext == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    raise ValueError(f"unknown extension {ext}")


def examples(spark: SparkSession, path: str, sep: str = ",", label_at: int | None = None, integer: bool = True) -> DataFrame:
    """Classification files of 2 (text, label), 3 (pair, label) or 5 columns (text last, label at 0 or 1)."""
    d = spark.read.option("header", True).option("sep", sep).csv(path)
    n = len(d.columns)
    cols = [F.col(f"`{c}`") for c in d.columns]
    kind = "int" if integer else "string"
    if n == 2:
        return d.select(cols[0].alias("text"), cols[1].cast(kind).alias("label"))
    if n == 3:
        return d.select(F.struct(cols[0].alias("text1"), cols[1].alias("text2")).alias("text"), cols[2].cast(kind).alias("label"))
    if n == 5:
        return d.select(cols[4].alias("text"), cols[0 if label_at is None else label_at].cast(kind).alias("label"))
    raise ValueError(f"{n} columns")


def manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV, with or without a byte-order mark, whose columns are checked."""
    d = spark.read.option("header", True).csv(path)
    d = d.toDF(*(c.lstrip("﻿") for c in d.columns))
    if missing := [c for c in required if c not in d.columns]:
        raise ValueError(f"missing columns {missing}")
    return d


def words(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file, id = line number from 0; blank lines keep their number."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n", -1)).alias("id", "token")).filter("trim(token) <> ''")
