"""Writers of the domain's text formats. Spark writes folders of part files, one for each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(df: DataFrame, path: str, mode: str = "error") -> None:
    """K1: CSV with header, a folder for each chrom, sorted by start; a long chrom is several files, which its starts are dealt to by range."""
    df.repartitionByRange("chrom", "genomic_start").sortWithinPartitions("chrom", "genomic_start").withColumn("c", F.col("chrom")).write.mode(mode).partitionBy("c").option("header", True).csv(path)


def bed(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """K2: tab-separated without header, a folder for each category."""
    w = df.write.mode(mode).option("sep", "\t")
    (w.partitionBy(by) if by else w).csv(path)


def two_column_tsv(df: DataFrame, path: str, a: str, b: str, mode: str = "error") -> None:
    """K3: unquoted, one record a line."""
    df.select(F.concat_ws("\t", a, b).alias("value")).write.mode(mode).text(path)


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """K4."""
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", mode: str = "error") -> None:
    """Header, quoted where needed, columns in the given order."""
    df.select(*(columns or df.columns)).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def unquoted_csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",", mode: str = "error") -> None:
    """K5: values joined as they are, never quoted, nulls empty; the header is a folder ``header`` beside the part files."""
    names = columns or df.columns
    rows = df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)).alias("value"))
    head = df.sparkSession.createDataFrame([(sep.join(names),)], "value string")
    rows.write.mode(mode).text(path)
    head.coalesce(1).write.mode("append").text(f"{path}/header")


def fasta_once(df: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    """Fetched sequences as FASTA records, left alone where they are there already."""
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value")).write.mode("ignore").text(path)


def json_once(df: DataFrame, path: str) -> None:
    """A JSON record a line, left alone where it is there already."""
    df.write.mode("ignore").json(path)


def once(df: DataFrame, path: str) -> None:
    """K9: Parquet, left alone where it is there already."""
    df.write.mode("ignore").parquet(path)


def index(spark, path: str) -> DataFrame:
    """The files under a path, sorted."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").orderBy("path")
