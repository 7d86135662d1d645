"""Tokenising as a stream: files are read as they come, decoded row by row, and appended; nothing waits for the whole corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import folder, hadoop_path


def source(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A Parquet corpus (a folder or one file) as a stream, so many files in each batch; its schema is that of the files there are."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    fs, p = hadoop_path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():  # a stream lists folders only
        return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))
    return reader.parquet(path)


def tokenized(rows: DataFrame, seq: str, tokenize: Callable[[Column], Column], name: str = "tokens") -> DataFrame:
    """2.11: rows with the tokens of their sequence in place of it; the same on a stream and on a table, as a row needs no other."""
    return rows.withColumn(name, tokenize(F.col(seq))).drop(*([seq] if seq != name else []))


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends what is there and not yet done to a Parquet folder, then stops; what was appended so far.

    The checkpoint remembers the files that are done: a run that was broken off, or one after more files have come, goes on from there.
    """
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def once(stream: DataFrame) -> DataFrame:
    """:func:`drained` into folders of its own, which go when the driver ends."""
    spark = stream.sparkSession
    return drained(stream, folder(spark, "stream"), folder(spark, "stream-progress"))
