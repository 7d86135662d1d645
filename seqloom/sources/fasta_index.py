"""FASTA files with an index (.fai): intervals read by offset arithmetic, only the bytes that they touch.

An index row says where a sequence begins in its file and how long its lines are, so the bytes of any interval follow by
arithmetic, in columns. Intervals are dealt by range of (file, offset) and read in that order; those that lie close
together are read in one go. Nothing else of the file is read, and no sequence is ever whole in memory.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import fresh, located

INDEX = "name string, length bigint, offset bigint, line_blen bigint, line_len bigint"
#: Bytes of a gap that is read over rather than skipped, and of one read.
GAP, READ = 1 << 16, 8 << 20
#: Rows of an index that are broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, length, offset, line_blen, line_len) of the ``.fai`` beside a FASTA file; it is an error where there is none."""
    d = spark.read.schema(INDEX).option("sep", "\t").csv(path + ".fai")
    return d.select(F.lit(path).alias("file"), "*")


def write_indexed(seqs: DataFrame, path: str, width: int = 60) -> DataFrame:
    """Writes (name, seq) as FASTA files of ``width`` letters a line, one a partition; returns their index.

    The index is the result of the job that writes, so write it, or use it once: each use writes the files again under new
    names, and a task that is tried again leaves a file that no index row names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = TaskContext.get()
        file = f"{path.rstrip('/')}/part-{c.partitionId():05d}-{c.taskAttemptId()}.fa"
        fs, p = located(file)
        fs.create_dir(posixpath.dirname(p), recursive=True)
        at = 0
        with fs.open_output_stream(p) as out:
            for b in batches:
                rows = []
                for name, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if name is None or any(x.isspace() for x in name):
                        raise ValueError(f"no name for a sequence: {name!r}")
                    data = np.frombuffer((seq or "").encode("ascii"), np.uint8)
                    head = f">{name}\n".encode()
                    full = len(data) // width * width
                    lines = np.full((full // width, width + 1), 10, np.uint8)
                    lines[:, :width] = data[:full].reshape(-1, width)
                    rest = data[full:].tobytes()
                    body = lines.tobytes() + rest + b"\n" * bool(rest)
                    out.write(head + body)
                    rows.append((file, name, len(data), at + len(head), width, width + 1))
                    at += len(head) + len(body)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["file", *(x.split()[0] for x in INDEX.split(", "))]) if rows else pa.RecordBatch.from_pylist([])

    return seqs.select(F.col("name").cast("string"), "seq").mapInArrow(run, "file string, " + INDEX)


def ranges(offset: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """(first byte, bytes, which rows) of the reads that serve rows in order of their offset."""
    lo = 0
    while lo < len(offset):
        hi, end = lo + 1, int(offset[lo] + size[lo])
        while hi < len(offset) and offset[hi] <= end + GAP and max(end, offset[hi] + size[hi]) - offset[lo] <= READ:
            end = max(end, int(offset[hi] + size[hi]))
            hi += 1
        yield int(offset[lo]), end - int(offset[lo]), slice(lo, hi)
        lo = hi


def fetch(intervals: DataFrame, index: DataFrame, strict: bool = False, one_based: bool = False) -> DataFrame:
    """The intervals (chrom, start, end, ...) with ``seq`` and ``reason``: null, or ``name`` or ``range`` where there is no sequence.

    Intervals are 0-based and half-open, or 1-based with both ends if ``one_based``. A name that the index lacks and a range
    that is empty or beyond the sequence give a reason, or an error if ``strict``. All columns and rows are kept.
    """
    spark = intervals.sparkSession
    file, length, offset, blen, llen, s0, at, size, key = fresh([*intervals.columns, "seq", "reason"], "file", "length", "offset", "line_blen", "line_len", "s0", "at", "size", "own")
    rows = index.select(F.col("name").alias(key), *(F.col(c).alias(n) for c, n in (("file", file), ("length", length), ("offset", offset), ("line_blen", blen), ("line_len", llen))))
    rows = F.broadcast(rows) if index.count() <= BROADCAST_ROWS else rows
    first = (F.col("start") - 1 if one_based else F.col("start")).cast("long")
    d = intervals.join(rows, F.col("chrom") == F.col(key), "left").withColumn(s0, first)
    bad = F.when(F.col(key).isNull(), "name").when(~F.coalesce((F.col(s0) >= 0) & (F.col("end") <= F.col(length)) & (F.col(s0) < F.col("end")), F.lit(False)), "range")
    d = d.withColumn("reason", bad)
    if strict:
        told = F.concat(F.when(F.col("reason") == "name", "no such sequence: ").otherwise("no such range: "), F.coalesce("chrom", F.lit("null")), F.lit(":"), F.coalesce(F.col("start").cast("string"), F.lit("null")), F.lit("-"), F.coalesce(F.col("end").cast("string"), F.lit("null")))
        d = d.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(told).cast("string")))
    place = lambda p: F.floor(p / F.col(blen)).cast("long") * F.col(llen) + p % F.col(blen)
    good = F.col("reason").isNull()
    d = d.withColumn(at, F.when(good, F.col(offset) + place(F.col(s0)))).withColumn(size, F.when(good, place(F.col("end") - 1) - place(F.col(s0)) + 1))
    kept = [*intervals.columns, "reason"]
    d = d.select(*kept, F.when(good, F.col(file)).alias(file), at, size).repartitionByRange(file, at).sortWithinPartitions(file, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            names, seqs = b.column(file).to_pylist(), [None] * len(b)
            off, n = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (at, size))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi or names[lo] is None:
                    continue
                if names[lo] != name:
                    name = names[lo]
                    fs, p = located(name)
                    f = fs.open_input_file(p)
                for begin, bytes_, own in ranges(off[lo:hi], n[lo:hi]):
                    f.seek(begin)
                    data = f.read(bytes_)
                    for i in range(lo + own.start, lo + own.stop):
                        seqs[i] = data[off[i] - begin : off[i] - begin + n[i]].translate(None, b"\r\n").decode("ascii")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(seqs, pa.string())], [*kept, "seq"])

    schema = d.select(*kept).withColumn("seq", F.lit("")).schema
    for x in schema:
        x.nullable = True
    return d.mapInArrow(run, schema).select(*intervals.columns, "seq", "reason")
