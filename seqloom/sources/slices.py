"""Slices of a Parquet corpus by row number, as ``train[5%:]``, planned from the files' footers.

Rows are numbered through the files in order of their names. Files outside a slice are not read, files inside it are read
as they are, and only the (at most two) files that a border cuts are filtered by row number. No row is counted or sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import hadoop_path, located

_PART = re.compile(r"\s*(\w+)\s*(?:\[\s*(-?\d+%?)?\s*:\s*(-?\d+%?)?\s*\])?\s*")


def parse(spec: str) -> list[tuple[str, str | None, str | None]]:
    """The parts of ``name[from:to]+...``; a border is a row number or a percentage, from the end if negative, or left out."""
    out = []
    for part in spec.split("+"):
        m = _PART.fullmatch(part)
        if not m:
            raise ValueError(f"no slice: {part!r}")
        out.append((m[1], m[2], m[3]))
    return out


def border(text: str | None, rows: int, default: int) -> int:
    """The row number of a border, within the rows; percentages are rounded to the nearest row."""
    if text is None:
        return default
    at = round(rows * int(text[:-1]) / 100) if text.endswith("%") else int(text)
    return min(max(at + rows if text.startswith("-") else at, 0), rows)


def footers(spark: SparkSession, files: list[str]) -> list[int]:
    """Rows of each file, from its footer; footers are read by tasks, a row a file comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b["path"].to_pylist():
                fs, p = located(path)
                with fs.open_input_file(p) as f:
                    rows.append(pq.ParquetFile(f).metadata.num_rows)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(rows, pa.int64())], ["id", "n"])

    listed = spark.createDataFrame(list(enumerate(files)), "id long, path string")
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    got = dict(listed.repartition(tasks).mapInArrow(run, "id long, n long").collect())
    return [got[i] for i in range(len(files))]


def cuts(rows: list[int], lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(file, from, to) of the files that rows lo to hi lie in, by row number within the file."""
    out, at = [], 0
    for i, n in enumerate(rows):
        a, b = max(lo - at, 0), min(hi - at, n)
        if a < b:
            out.append((i, a, b))
        at += n
    return out


def sliced(spark: SparkSession, path: str | dict[str, str], spec: str) -> DataFrame:
    """The rows of the slices of a corpus, or of several by split name; an unknown name, or a spec that is none, is an error.

    An empty slice has the columns and no row; slices joined by ``+`` may overlap, their rows then come twice.
    """
    paths = path if isinstance(path, dict) else None
    out, known = None, {}
    for name, a, b in parse(spec):
        if paths is not None and name not in paths:
            raise ValueError(f"no split {name!r}; there are {sorted(paths)}")
        at = paths[name] if paths is not None else path
        if at not in known:
            whole = spark.read.parquet(at)
            files = sorted(map(unquote, whole.inputFiles()))
            known[at] = whole, files, footers(spark, files) if files else []
        whole, files, rows = known[at]
        total = sum(rows)
        d = _rows(whole, at, files, rows, border(a, total, 0), border(b, total, total))
        out = d if out is None else out.unionByName(d)
    return out


def _rows(whole: DataFrame, path: str, files: list[str], rows: list[int], lo: int, hi: int) -> DataFrame:
    spark = whole.sparkSession
    fs, p = hadoop_path(spark, path)
    reader = spark.read.schema(whole.schema)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        reader = reader.option("basePath", path)  # folders may be partition columns
    read = lambda *x: reader.parquet(*x)
    found = cuts(rows, lo, hi)
    if not found:
        return whole.limit(0)
    inside = [files[i] for i, a, b in found if b - a == rows[i]]
    parts = [read(*inside)] if inside else []
    for i, a, b in found:
        if b - a < rows[i]:
            at = F.col("_metadata.row_index")
            parts.append(read(files[i]).filter((at >= a) & (at < b)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
