"""Shared plumbing of the corpus operators: folders, written intermediates, workers' memory, column names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; keeps a worker's memory bounded for texts of some 10 kB.
ARROW_ROWS = 500
#: Bytes of a table up to which it is broadcast; beyond them the same join shuffles.
BROADCAST_BYTES = 24_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session in one JVM; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, label: str = "part") -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet under :func:`shared_dir` and reads it back.

    What :func:`discard` has not removed before goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/seqloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of :func:`written` tables that nothing reads any more."""
    for t in tables:
        fs, p = _path(t.sparkSession, t._seqloom_folder)
        fs.delete(p, True)


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table of rows of a known width, to be broadcast where its bytes are within ``most``."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a worker that lives on: memory that allocators hold back goes to the system when the task ends."""

    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    # by the types Spark tells the kind of an Arrow function
    own.__annotations__ = dict(zip(("batches", "return"), run.__annotations__.values(), strict=True))
    return own


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column is called so (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also sets the session's rows of an Arrow batch to ``ARROW_ROWS``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys have the fold -1."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
