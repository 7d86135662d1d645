"""Folders that driver and executors share, tables written into them, files opened by URI, free column names."""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder serves a session in one JVM, and a cluster is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        sc.setCheckpointDir(root)
    return root


def folder(spark: SparkSession, label: str) -> str:
    """A new path under :func:`shared_dir`, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/seqloom-{label}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, label: str = "part") -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet under :func:`shared_dir` and reads it back."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._seqloom_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of :func:`written` tables that nothing reads any more."""
    for t in tables:
        fs, p = hadoop_path(t.sparkSession, t._seqloom_folder)
        fs.delete(p, True)


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column is called so (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table of the plan itself, without a job that reads them."""
    names = [c.strip().split()[0] for c in re.split(r",\s+(?![^<]*>)", schema)]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ",".join(c.strip().replace(" ", ":", 1) for c in re.split(r",\s+(?![^<]*>)", schema))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


# --- files by URI, for tasks that read ranges of bytes
def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; without a scheme, or with ``file:``, the local one."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[str]:
    """The files of a folder or of a pattern in its last part, hidden ones left out; or the file itself. In order of their names."""
    fs, p = located(path)
    head = path[: len(path) - len(p)] if path.endswith(p) else path[: path.index("://") + 3] if "://" in path else ""
    name = posixpath.basename(p)
    if any(c in name for c in "*?["):
        at, want = posixpath.dirname(p), name
    elif fs.get_file_info(p).type == pafs.FileType.Directory:
        at, want = p, f"*{suffix}"
    else:
        return [path]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and fnmatch.fnmatch(f.base_name, want) and f.base_name[0] not in "._"]
    return [head + f for f in sorted(found)]
