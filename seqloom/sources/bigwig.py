"""bigWig files as a Spark data source: read by range through their indexes, and written a file a partition.

The format is that of Kent et al., "BigWig and BigBed: enabling browsing of large distributed datasets", Bioinformatics
26 (2010): a header, a B+ tree of chromosome names, compressed sections of values, an R-tree over the sections.

Reading: the driver opens each file's header, chromosome tree and the top of its R-tree, and makes a partition of some
subtrees; what lies outside the asked chromosome and range is never descended into. A task walks its subtrees, reads
sections that lie side by side in one go and gives Arrow batches (chrom, start, end, score). Filters on chrom, start and
end reach the tree either as options or, where the session sets ``spark.sql.python.filterPushdown.enabled``, from the plan.

Writing: rows in order of (chrom, start) that don't overlap; a task writes a whole file under a hidden name, and the
commit shows all files at once, so a lost or repeated task leaves nothing behind.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions.shared import listed, located

SCHEMA = "chrom string, start bigint, end bigint, score double"
#: Numbers that mark a file, its chromosome tree and its R-tree (fixed values).
MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
#: Items of a section and children of an index node that are written.
ITEMS, CHILDREN = 512, 256
#: Sections of one read, in bytes; rows of an Arrow batch.
READ, ROWS = 4 << 20, 1 << 16
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Range:
    """What is asked for: rows of ``chrom`` (all if None) that reach into [start, end)."""

    chrom: str | None = None
    start: int = 0
    end: int = 1 << 62


@dataclass
class Subtrees(InputPartition):
    file: str
    nodes: tuple[int, ...]  # offsets of index nodes


class File:
    """An open bigWig file: its header, chromosomes and index nodes, read as they are asked for."""

    def __init__(self, path: str) -> None:
        fs, p = located(path)
        self.f = fs.open_input_file(p)
        head = self.at(0, 64)
        self.order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
        if self.order is None:
            raise ValueError(f"{path} is no bigWig file")
        self.chroms_at, _, self.index_at = struct.unpack(self.order + "QQQ", head[8:32])
        self.packed = struct.unpack(self.order + "I", head[52:56])[0] > 0
        if self.word("I", self.index_at) != INDEX_MAGIC or self.word("I", self.chroms_at) != CHROM_MAGIC:
            raise ValueError(f"{path} has a damaged index")
        self.root = self.index_at + 48

    def at(self, offset: int, size: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(size)

    def word(self, kind: str, offset: int) -> int:
        return struct.unpack(self.order + kind, self.at(offset, struct.calcsize(kind)))[0]

    def chroms(self) -> dict[int, tuple[str, int]]:
        """Names and lengths by number."""
        key, value = struct.unpack(self.order + "II", self.at(self.chroms_at + 8, 8))
        out, open_ = {}, [self.chroms_at + 32]
        while open_:
            at = open_.pop()
            leaf, _, n = struct.unpack(self.order + "BBH", self.at(at, 4))
            size = key + (value if leaf else 8)
            data = self.at(at + 4, n * size)
            for i in range(n):
                item = data[i * size : (i + 1) * size]
                if leaf:
                    number, length = struct.unpack(self.order + "II", item[key : key + 8])
                    out[number] = (item[:key].rstrip(b"\0").decode(), length)
                else:
                    open_.append(struct.unpack(self.order + "Q", item[key:])[0])
        return out

    def node(self, at: int) -> tuple[bool, np.ndarray]:
        """Whether an index node is a leaf, and its items (c0, b0, c1, b1, offset and, of a leaf, size)."""
        leaf, _, n = struct.unpack(self.order + "BBH", self.at(at, 4))
        kind = [(x, self.order + "u4") for x in ("c0", "b0", "c1", "b1")] + [("offset", self.order + "u8")] + [("size", self.order + "u8")] * bool(leaf)
        return bool(leaf), np.frombuffer(self.at(at + 4, n * np.dtype(kind).itemsize), kind)

    def within(self, items: np.ndarray, number: int | None, r: Range) -> np.ndarray:
        """The items of a node that reach into the range (``number``: of its chromosome)."""
        if number is None:
            return items
        c0, b0, c1, b1 = (items[x].astype(np.int64) for x in ("c0", "b0", "c1", "b1"))
        before = (c1 < number) | (c1 == number) & (b1 <= r.start)
        behind = (c0 > number) | (c0 == number) & (b0 >= r.end)
        return items[~before & ~behind]

    def subtrees(self, number: int | None, r: Range, least: int) -> list[int]:
        """Nodes that cover the range, from the root down until there are ``least`` or they are leaves."""
        level = [self.root]
        while len(level) < least:
            below, leaf = [], False
            for at in level:
                leaf, items = self.node(at)
                if leaf:
                    break
                below += self.within(items, number, r)["offset"].tolist()
            if leaf:
                break
            level = below
            if not level:
                break
        return level

    def sections(self, at: int, number: int | None, r: Range) -> Iterator[tuple[int, int]]:
        """(offset, bytes) of the sections below a node, in order."""
        leaf, items = self.node(at)
        items = self.within(items, number, r)
        if leaf:
            yield from zip(items["offset"].tolist(), items["size"].tolist(), strict=True)
        else:
            for o in items["offset"].tolist():
                yield from self.sections(o, number, r)

    def decoded(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(chromosome, starts, ends, values) of a section."""
        data = zlib.decompress(data) if self.packed else data
        number, start, _, step, span, kind, _, n = struct.unpack(self.order + "IIIIIBBH", data[:24])
        u, f = self.order + "u4", self.order + "f4"
        if kind == BED_GRAPH:
            x = np.frombuffer(data, [("s", u), ("e", u), ("v", f)], n, 24)
            return number, x["s"].astype(np.int64), x["e"].astype(np.int64), x["v"].astype(float)
        if kind == VARIABLE_STEP:
            x = np.frombuffer(data, [("s", u), ("v", f)], n, 24)
            return number, x["s"].astype(np.int64), x["s"].astype(np.int64) + span, x["v"].astype(float)
        if kind == FIXED_STEP:
            s = start + step * np.arange(n, dtype=np.int64)
            return number, s, s + span, np.frombuffer(data, f, n, 24).astype(float)
        raise ValueError(f"unknown kind of section {kind}")


class Reader(DataSourceReader):
    def __init__(self, path: str, r: Range, partitions: int) -> None:
        self.path, self.range, self.many = path, r, partitions

    def partitions(self) -> list[InputPartition]:
        files, out = listed(self.path, ".bw"), []
        each = max(1, -(-self.many // max(1, len(files))))
        for path in files:
            f = File(path)
            number = self._number(f)
            if self.range.chrom is not None and number is None:
                continue  # a chromosome that the file doesn't have
            nodes = f.subtrees(number, self.range, each)
            share = -(-len(nodes) // each)
            out += [Subtrees(path, tuple(nodes[i : i + share])) for i in range(0, len(nodes), max(1, share))]
        return out or [Subtrees("", ())]

    def _number(self, f: File) -> int | None:
        return next((k for k, (name, _) in f.chroms().items() if name == self.range.chrom), None) if self.range.chrom is not None else None

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        if not partition.nodes:
            return
        f = File(partition.file)
        names, number, held, rows = f.chroms(), self._number(f), [], 0
        order = sorted(names)
        labels = pa.array([names[k][0] for k in order], pa.string())

        def batch() -> pa.RecordBatch:
            at = np.searchsorted(order, np.repeat([h[0] for h in held], [len(h[1]) for h in held]))
            s, e, v = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            on = np.ones(len(s), bool) if number is None else (np.array(order)[at] == number) & (e > self.range.start) & (s < self.range.end)
            return pa.RecordBatch.from_arrays([labels.take(pa.array(at[on])), pa.array(s[on]), pa.array(e[on]), pa.array(v[on])], ["chrom", "start", "end", "score"])

        for lo, cuts in self._runs(f, partition.nodes, number):
            data = f.at(lo, cuts[-1][1] - lo)
            for a, b in cuts:
                held.append(f.decoded(data[a - lo : b - lo]))
                rows += len(held[-1][1])
                if rows >= ROWS:
                    yield batch()
                    held, rows = [], 0
        if held:
            yield batch()

    def _runs(self, f: File, nodes: tuple[int, ...], number: int | None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Sections that follow one another in the file, up to ``READ`` bytes: where they begin, and (begin, end) of each."""
        run: list[tuple[int, int]] = []
        for at in nodes:
            for o, size in f.sections(at, number, self.range):
                if run and (o != run[-1][1] or o + size - run[0][0] > READ):
                    yield run[0][0], run
                    run = []
                run.append((o, o + size))
        if run:
            yield run[0][0], run


class PushingReader(Reader):
    """Narrows the range by the plan's filters; Spark still applies them, since a section also holds rows beside the range."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        r = self.range
        for f in filters:
            match f:
                case EqualTo(("chrom",), v) if isinstance(v, str):
                    r.chrom = v if r.chrom in (None, v) else "\0"  # two chromosomes at once: none
                case GreaterThanOrEqual(("start",), v) | GreaterThan(("start",), v) | EqualTo(("start",), v) | GreaterThan(("end",), v):
                    r.start = max(r.start, int(v))
                case GreaterThanOrEqual(("end",), v) | EqualTo(("end",), v):
                    r.start = max(r.start, int(v) - 1)
            match f:
                case LessThan(("start",), v):
                    r.end = min(r.end, int(v))
                case LessThanOrEqual(("start",), v) | EqualTo(("start",), v):
                    r.end = min(r.end, int(v) + 1)
                case LessThanOrEqual(("end",), v) | LessThan(("end",), v) | EqualTo(("end",), v):
                    r.end = min(r.end, int(v))
            yield f


@dataclass
class Done(WriterCommitMessage):
    hidden: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.job, self.overwrite = path.rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        with tempfile.TemporaryFile() as body:  # of this task alone: a stream in a store can't go back to its header
            if not packed_into(body, iterator):
                return Done(None)
            c = TaskContext.get()
            hidden = f"{self.path}/_{self.job}-{c.partitionId():05d}-{c.taskAttemptId()}.bw"
            fs, p = located(hidden)
            fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
            body.seek(0)
            with fs.open_output_stream(p) as out:
                while data := body.read(READ):
                    out.write(data)
        return Done(hidden)

    def commit(self, messages: list[Done | None]) -> None:
        fs, p = located(self.path)
        fs.create_dir(p, recursive=True)
        old = listed(self.path, ".bw") if self.overwrite else []
        for m in messages:
            if m is not None and m.hidden:
                _, at = located(m.hidden)
                head, name = at.rsplit("/", 1)
                fs.move(at, f"{head}/part-{name.split('-')[1]}-{self.job}.bw")
        for f in old:
            fs.delete_file(located(f)[1])

    def abort(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m is not None and m.hidden:
                fs, at = located(m.hidden)
                fs.delete_file(at)


def packed_into(out, batches: Iterator[pa.RecordBatch], items: int = ITEMS, children: int = CHILDREN) -> int:
    """Writes one bigWig file of batches (chrom, start, end, score), in order and without overlaps; returns how many rows."""
    out.write(bytes(64))
    numbers: dict[str, int] = {}
    lengths: list[int] = []
    leaves: list[tuple[int, int, int, int, int, int]] = []
    rows, largest = 0, 0
    low, high, total, squares, covered = float("inf"), float("-inf"), 0.0, 0.0, 0
    out.write(bytes(8))  # number of sections
    begin = 72
    for b in batches:
        chrom = b.column(0).dictionary_encode()
        names, code = chrom.dictionary.to_pylist(), chrom.indices.to_numpy(zero_copy_only=False)
        s, e, v = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy().astype(np.float32)
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(code)], strict=True):
            name = names[code[lo]]
            if name not in numbers:
                if numbers and name < list(numbers)[-1]:
                    raise ValueError("rows are not in the order of chrom")
                numbers[name] = len(numbers)
                lengths.append(0)
            n = numbers[name]
            if n != len(numbers) - 1 or s[lo] < lengths[n] or (s[lo + 1 : hi] < e[lo : hi - 1]).any() or (e[lo:hi] <= s[lo:hi]).any() or e[hi - 1] >= 1 << 32:
                raise ValueError(f"rows of {name} overlap, are empty, too long or not in order")
            lengths[n] = int(e[hi - 1])
            for a in range(lo, hi, items):
                z = min(hi, a + items)
                x = np.empty(z - a, [("s", "<u4"), ("e", "<u4"), ("v", "<f4")])
                x["s"], x["e"], x["v"] = s[a:z], e[a:z], v[a:z]
                plain = struct.pack("<IIIIIBBH", n, s[a], e[z - 1], 0, 0, BED_GRAPH, 0, z - a) + x.tobytes()
                data = zlib.compress(plain, 6)
                largest = max(largest, len(plain))
                leaves.append((n, int(s[a]), n, int(e[z - 1]), begin, len(data)))
                out.write(data)
                begin += len(data)
            w = (e[lo:hi] - s[lo:hi]).astype(float)
            y = v[lo:hi].astype(float)
            low, high = min(low, float(y.min())), max(high, float(y.max()))
            total, squares, covered = total + float((w * y).sum()), squares + float((w * y * y).sum()), covered + int(w.sum())
            rows += int(hi - lo)
    if not rows:
        return 0
    chroms_at = begin
    begin += _chrom_tree(out, numbers, lengths)
    index_at = begin
    begin += _index(out, leaves, index_at, children)
    out.write(struct.pack("<Qdddd", covered, low, high, total, squares))
    out.seek(0)
    out.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, chroms_at, 64, index_at, 0, 0, 0, begin, largest, 0))
    out.write(struct.pack("<Q", len(leaves)))
    return rows


def _chrom_tree(out, numbers: dict[str, int], lengths: list[int]) -> int:
    """One level of leaves below a root where names are many."""
    names = [n.encode() for n in numbers]
    key, many = max(map(len, names)), 256
    leaves = [range(i, min(i + many, len(names))) for i in range(0, len(names), many)]
    head = struct.pack("<IIIIQQ", CHROM_MAGIC, max(many, len(leaves)), key, 8, len(names), 0)
    if len(leaves) > 0xFFFF:
        raise ValueError("too many chromosomes for a file")
    start, at, body = out.tell(), out.tell() + 32, b""
    if len(leaves) > 1:
        at += 4 + len(leaves) * (key + 8)
        body += struct.pack("<BBH", 0, 0, len(leaves))
        for leaf in leaves:
            body += names[leaf[0]].ljust(key, b"\0") + struct.pack("<Q", at)
            at += 4 + len(leaf) * (key + 8)
    for leaf in leaves:
        body += struct.pack("<BBH", 1, 0, len(leaf)) + b"".join(names[i].ljust(key, b"\0") + struct.pack("<II", i, lengths[i]) for i in leaf)
    out.write(head + body)
    return out.tell() - start


def _index(out, leaves: list[tuple], at: int, children: int) -> int:
    """The R-tree over sections: nodes of up to ``children``, the root first, each level behind the one above."""
    levels = [[leaves[i : i + children] for i in range(0, len(leaves), children)]]
    while len(levels[0]) > 1:
        spans = [(n[0][0], n[0][1], n[-1][2], n[-1][3]) for n in levels[0]]
        levels.insert(0, [spans[i : i + children] for i in range(0, len(spans), children)])
    start = out.tell()
    first, last = leaves[0], leaves[-1]
    out.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, children, len(leaves), first[0], first[1], last[2], last[3], at, ITEMS, 0))
    below = at + 48
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        below += sum(4 + len(n) * (32 if leaf else 24) for n in level)  # where the next level begins
        child, next_ = below, iter([] if leaf else levels[depth + 1])
        width = 32 if depth + 1 == len(levels) - 1 else 24
        for node in level:
            out.write(struct.pack("<BBH", leaf, 0, len(node)))
            for item in node:
                if leaf:
                    out.write(struct.pack("<IIIIQQ", *item))
                else:
                    out.write(struct.pack("<IIIIQ", *item, child))
                    child += 4 + len(next(next_)) * width
    return out.tell() - start


class BigWig(DataSource):
    """``spark.read.format("bigwig")``: options path, and chrom, start, end, partitions, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        r = Range(o.get("chrom"), int(o.get("start", 0)), int(o.get("end", 1 << 62)))
        return (PushingReader if o.get("pushdown") == "true" else Reader)(o["path"], r, int(o.get("partitions", 8)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def scan(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, partitions: int | None = None) -> DataFrame:
    """Rows (chrom, start, end, score) of a file, a folder or a pattern; those of ``chrom`` that reach into [start, end)."""
    if chrom is None and (start is not None or end is not None):
        raise ValueError("a range needs a chrom")
    spark.dataSource.register(BigWig)
    asked = {"chrom": chrom, "start": start, "end": end, "partitions": partitions or spark.sparkContext.defaultParallelism, "pushdown": spark.conf.get(PUSHDOWN, "false")}
    d = spark.read.format("bigwig")
    for k, v in asked.items():
        d = d if v is None else d.option(k, v)
    return d.load(path)


def write(signal: DataFrame, path: str, partitions: int | None = None) -> None:
    """A folder of bigWig files of a signal (chrom, start, end, score) without overlaps, each a range of (chrom, start)."""
    spark = signal.sparkSession
    spark.dataSource.register(BigWig)
    d = signal.select("chrom", F.col("start").cast("long"), F.col("end").cast("long"), F.col("score").cast("double")).filter("score IS NOT NULL")
    d = d.repartitionByRange(partitions, "chrom", "start") if partitions else d.repartitionByRange("chrom", "start")
    d.sortWithinPartitions("chrom", "start").write.format("bigwig").mode("append").option("path", path).save()
