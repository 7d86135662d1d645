"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased (A-Z) words. Words are ordered by rarity: the power of two of their count over all
texts, then a hash; lines' word sets are written in that order. Two lines of similarity ``LEAST`` share a word within
their prefixes, so lines are dealt by their prefix words (words that occur once are left out: nothing shares them), and
within a word pairs are kept by length, by position (what can still be shared after it) and by a sketch of the
sets (32 counts modulo 16, which bound the sets' difference from below). All three bounds are exact: they drop no similar pair. What is left is
verified on the whole sets. Equal sets are one class and need no join.

A line goes if an earlier line, by (key, text hash, line number), is equal to it or similar. Blank lines stay.

What the bounds leave in a list joins sets to clusters: a list gives a spanning forest of its pairs, never the pairs, since
a group of similar lines has as many pairs as the square of its size.
Sets are then brought together by cluster, once each, and a cluster's sets are verified with each other, in cells of
bounded size. A cell gives, per set, its number of links and the earliest line among them.

Counts come from all texts; they are summed in slices, as packed arrays. Words are read off whole buffers. Lists of
prefix words are dealt to shards, many lists a shard, as packed arrays too, so that no posting is a row of its own; lists
of a frequent word are cut into cells by line, so no list is held whole; each partition deals a set once however often
the line occurs.

Defined results: null texts are empty (one line, blank, kept); null keys stand after all others; rows of equal key and
text are one document and get the same result; words are told apart by 64 bits of hash, and so are sets; of the columns
that :func:`dedup` adds, equally named ones of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import buffer_of, mix, words
from .components import connected, joined
from .runtime import BROADCAST_BYTES, discard, fresh, lean, written

LEAST = 0.8
#: Buckets of the rarity table (one byte each is sent out), buckets that are summed together, level from which lists are cut.
BUCKET_BITS, SLICE, LONG_LEVEL = 22, 4096, 14
#: Postings of a shard, about; postings that a task packs at once; pairs of postings that are looked at at once.
SHARD, PACKED, PAIRED = 400_000, 100_000, 300_000
#: Sets from which a cluster is verified by dense counts; sets and words of a chunk of a cluster.
DENSE, CELL_SETS, CELL_WORDS = 48, 1024, 1_500_000
LAST = 2**63 - 1
_U = np.uint64
_LINE_BITS, _LEVEL_BITS = 18, 6
_ODD = _U(0x1111111111111111)

POSTING = np.dtype([("cell", "u8"), ("key", "i8"), ("s1", "u8"), ("s2", "u8"), ("size", "u4"), ("position", "u4"), ("chunk", "u4")])


def line_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words' hashes, line of each word, row of each line, number of each line in its row)."""
    data, offsets = buffer_of(col)
    feeds = np.flatnonzero(data == 10)
    s, _, h = words(data, offsets)
    row_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    per_row = np.bincount(row_of_feed, minlength=len(offsets) - 1) + 1
    row = np.repeat(np.arange(len(per_row)), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    row_of_word = np.searchsorted(offsets, s, side="right") - 1
    return h, np.searchsorted(feeds, s) + row_of_word, row, number


def ordered_sets(h: np.ndarray, line: np.ndarray, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each line, rarest first: (line, word, its level); ``line`` ascends.

    Line, level and the top of the word share one number, whose order is that of (line, level, word) but for words that
    agree in their top; where some do, or lines don't fit, three keys are sorted.
    """
    lv = np.zeros(len(h), np.uint8) if level is None else level[(h >> _U(64 - BUCKET_BITS)).astype(np.int64)]
    order = None
    if not len(line) or int(line[-1]) < 1 << _LINE_BITS:
        x = line.astype(_U) << _U(64 - _LINE_BITS) | lv.astype(_U) << _U(64 - _LINE_BITS - _LEVEL_BITS) | h >> _U(_LINE_BITS + _LEVEL_BITS)
        order = np.argsort(x)
        x, g = x[order], h[order]
        if ((x[1:] == x[:-1]) & (g[1:] != g[:-1])).any():
            order = None
    if order is None:
        order = np.lexsort((h, lv, line))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return line[new], h[new], lv[order][new]


def set_keys(line: np.ndarray, w: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each line's set (order does not matter) and its size; size 0: no words."""
    m = mix(w ^ _U(0x5E75))
    size = np.bincount(line, minlength=lines)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(m, dtype=_U)])
    ends = np.cumsum(size)
    return mix(total[ends] - total[ends - size] + size.astype(_U)).view(np.int64), size


def overlap_needed(a, b, least: float = LEAST):
    """Least number of shared words of sets of sizes a and b."""
    return np.ceil(least / (1 + least) * (a + b) - 1e-9)


def sketches(line: np.ndarray, w: np.ndarray, lines: int) -> np.ndarray:
    """32 buckets of words, the words of each counted modulo 16: two 64-bit numbers a line."""
    bucket = (mix(w ^ _U(0xABCD)) & _U(31)).astype(np.int64)
    n = np.bincount(line * 32 + bucket, minlength=lines * 32).reshape(lines, 2, 16) & 15
    return (n.astype(_U) << (np.arange(16, dtype=_U) * _U(4))).sum(2, dtype=_U)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many words are in one set and not in the other."""
    out = np.zeros(len(a), np.int64)
    for shift in range(0, 64, 4):
        d = ((a >> _U(shift)) - (b >> _U(shift))) & _U(15)
        out += np.minimum(d, _U(16) - d).astype(np.int64).sum(1)
    return out


def postings(line: np.ndarray, w: np.ndarray, lv: np.ndarray, key: np.ndarray, size: np.ndarray, take: np.ndarray, least: float = LEAST, long_level: int = LONG_LEVEL) -> Iterator[np.ndarray]:
    """Prefix words of the lines in ``take``, each with its list's cells; sets below 4 words match none but equals."""
    start = np.cumsum(size) - size
    position = np.arange(len(w)) - start[line]
    prefix = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    on = np.flatnonzero(take[line] & (size[line] >= 4) & (position < prefix[line]) & (lv > 0))
    sketch = sketches(line, w, len(size))
    cuts = 1 << np.clip(lv[on].astype(np.int64) - long_level + 1, 0, 31)
    turn = np.cumsum(cuts) // PACKED
    for k in np.flatnonzero(np.bincount(turn)) if len(on) else ():
        lo, hi = np.searchsorted(turn, [k, k + 1])
        own, cut = on[lo:hi], cuts[lo:hi]
        at = np.repeat(own, cut)
        many = np.repeat(cut, cut)
        mine = (mix(key[line[at]].view(_U)) % many.astype(_U)).astype(np.int64)
        other = np.arange(len(at)) - np.repeat(np.cumsum(cut) - cut, cut)
        p = np.empty(len(at), POSTING)
        pair = np.minimum(mine, other).astype(_U) << _U(32) | np.maximum(mine, other).astype(_U)
        p["cell"] = mix(w[at] + pair * _U(0x9E3779B97F4A7C15))
        p["key"], p["size"], p["position"] = key[line[at]], size[line[at]], position[at]
        p["s1"], p["s2"] = sketch[line[at]].T
        p["chunk"] = mine << 1 | (mine != other)
        yield p


def candidates(p: np.ndarray, least: float = LEAST, forest_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of set keys that the bounds leave, among postings of the same cell; or some that join the same sets.

    Cells that agree in 48 bits are compared as one, which only adds pairs to verify.
    """
    if p["size"].max(initial=0) < 1 << 16:
        order = np.lexsort((p["key"], p["cell"] & ~_U(0xFFFF) | p["size"]))
    else:
        order = np.lexsort((p["key"], p["size"], p["cell"] >> _U(16)))
    cell, key = p["cell"][order] >> _U(16), p["key"][order]
    new = np.ones(len(order), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1])
    order, cell, key = order[new], cell[new], key[new]
    size, position, s1, s2 = p["size"][order].astype(np.int64), p["position"][order].astype(np.int64), p["s1"][order], p["s2"][order]
    chunk, cross = p["chunk"][order] >> 1, (p["chunk"][order] & 1).astype(bool)
    # a set can only be the smaller of a pair if enough of it is left for a set of its own size
    i = np.flatnonzero(size - position >= overlap_needed(size, size, least))
    # partners follow it within the cell, up to the greatest size
    place = (np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]])) if len(cell) else cell.astype(np.int64)) << 32
    many = np.searchsorted(place + size, place[i] + np.floor(size[i] / least + 1e-9).astype(np.int64), side="right") - i - 1
    i, many = i[many > 0], many[many > 0]
    turn = np.cumsum(many) // PAIRED
    a_out, b_out, held = [], [], 0
    for k in np.flatnonzero(np.bincount(turn)) if len(i) else ():
        lo, hi = np.searchsorted(turn, [k, k + 1])
        x = np.repeat(i[lo:hi], many[lo:hi])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
        both = size[x] + size[y]
        most = both * (1 - least) / (1 + least) + 1e-9
        near = np.flatnonzero(np.bitwise_count((s1[x] ^ s1[y]) & _ODD) + np.bitwise_count((s2[x] ^ s2[y]) & _ODD) <= most)
        x, y, both, most = x[near], y[near], both[near], most[near]
        near = (np.minimum(size[x] - position[x], size[y] - position[y]) >= overlap_needed(size[x], size[y], least)) & (~cross[x] | (chunk[x] != chunk[y]))
        x, y, most = x[near], y[near], most[near]
        ok = difference(np.stack([s1[x], s2[x]], 1), np.stack([s1[y], s2[y]], 1)) <= most
        if ok.any():
            a_out.append(key[x[ok]])
            b_out.append(key[y[ok]])
            held += len(a_out[-1])
            if forest_only and held > 300_000:  # a long list's pairs are not held
                u, v = forest(np.concatenate(a_out), np.concatenate(b_out))
                a_out, b_out, held = [u], [v], 0
    if not a_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same sets as the pairs: each set to the first it reaches."""
    if not len(u):
        return u, v
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = joined(len(ids), at[: len(u)], at[len(u) :])
    on = np.flatnonzero(root != np.arange(len(ids)))
    return ids[on], ids[root[on]]


def verified(cell: np.ndarray, size: np.ndarray, flat: np.ndarray, chunk: np.ndarray, cross: np.ndarray, rank: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Per set: its links within its cell, and the least rank among them (or a large number). ``flat``: the sets' words one after the other."""
    n = len(size)
    links, lowest = np.zeros(n, np.int64), np.full(n, LAST)

    def add(i: np.ndarray, j: np.ndarray, both: np.ndarray) -> None:
        ok = (both + 1e-9 >= least * (size[i] + size[j] - both)) & (~cross[i] | (chunk[i] != chunk[j]))
        i, j = i[ok], j[ok]
        np.add.at(links, i, 1)
        np.add.at(links, j, 1)
        np.minimum.at(lowest, i, rank[j])
        np.minimum.at(lowest, j, rank[i])

    row = np.repeat(np.arange(n), size)
    many = np.bincount(cell)
    big = np.flatnonzero(many > DENSE)
    small = many[cell[row]] <= DENSE
    r, e = row[small], flat[small]
    order = np.lexsort((r, e, cell[r]))
    r, e = r[order], e[order]
    i, d, pairs, counts = np.arange(len(r)), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(i):
        d += 1
        i = i[i + d < len(r)]
        i = i[(e[i] == e[i + d]) & (cell[r[i]] == cell[r[i + d]])]
        p, c = np.unique(r[i] * n + r[i + d], return_counts=True)
        pairs, counts = np.concatenate([pairs, p]), np.concatenate([counts, c])
    if len(pairs):
        p, at = np.unique(pairs, return_inverse=True)
        add(p // n, p % n, np.bincount(at, counts).astype(np.int64))
    for c in big:
        on = np.flatnonzero(cell == c)
        mine = np.isin(row, on)
        e, col = np.unique(flat[mine], return_inverse=True)
        r = np.searchsorted(on, row[mine])
        both = np.zeros((len(on), len(on)), np.float32)
        wide = max(64, 4_000_000 // len(on))
        order = np.argsort(col, kind="stable")
        r, col = r[order], col[order]
        for lo in range(0, len(e), wide):
            a, b = np.searchsorted(col, [lo, lo + wide])
            m = np.zeros((len(on), min(wide, len(e) - lo)), np.float32)
            m[r[a:b], col[a:b] - lo] = 1
            both += m @ m.T
        i, j = np.nonzero(np.triu(both, 1) + 0.5 >= least / (1 + least) * (size[on][:, None] + size[on][None]))
        up = i < j
        i, j = i[up], j[up]
        add(on[i], on[j], np.rint(both[i, j]).astype(np.int64))
    return links, lowest


def _docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(t).alias("k1"), t.alias("text"))


def _merge_runs(batches: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_LINE = "id long, k1 long, number int, line_set long, slice int, blob binary"
_COUNT = np.dtype([("bucket", "u2"), ("n", "u4")])


def _numbered(d: DataFrame) -> DataFrame:
    """One reading of the texts: a row for each line that has words (its set's key), and the words' counts by bucket, packed in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        for b in _merge_runs(batches):
            h, line, row, no = line_words(b.column("text"))
            np.add.at(counts, (h >> _U(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
            line, w, _ = ordered_sets(h, line)
            k, size = set_keys(line, w, len(row))
            on = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row[on])), b.column("k1").take(pa.array(row[on])), pa.array(no[on].astype(np.int32)), pa.array(k[on]), pa.nulls(len(on), pa.int32()), pa.nulls(len(on), pa.binary())],
                ["id", "k1", "number", "line_set", "slice", "blob"],
            )
        some = np.flatnonzero(counts)
        packed = np.empty(len(some), _COUNT)
        packed["bucket"], packed["n"] = some % SLICE, counts[some]
        slices = np.unique(some // SLICE)
        ends = np.searchsorted(some, np.append(slices, len(counts) // SLICE) * SLICE)
        blobs = [packed[lo:hi].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        n = len(slices)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())), pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], ["id", "k1", "number", "line_set", "slice", "blob"])

    return d.mapInArrow(lean(run), _LINE)


def _rarity(numbered: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each bucket of words: 0 for one occurrence, else 1 + floor(log2(count)); words in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = -1, np.zeros(SLICE, np.int64)

        def done() -> pa.RecordBatch:
            level = np.where(n > 1, np.floor(np.log2(np.maximum(n, 1))) + 1, 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([int(n.sum())]), pa.array([level.tobytes()], pa.binary())], ["slice", "n", "level"])

        for b in batches:
            for k, blob in zip(b.column("slice").to_pylist(), b.column("blob"), strict=True):
                if k != last:
                    if last >= 0:
                        yield done()
                    last, n = k, np.zeros(SLICE, np.int64)
                c = np.frombuffer(blob.as_buffer(), _COUNT)
                n[c["bucket"]] += c["n"]
        if last >= 0:
            yield done()

    got = numbered.filter("slice IS NOT NULL").select("slice", "blob").repartition("slice").sortWithinPartitions("slice")
    got = got.mapInArrow(lean(run), "slice int, n long, level binary").toArrow()  # one byte a bucket
    level = np.zeros(1 << BUCKET_BITS, np.uint8)
    for k, v in zip(got["slice"].to_pylist(), got["level"].to_pylist(), strict=True):
        level[k * SLICE : (k + 1) * SLICE] = np.frombuffer(v, np.uint8)
    return level, sum(got["n"].to_pylist())


def clusters(d: DataFrame, level: np.ndarray, total: int, least: float) -> DataFrame:
    """(id, component) of every set that the bounds leave in a pair; similar sets are in one component."""
    spark = d.sparkSession
    sent = spark.sparkContext.broadcast(level)  # one byte a bucket
    shards = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (5 * SHARD) + 1)

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p = np.concatenate(held)
        shard = (p["cell"] % _U(shards)).astype(np.uint16 if shards < 1 << 16 else np.int64)
        p = p[np.argsort(shard, kind="stable")]
        many = np.bincount(shard, minlength=shards)
        own = np.flatnonzero(many)
        offsets = np.concatenate([[0], np.cumsum(many[own])]) * POSTING.itemsize
        blobs = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(p)])
        b, some = pa.RecordBatch.from_arrays([pa.array(own), blobs], ["shard", "blob"]), max(1, len(own) * 1_000_000 // (len(p) * POSTING.itemsize))
        yield from (b.slice(i, some) for i in range(0, len(own), some))  # some 1 MB each, so that the engine's buffers stay small

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        for b in _merge_runs(batches):
            h, line, row, _ = line_words(b.column("text"))
            line, w, lv = ordered_sets(h, line, sent.value)
            key, size = set_keys(line, w, len(row))
            take = np.zeros(len(row), bool)
            one = np.unique(key, return_index=True)[1]
            if len(seen) > 300_000:
                seen.clear()
            fresh_ = [i for i, k in zip(one, key[one].tolist(), strict=True) if k not in seen]
            take[fresh_] = True
            seen.update(key[fresh_].tolist())
            for p in postings(line, w, lv, key, size, take, least, LONG_LEVEL):
                held.append(p)
                if sum(map(len, held)) >= PACKED:
                    yield from packed(held)
                    held = []
        if held:
            yield from packed(held)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, []

        def done() -> pa.RecordBatch:
            u, v = forest(*candidates(np.concatenate([np.frombuffer(x, POSTING) for x in held]), least, True))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            for k, blob in zip(b.column("shard").to_pylist(), b.column("blob"), strict=True):
                if k != last and held:
                    yield done()
                    held = []
                last = k
                held.append(blob.as_py())
        if held:
            yield done()

    p = d.select("text").mapInArrow(lean(deal), "shard long, blob binary").repartition("shard").sortWithinPartitions("shard")
    return connected(p.mapInArrow(lean(pair), "u long, v long"))


def _whole_cells(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Sorted rows as tables of at least ``rows`` rows that end where a cell ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) < rows:
            continue
        t = pa.Table.from_batches(held)
        k = np.stack([t[x].to_numpy() for x in by], 1)
        new = np.flatnonzero((k != k[-1]).any(1))
        if len(new):
            cut = int(new[-1]) + 1
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def similar_sets(d: DataFrame, level: np.ndarray, total: int, classes: DataFrame, least: float) -> DataFrame:
    """Per set with any: line_set, its number of similar sets (``links``), and the first line among them (``other``)."""
    c = clusters(d, level, total, least).withColumnRenamed("id", "line_set")
    where = written(classes.join(c, "line_set").select("line_set", "component", "first.id", "first.k1", "first.number"), "where")
    need = where.groupBy("id", "k1").agg(F.collect_list(F.struct("number", "line_set", "component")).alias("own"))  # lines of one document
    need = F.broadcast(need) if where.count() * 48 <= BROADCAST_BYTES else need
    chosen = d.join(need, ["id", "k1"]).dropDuplicates(["id", "k1"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _merge_runs(batches, 2_000_000):
            h, line, row, _ = line_words(b.column("text"))
            line, w, _ = ordered_sets(h, line)
            ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(row)))])
            own = b.column("own")
            at = np.repeat(np.arange(len(b)), np.asarray(own.value_lengths()))
            own = own.flatten()
            number = own.field("number").to_numpy()
            i = np.searchsorted(row, at) + number
            size = ends[i + 1] - ends[i]
            begin = np.concatenate([[0], np.cumsum(size)])
            flat = np.repeat(ends[i] - begin[:-1], size) + np.arange(begin[-1])
            bag = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(w[flat].view(np.int64)))
            yield pa.RecordBatch.from_arrays([own.field("component"), own.field("line_set"), b.column("id").take(pa.array(at)), b.column("k1").take(pa.array(at)), pa.array(number), bag], ["component", "line_set", "id", "k1", "number", "set"])

    kept = written(chosen.select("id", "k1", "text", "own").mapInArrow(lean(sets), "component long, line_set long, id long, k1 long, number int, set array<long>"), "sets")
    load = kept.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum(F.size("set")) / CELL_WORDS)).cast("int").alias("chunks")).filter("chunks > 1")
    j = kept.join(written(load, "load"), "component", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    j = j.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "line_set"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    j = j.select("component", F.least("chunk", "o").alias("a"), F.greatest("chunk", "o").alias("b"), "chunk", "line_set", "id", "k1", "number", "set")
    j = j.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches, ["component", "a", "b"], 2000):
            k = np.stack([t[x].to_numpy() for x in ("component", "a", "b")], 1)
            cell = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).any(1).astype(np.int64)]))
            first = [t[x].to_numpy() for x in ("id", "k1", "number")]
            order = np.lexsort(first[::-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            bag = t["set"].combine_chunks()
            links, lowest = verified(cell, np.asarray(bag.value_lengths()).astype(np.int64), bag.flatten().to_numpy(), t["chunk"].to_numpy(), k[:, 1] != k[:, 2], rank, least)
            on = np.flatnonzero(links)
            to = order[lowest[on]]
            yield pa.RecordBatch.from_arrays([pa.array(t["line_set"].to_numpy()[on]), pa.array(links[on]), *(pa.array(x[to]) for x in first)], ["line_set", "links", "id", "k1", "number"])

    found = j.mapInArrow(lean(check), "line_set long, links long, id long, k1 long, number int")
    return found.groupBy("line_set").agg(F.sum("links").alias("links"), F.min(F.struct("id", "k1", "number")).alias("other"))


def marks(docs: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """Per document (id, k1) with any: removed line numbers (from 0), and the number of similarity links of its lines."""
    d = _docs(docs, key, text)
    numbered = written(_numbered(d), "lines")
    level, total = _rarity(numbered)
    at = F.struct("id", "k1", "number")
    lines = numbered.filter("slice IS NULL").select("id", "k1", "number", "line_set")
    classes = written(lines.groupBy("line_set").agg(F.min(at).alias("first"), F.count("*").alias("n")), "classes")
    similar = similar_sets(d, level, total, classes, least)
    of = classes.join(similar, "line_set", "left").filter("n > 1 OR links IS NOT NULL")
    of = written(of.select("line_set", F.least("first", "other").alias("earliest"), F.coalesce("links", F.lit(0)).alias("links")), "earliest")
    hit = lines.join(of, "line_set").withColumn("goes", at > F.col("earliest"))
    hit = hit.groupBy("id", "k1").agg(F.array_sort(F.collect_set(F.when(F.col("goes"), F.col("number")))).alias("removed"), (F.sum("links") * F.size(F.collect_set("number")) / F.count("*")).cast("long").alias("n_links"))  # of repeated rows one counts
    out = written(hit, "marks")
    discard(numbered, classes, of)
    return out


def dedup(docs: DataFrame, key: str, text: str, least: float = LEAST, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` without the removed lines; with ``counts`` also n_lines, n_removed, n_links (in place of columns so named)."""
    m = marks(docs, key, text, least)
    size = m.agg(F.coalesce(F.sum(F.size("removed") * 4 + 64), F.lit(0))).first()[0]
    few = F.broadcast(m) if size <= BROADCAST_BYTES else m
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed", "n_links")]
    names = fresh(docs.columns, "id", "k1", "removed", "links")
    d = docs.select("*", F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias(names[0]), F.xxhash64(t).alias(names[1]))
    d = d.join(few.toDF(*names), names[:2], "left")
    n = F.coalesce(F.size(names[2]), F.lit(0))
    cut = F.array_join(F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains(names[2], i)), "\n")
    out = [(F.when(n > 0, cut).otherwise(F.col(text)).alias(c) if c == text else F.col(c)) for c in own]
    if counts:
        lines = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
        out += [lines.cast("int").alias("n_lines"), n.alias("n_removed"), F.coalesce(names[3], F.lit(0)).cast("long").alias("n_links")]
    return d.select(*out)
