"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets.

*Signature.* A text is the multiset of its 5-word shingles. Each shingle carries a marked Poisson process over
(time, weight); a shingle of weight w owns the points at or below w. The weight axis is cut into doubling cells, so a
weight needs about log2(w) processes, and a point of a cell that w only reaches into is kept or dropped by its own
height. Every point falls on one of ``PLACES`` places; a place's value is the earliest point of the text's shingles
there, so two texts agree on a place with exactly the probability of their weighted Jaccard similarity. Points are
drawn up to a time by which all places are met, per text, and further only where one is not: the work follows
PLACES*log(PLACES) + shingles and not their product.

*Bands.* ``BANDS`` bands of 4 places make buckets; at similarity 0.8 a pair misses all with probability 2e-4.

*Verification.* Equal texts are one class. In each bucket a leader, the member that shares most buckets, is compared with
all members; in buckets that links have not joined, a second leader with the members of other groups. What then still
is in different groups of a bucket is compared all with all, in cells of bounded size (chunks of a bucket against
chunks), which give edges of a spanning forest and never pairs. So every pair of a bucket is compared unless links join
it already, and groups equal those of comparing all pairs. Comparisons are of whole multisets, by sums of minima over
sums of maxima.

Bands are dealt by bucket as narrow rows and reduced before they are joined; texts of bucketed classes only are read
again to be compared. No group of copies is gathered.

Defined results: null texts are empty; texts without words link with nothing, not even with each other; texts of one to
four words are one shingle; equal texts group whatever their keys; repeated rows are equal texts; a null key stands
after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import buffer_of, words
from .components import connected, joined, numbered
from .runtime import discard, fresh, lean, small, written

WORDS, PLACES, BANDS = 5, 64, 16
LEAST, LEADER_ROUNDS = 0.8, 2
#: Rows and elements of a chunk of a bucket that is compared all with all.
CELL_ROWS, CELL_ELEMENTS = 1024, 1_500_000
#: Bytes of texts that are turned into shingles at once.
BYTES_AT_ONCE = 600_000
LAST = 2**63 - 1

_U = np.uint64
_A, _B, _C, _D = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
#: Bits of a shingle's hash that are kept; the rest of the word numbers the text in its run.
_KEEP = 52


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def shingle_runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row from the first, shingle) in runs of bounded size: all shingles, sorted by row and hash."""
    data, offsets = buffer_of(texts)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1)
        to = min(to, at + (1 << (64 - _KEEP)) - 1)
        cuts = offsets[at : to + 1] - offsets[at]
        start, _, h = words(data[offsets[at] : offsets[to]], cuts)
        row = np.searchsorted(cuts, start, side="right") - 1
        count = np.bincount(row, minlength=to - at)
        ends = np.cumsum(count)
        s = h[: max(0, len(h) - WORDS + 1)].copy()
        for k in range(1, WORDS):
            s = _mix(s * _A + h[k : k + len(s)])
        own = np.flatnonzero(np.arange(len(s)) + WORDS <= ends[row[: len(s)]])
        rows, vals = [row[own]], [s[own]]
        for i in np.flatnonzero((count > 0) & (count < WORDS)):
            v = np.array([count[i]], dtype=_U)
            for x in h[ends[i] - count[i] : ends[i]]:
                v = _mix(v * _A + x)
            rows.append(np.array([i]))
            vals.append(v)
        key = (np.concatenate(rows).astype(_U) << _U(_KEEP)) | (np.concatenate(vals) >> _U(64 - _KEEP))
        key.sort()
        yield at, to - at, (key >> _U(_KEEP)).astype(np.int64), key & _U((1 << _KEEP) - 1)
        at = to


def signatures(rows: int, row: np.ndarray, shingle: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Earliest point at each place for each row; inf where a row has no shingle. Input as of :func:`shingle_runs`."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])]) if len(row) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(row)))
    r0, s0 = row[start], shingle[start]
    total = np.bincount(row, minlength=rows).astype(float)
    out = np.full((rows, places), np.inf)
    limit = places * (np.log(places) + 3) / np.maximum(total, 1)
    # cells of the weight axis: (0,1], (1,2], (2,4], (4,8], ...
    cells = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64), 0) + 1
    node = np.repeat(np.arange(len(start)), cells)
    level = np.arange(len(node)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = _mix(s0[node] * _A + level.astype(_U) * _D + _B)
    todo = total > 0
    while todo.any():
        on = np.flatnonzero(todo[r0[node]])
        r, sd, wd, lo, w, x = r0[node[on]], seed[on], width[on].astype(float), low[on], weight[node[on]], np.zeros(len(on))
        out[todo] = np.inf
        flat = out.reshape(-1)
        j = 0
        while len(r):
            j += 1
            u = _mix(sd + _U(j * 2 * int(_A) % 2**64))
            x = x - np.log(((u >> _U(11)).astype(float) + 0.5) * 2.0**-53) / wd
            ok = x <= limit[r]
            if not ok.all():
                r, sd, wd, lo, w, x = r[ok], sd[ok], wd[ok], lo[ok], w[ok], x[ok]
            if not len(r):
                break
            v = _mix(sd + _U((j * 2 + 1) * int(_A) % 2**64))
            place = (v % _U(places)).astype(np.int64)
            height = lo + 1 + ((v >> _U(32)) % wd.astype(_U)).astype(np.int64)
            own = height <= w
            np.minimum.at(flat, (r * places + place)[own], x[own])
        missing = todo & np.isinf(out).any(1)
        limit = np.where(missing, limit * 2, limit)
        todo = missing
    return out


def bands(sig: np.ndarray, n: int = BANDS) -> np.ndarray:
    """One 64-bit bucket key per band; band and values of its places hashed."""
    v = np.ascontiguousarray(sig).view(_U).reshape(len(sig), n, -1)
    k = np.broadcast_to(np.arange(1, n + 1, dtype=_U) * _D, v.shape[:2])
    for i in range(v.shape[2]):
        k = _mix(k * _A + v[:, :, i])
    return k.view(np.int64)


def elements(row: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """Shingle and its how-manieth occurrence in the row, hashed: a multiset as a set."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])]) if len(row) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    return _mix(shingle * _A + (np.arange(len(row)) - first).astype(_U) * _D).view(np.int64)


_NODE = T.StructType([T.StructField("id", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), t.alias("text"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(6), t).alias("k2"))


def _signed(d: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, row, shingle in shingle_runs(b.column("text")):
                size = np.bincount(row, minlength=n)
                k = bands(signatures(n, row, shingle))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(k.ravel()))
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k1"), part.column("k2"), pa.array(size), flat], ["id", "k1", "k2", "size", "bands"])

    return d.select("id", "k1", "k2", "text").mapInArrow(lean(run), "id long, k1 long, k2 long, size long, bands array<long>")


def _multisets(d: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, row, shingle in shingle_runs(b.column("text")):
                ends = np.searchsorted(row, np.arange(n + 1))
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(elements(row, shingle)))
                yield pa.RecordBatch.from_arrays([b.slice(at, n).column("node"), flat], ["node", "bag"])

    return d.select("node", "text").mapInArrow(lean(run), T.StructType([T.StructField("node", _NODE), T.StructField("bag", T.ArrayType(T.LongType()))]))


def _verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Of the pairs (u, v, and their groups cu, cv) those whose multisets are similar, as links (u, v) of groups."""
    j = pairs.join(bags.select(F.col("node").alias("u"), F.col("bag").alias("bu")), "u").filter(F.size("bu") > 0)
    j = j.join(bags.select(F.col("node").alias("v"), F.col("bag").alias("bv")), "v")
    both = F.size(F.array_intersect("bu", "bv"))
    return j.filter(both + 1e-9 >= least * (F.size("bu") + F.size("bv") - both)).select(F.col("cu").alias("u"), F.col("cv").alias("v"))


def link_cell(size: np.ndarray, flat: np.ndarray, comp: np.ndarray, chunk: np.ndarray, cross: bool, least: float) -> np.ndarray:
    """Smallest row that each row of a cell reaches by links between groups; ``flat``: the rows' elements one after the other."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    e, r = flat[order], row[order]
    first = np.concatenate([[True], e[1:] != e[:-1]]) if len(e) else np.zeros(0, bool)
    col = np.cumsum(first) - 1
    often = np.bincount(col, minlength=1)[col] > 1 if len(col) else np.zeros(0, bool)
    r, col = r[often], col[often]
    both = np.zeros((n, n), np.float32)
    wide = max(64, 4_000_000 // max(n, 1))
    if len(col):
        col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)]))
        for lo in range(0, int(col[-1]) + 1, wide):
            a, b = np.searchsorted(col, [lo, lo + wide])
            m = np.zeros((n, min(wide, int(col[-1]) + 1 - lo)), np.float32)
            m[r[a:b], col[a:b] - lo] = 1
            both += m @ m.T
    ok = (both > 0) & (both + 1e-9 >= least * (size[:, None] + size[None] - both.astype(np.float64))) & (comp[:, None] != comp[None])
    if cross:
        ok &= chunk[:, None] != chunk[None]
    i, j = np.nonzero(ok)
    return joined(n, i, j)


def _cells(place: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of groups within buckets, all members compared with all of other groups."""
    load = place.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("size") / CELL_ELEMENTS)).cast("int").alias("chunks"))
    c = place.select("bucket", "node", "comp").join(load, "bucket")
    c = c.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    c = c.select("bucket", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "comp", "node").join(bags, "node")
    c = c.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            bag, comp = t["bag"].combine_chunks(), t["comp"].combine_chunks()
            group = numbered([comp.field(f).to_numpy() for f in ("id", "k1", "k2")])[1]
            root = link_cell(np.asarray(bag.value_lengths()), bag.flatten().to_numpy(), group, t["chunk"].to_numpy(), last[1] != last[2], least)
            i = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([comp.take(pa.array(i)), comp.take(pa.array(root[i]))], ["u", "v"])

        for batch in batches:
            cell = np.stack([batch.column(x).to_numpy() for x in ("bucket", "a", "b")], 1) if len(batch) else np.zeros((0, 3), np.int64)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1), len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if held and last != tuple(cell[lo]):
                    yield done()
                    held = []
                last = tuple(cell[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return c.mapInArrow(lean(run), T.StructType([T.StructField("u", _NODE), T.StructField("v", _NODE)]))


def group(docs: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: key, k1, k2 (hashes of the text), class_id (smallest key of its group), kept (the group's one text stays).

    Other columns of ``docs`` are not read and may have any name.
    """
    d = _keyed(docs, key, text)
    sig = written(_signed(d), "signatures")
    classes = written(sig.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")), "classes")
    node = F.struct("id", "k1", "k2").alias("node")
    member = classes.filter("size > 0").select(node, "size", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(member.join(shared, "bucket"), "buckets")
    some = written(buckets.groupBy("node").agg(F.sum("n").alias("met")), "bucketed")
    chosen = d.join(small(some.select("node.*"), 24), ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select(node, "text")
    bags = written(_multisets(chosen), "bags")
    place = written(buckets.join(some, "node").select("bucket", "node", "size", "met", F.col("node").alias("comp")), "open")
    discard(buckets, some)
    moves: list[DataFrame] = []  # of each round: group, the group that it joined
    fits = F.least("size", "lsize") >= least * F.greatest("size", "lsize")
    for r in range(LEADER_ROUNDS + 1):
        if r < LEADER_ROUNDS:  # a leader for each bucket, another in each round
            rank = F.struct("met", F.xxhash64(F.lit(r), "node")) if r == 0 else F.struct(F.xxhash64(F.lit(r), "node"))
            lead = place.groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("leader"), F.col("size").alias("lsize"), F.col("comp").alias("lcomp")), rank).alias("l")).select("bucket", "l.*")
            pairs = place.join(lead, "bucket").filter((F.col("comp") != F.col("lcomp")) & fits)
            pairs = pairs.select(F.col("node").alias("u"), F.col("leader").alias("v"), F.col("comp").alias("cu"), F.col("lcomp").alias("cv")).repartition("u").distinct()
            move = written(connected(_verified(pairs, bags, least)), "moves")
        else:
            move = written(connected(_cells(place, bags, least)), "moves")
        moves.append(move)
        if r < LEADER_ROUNDS:  # buckets with members of more than one group are left
            before = place
            place = place.join(move.withColumnRenamed("id", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
            open_ = place.groupBy("bucket").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("bucket")
            place = written(place.join(open_, "bucket"), "open")
            discard(before)
            if place.isEmpty():
                break
    steps = moves[0].select(F.col("id").alias("u"), F.col("component").alias("v"))
    for m in moves[1:]:
        steps = steps.unionByName(m.select(F.col("id").alias("u"), F.col("component").alias("v")))
    comp = written(connected(steps), "groups") if len(moves) > 1 else moves[0]
    of = classes.select("k1", "k2", node).join(comp.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", "node", F.coalesce("component", "node").alias("component"))
    out = sig.select("id", "k1", "k2", "size").join(of, ["k1", "k2"])
    alone = F.col("size") == 0
    own = F.when(F.col("id") == LAST, F.lit(None).cast("long")).otherwise(F.col("id"))
    return out.select(
        own.alias("key"), "k1", "k2", F.when(alone, own).otherwise(F.col("component.id")).alias("class_id"),
        (alone | ((F.col("node") == F.col("component")) & (F.col("id") == F.col("component.id")))).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each group; of repeated rows one stays.

    All columns of ``docs`` are kept, whatever their names.
    """
    g = written(group(docs, key, text, least).withColumn("id", F.coalesce("key", F.lit(LAST))), "near")
    out = g.filter("NOT kept").select("id", "k1", "k2").distinct()
    again = g.filter("kept AND class_id IS NOT NULL").groupBy("id", "k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    empty = F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")) == ""
    names = fresh(docs.columns, "id", "k1", "k2")
    d = docs.select("*", F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias(names[0]), F.xxhash64(t).alias(names[1]), F.xxhash64(F.lit(6), t).alias(names[2]))
    out, again = (written(x.toDF(*names), "keys") for x in (out, again))
    rows = d.join(small(out, 24), names, "left_anti")
    if not again.isEmpty():
        few = small(again, 24)
        twice = rows.join(few, names, "left_semi")
        rows = rows.join(few, names, "left_anti").unionByName(twice.filter(empty)).unionByName(twice.filter(~empty).dropDuplicates(names))
    return rows.drop(*names)
