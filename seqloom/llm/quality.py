"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of word n-grams (1, 2) and of word-shape n-grams (1 to 3; case, last character, length,
repetition of the word before), hashed to ``2**BITS``. Class log-count ratios r come from all labelled training rows.
A linear hinge-loss model over the indicators scaled by r (rows of unit length) is fitted by dual coordinate descent
on at most ``SAMPLE`` rows of each class, those of smallest key hash: the bound of the fit. Equal rows of a key count
once there, and a key's second row comes after the first rows of all sampled keys. A logistic curve over the margins, weighted to the classes' shares among all training rows, makes a score from 0 to 1.

Texts are read once to count and once to score, and are not shuffled where the labels' bytes allow a broadcast;
beyond that labels and texts are joined by a shuffle, with the same result. A task's counts travel as packed slices of
the buckets.

Defined results: null and empty texts have no feature and score as the bias; labels other than 0 and 1 (null too) are
no labels; a key with several labels counts for each; without training rows of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytewords import buffer_of, words
from .runtime import BROADCAST_BYTES, discard, give_back, lean, written

BITS, SAMPLE, SLICE = 20, 4000, 4096
C, EPOCHS, BETA, SEED = 1.0, 12, 0.25, 3
#: Bytes of texts that are turned into features at once; rows of the fit that a task remembers.
BYTES_AT_ONCE, MET = 600_000, 60_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


def shape(word: bytes) -> int:
    """Case, last character and length of a word, as a number below 256."""
    body = word.decode("utf-8", "replace")
    letters = [c for c in body if c.isalpha()]
    case = 0 if not letters else 1 if all(c.islower() for c in letters) else 2 if all(c.isupper() for c in letters) and len(letters) > 1 else 3 if letters[0].isupper() and all(c.islower() for c in letters[1:]) else 4
    if any(c.isdigit() for c in body):
        case += 5 if case < 3 else 0
    last = body[-1]
    end = 0 if last.isalnum() else 1 if last == "." else 2 if last == "," else 3 if last in "!?" else 4 if last in "|<>{}[]()/\\=_" else 5 if last in "*#$%&@^~+" else 6
    size = 0 if len(body) < 3 else 1 if len(body) < 7 else 2 if len(body) < 16 else 3
    return (min(case, 7) * 8 + end) * 4 + size


_LAST = np.full(128, 6)
_LAST[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
for _k, _chars in ((1, b"."), (2, b","), (3, b"!?"), (4, b"|<>{}[]()/\\=_"), (5, b"*#$%&@^~+")):
    _LAST[list(_chars)] = _k


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`shape` of each word: off the buffer for words of ASCII only, one by one for others."""

    def count(on: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(on)])
        return total[end] - total[start]

    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | (data >= 0x61) & (data <= 0x7A)
    caps, letters, digits = count(upper), count(letter), count((data >= 0x30) & (data <= 0x39))
    first = np.append(np.flatnonzero(letter), 0)[np.searchsorted(np.flatnonzero(letter), start)]
    case = np.where(letters == 0, 0, np.where(caps == 0, 1, np.where((caps == letters) & (letters > 1), 2, np.where((caps == 1) & upper[first], 3, 4)))) if len(data) else letters
    case = np.minimum(np.where((digits > 0) & (case < 3), case + 5, case), 7)
    size = np.searchsorted([3, 7, 16], end - start, side="right")
    out = (case * 8 + _LAST[data[end - 1] & 127]) * 4 + size
    for i in np.flatnonzero(count(data >= 0x80)):
        out[i] = shape(data[start[i] : end[i]].tobytes())
    return out


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature from the first, bucket): distinct features, by row, in runs of bounded size."""
    data, offsets = buffer_of(texts)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, side="right")) - 1)
        own, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        start, end, h = words(own, cuts, True)
        row = np.searchsorted(cuts, start, side="right") - 1
        h, s = h >> np.uint64(8), shapes(own, start, end).astype(np.uint64)
        same = row[1:] == row[:-1]
        s = s * np.uint64(2)
        s[1:] += (same & (h[1:] == h[:-1])).astype(np.uint64)
        two, three = np.flatnonzero(same), np.flatnonzero(same[1:] & same[:-1])
        parts = [
            (row, _mix(h)),
            (row[two], _mix(h[two] * _M2 + h[two + 1])),
            (row, _mix(s + _M3)),
            (row[two], _mix((s[two] << np.uint64(9) | s[two + 1]) + _M2)),
            (row[three], _mix((s[three] << np.uint64(18) | s[three + 1] << np.uint64(9) | s[three + 2]) + _M1)),
        ]
        key = np.concatenate([(r.astype(np.uint64) << np.uint64(BITS)) | (x >> np.uint64(64 - BITS)) for r, x in parts])
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        yield at, to - at, (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
        at = to


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: float = C, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine; x: (columns, values) of each row."""
    w, b, alpha = np.zeros(dim), 0.0, np.zeros(len(x))
    q = np.array([(v * v).sum() + 1 for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            cols, v = x[i]
            g = y[i] * (w[cols] @ v + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                moved = max(moved, abs(d))
                w[cols] += d * v
                b += d
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1/(1+exp(-(a*m+b))) by Newton steps, with a little pull towards 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([(weight * (p - y) * m).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a, b


class Model:
    """Weights of the buckets, bias, ratios and the curve."""

    def __init__(self, weight: np.ndarray, bias: float, ratio: np.ndarray, a: float, b: float) -> None:
        self.weight, self.bias, self.ratio, self.a, self.b = weight, bias, ratio, a, b
        self.scaled = weight * ratio

    def __getstate__(self) -> dict:
        """What scoring needs: the weights stay on the driver."""
        return {k: v for k, v in self.__dict__.items() if k != "weight"}

    def margins(self, rows: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        r = self.ratio[bucket]
        norm = np.sqrt(np.bincount(row, r * r, rows))
        return np.bincount(row, self.scaled[bucket], rows) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -35, 35)))


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str) -> Model | None:
    """Fits on the rows of ``labels`` (already those to learn from); None without rows of both classes."""
    model = _train(docs, key, text, labels, label_key, label)
    give_back()  # the driver's memory of the sample
    return model


def _train(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str) -> Model | None:
    lab = labels.select(F.col(label_key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    lab = lab.withColumn("h", F.xxhash64(F.lit(SEED), "k"))
    cut = {}
    for y in (0, 1):
        rows = lab.filter(F.col("y") == y).select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h"), F.count("*")).first()
        if not rows[1]:
            return None
        cut[y] = rows[0]
    lab = lab.withColumn("sampled", F.col("h") <= F.when(F.col("y") == 1, cut[1]).otherwise(cut[0]))
    if lab.count() * 40 <= BROADCAST_BYTES:
        lab = F.broadcast(lab)
    d = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(lab, "k").select("t", "y", "h", "sampled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows, met = np.zeros((2, 1 << BITS), np.uint32), np.zeros(2, np.int64), set()
        for b in batches:
            y, h, sampled = b.column("y").to_numpy(), b.column("h").to_numpy(), b.column("sampled").to_numpy(zero_copy_only=False)
            ys, hs, fs = [], [], []
            for first, many, row, bucket in features(b.column("t")):
                np.add.at(n, (y[first + row], bucket), np.uint32(1))
                rows += np.bincount(y[first : first + many], minlength=2)
                cuts = np.searchsorted(row, np.arange(many + 1))
                for i in np.flatnonzero(sampled[first : first + many]):
                    f = bucket[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes()
                    one = (int(y[first + i]), int(h[first + i]), xxhash.xxh64_intdigest(f))
                    if one not in met:
                        if len(met) >= MET:
                            met.clear()
                        met.add(one)
                        ys.append(one[0])
                        hs.append(one[1])
                        fs.append(f)
            if ys:
                m = len(ys)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.array(fs, pa.binary()), pa.array(ys, pa.int32()), pa.array(hs, pa.int64())], ["slice", "f", "y", "h"])
        some = np.flatnonzero(n.any(0))
        packed = np.empty(len(some), _COUNT)
        packed["bucket"], packed["n"] = some % SLICE, n[:, some].T
        slices = np.unique(some // SLICE)
        ends = np.searchsorted(some, np.append(slices, (1 << BITS) // SLICE) * SLICE)
        blobs = [packed[lo:hi].tobytes() for lo, hi in pairwise(ends)] + [rows.tobytes()]  # the last: rows of each class
        m = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array([*slices.tolist(), -1], pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], ["slice", "f", "y", "h"])

    got = written(d.mapInArrow(lean(count), "slice int, f binary, y int, h long"), "ngrams")
    sums = got.filter("slice IS NOT NULL").select("slice", "f").repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(_summed), "slice int, f binary").toArrow()  # 2**BITS pairs at most
    n, rows = np.zeros((2, 1 << BITS)), np.zeros(2)
    for k, f in zip(sums["slice"].to_pylist(), sums["f"].to_pylist(), strict=True):
        v = np.frombuffer(f, np.int64).reshape(2, -1)
        if k < 0:
            rows += v[:, 0]
        else:
            n[:, k * SLICE : (k + 1) * SLICE] = v
    sample = pa.concat_tables(fit_rows(got, c).toArrow() for c in (0, 1))
    discard(got)
    y = np.where(sample["y"].to_numpy() == 1, 1.0, -1.0)
    if rows.min() == 0 or len(set(y)) < 2:
        return None
    ratio = np.log((n[1] + 1) / (n[1] + 1).sum()) - np.log((n[0] + 1) / (n[0] + 1).sum())
    ratio[n.sum(0) == 0] = 0.0
    x = []
    for f in sample["f"]:
        cols = np.frombuffer(f.as_buffer(), np.int32)
        v = ratio[cols]
        x.append((cols, v / max(np.sqrt((v * v).sum()), 1e-12)))
    w, b = dual_coordinate_descent(x, y, 1 << BITS)
    mean = np.abs(w).sum() / max(1, (w != 0).sum())
    w = (1 - BETA) * mean + BETA * w  # interpolated towards plain Naive Bayes
    m = np.array([w[cols] @ v + b for cols, v in x])
    share = np.where(y > 0, rows[1] / (y > 0).sum(), rows[0] / (y < 0).sum())
    return Model(w, b, ratio, *logistic(m, (y > 0).astype(float), share / share.sum() * len(y)))


_COUNT = np.dtype([("bucket", "u2"), ("n", "u4", 2)])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of each slice (rows sorted by it), as its counts for class 0, then for class 1."""
    last, n = None, np.zeros((2, SLICE), np.int64)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["slice", "f"])

    for b in batches:
        for k, f in zip(b.column("slice").to_pylist(), b.column("f").to_pylist(), strict=True):
            if k != last:
                if last is not None:
                    yield done()
                last, n = k, np.zeros((2, SLICE), np.int64)
            if k < 0:
                n[:, 0] += np.frombuffer(f, np.int64)
            else:
                c = np.frombuffer(f, _COUNT)
                n[:, c["bucket"]] += c["n"].T
    if last is not None:
        yield done()


def fit_rows(got: DataFrame, y: int) -> DataFrame:
    """At most ``SAMPLE`` different rows of one class: the first of each key by key hash, then the second ones, and so on."""
    d = got.filter(F.col("y") == y).groupBy("h", F.xxhash64("f").alias("fh")).agg(F.first("f").alias("f"))
    turn = F.row_number().over(Window.partitionBy("h").orderBy("fh"))
    return d.withColumn("turn", turn).orderBy("turn", "h", "fh").limit(SAMPLE).orderBy("fh", "h").select(F.lit(y).alias("y"), "f")


def score(docs: DataFrame, key: str, text: str, model: Model | None, *more: str | Column, name: str = "quality_score") -> DataFrame:
    """Key, ``more`` columns and the score, called ``name``, which none of them should be called (:func:`.runtime.fresh` gives a free one)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**BITS numbers

    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for t in col:
            out = np.full(len(t), 0.5)
            if m is not None:
                for first, many, row, bucket in features(t):
                    out[first : first + many] = m.scores(m.margins(many, row, bucket))
            yield pa.array(out)

    udf = F.arrow_udf(lean(run), "double")
    return docs.select(F.col(key), *more, udf(F.col(text).cast("string")).alias(name))
