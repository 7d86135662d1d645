"""Ranked lexical search: MaxScore over shards of postings, for a stated set of queries against all documents.

Terms are runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased. A document's score for a query is the
sum over the query's terms, repeats included, of ``w * ((10**9 * tf) div (1000 * tf + 12 * m))`` with
``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and ``m = 75 + (25 n N) div L``, all else in 64-bit integers.

1. The queries' distinct terms go out as hashes (queries are taken in blocks of ``BLOCK_TERMS`` terms, so that is bounded).
2. One pass over all documents cuts them into shards of bounded postings: for each query term of the shard its documents
   and counts, packed. Shards are written, and give N, L and df by a sum over their rows.
3. Each task works its shards off. In a shard a term's list has an upper bound, its largest contribution. Lists are ordered
   by it; those whose bounds together stay below the query's threshold (the k-th best score so far) are non-essential: no
   document of theirs alone can qualify. The essential lists give the candidates of a window of documents; the others are
   probed from the largest bound down, only for candidates whose score and remaining bounds still reach the threshold.
4. Each task gives its k best of a query; a window over the query keeps the k best of all.

No posting is dropped and no list is capped; nothing is shuffled but the tasks' k best. A term stands for its 64-bit hash
and its number of bytes: that two words agree in both is left out of account (1e9 distinct words against 10,000 terms: 1e-6).

Odd rows: null and empty texts have no terms and count nowhere; a query without terms gets no rows; documents of equal score
and id (repeated rows) each take a rank; a null id stands behind all others; queries that share an id are answered each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytewords import Lookup, buffer_of, words
from .runtime import lean, written

_RUNS = np.full(256, 0x20, np.uint8)  # all that is no part of a term becomes a blank
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _RUNS[_lo:_hi] = np.arange(_lo, _hi, dtype=np.uint8)

#: Terms, repeats included, of the queries that one pass over the documents serves.
BLOCK_TERMS = 500_000
#: Postings and documents of a shard; documents of a window.
POSTINGS, DOCS, WINDOW = 1_000_000, 1 << 15, 4096
#: Bytes of text that are split into terms at a time; a longer text is taken by itself.
STRETCH = 4 << 20
SHARD = "n_docs long, n_terms long, terms array<int>, sizes array<int>, ids binary, lengths binary, docs binary, tf binary"
FOUND = "item int, key long, score long"
_LAST = np.iinfo(np.int64).max


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, bytes) of each term of a string column, in order."""
    rows, hashes, sizes = [], [], []
    data, offsets = buffer_of(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        s, e, h = words(_RUNS[data[lo:hi]], offsets[at : to + 1] - lo)
        rows.append(np.searchsorted(offsets[at : to + 1] - lo, s, side="right") - 1 + at)
        hashes.append(h)
        sizes.append(e - s)
        at = to
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(sizes)


def _ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _shard(parts: list[tuple], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Postings (document, term, tf) of some batches as one packed row, by term and then document."""
    ids, lengths, docs, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
    order = np.argsort(term, kind="stable")  # documents are in order already
    found, sizes = np.unique(term, return_counts=True)
    one = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    many = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
    cols = [pa.array([n_docs]), pa.array([n_terms]), many(found), many(sizes), one(ids, np.int64), one(lengths, np.int64), one(docs[order], np.int32), one(tf[order], np.int32)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in SHARD.split(", ")])


def shards(docs: DataFrame, key: str, text: str, hashes: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """Shards of the postings that ``docs`` has of the terms (hash, bytes)."""
    sent = docs.sparkSession.sparkContext.broadcast((hashes, sizes.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = sent.value
        look = Lookup(own, np.arange(len(own)))
        parts, n_docs, n_terms, held, kept = [], 0, 0, 0, 0
        for b in batches:
            row, h, length = terms(b.column(1))
            n = np.bincount(row, minlength=b.num_rows)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + len(row)
            t = look.get(h).astype(np.int64)
            hit = np.flatnonzero(t >= 0)
            hit = hit[size[t[hit]] == length[hit]]
            pair, tf = np.unique(row[hit] * len(own) + t[hit], return_counts=True)
            r, t = pair // max(1, len(own)), pair % max(1, len(own))
            with_any = np.unique(r)
            parts.append((_ids(b.column(0))[with_any], n[with_any], np.searchsorted(with_any, r) + kept, t, tf))
            held, kept = held + len(t), kept + len(with_any)
            if held >= POSTINGS or kept >= DOCS:
                yield _shard(parts, n_docs, n_terms)
                parts, n_docs, n_terms, held, kept = [], 0, 0, 0, 0
        if n_docs:
            yield _shard(parts, n_docs, n_terms)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(lean(run), SHARD)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Best:
    """The k best (score, id) so far, highest first, then by id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """The score that a further document has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]


class Lists:
    """A shard's postings with their contributions, and each list's upper bound."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int) -> None:
        self.ids, lengths = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64)
        self.docs, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tf"], np.int32).astype(np.int64)
        sizes, term = np.array(row["sizes"], np.int64), np.array(row["terms"], np.int64)
        m = 75 + (25 * lengths * n) // max(1, total)
        self.gain = np.repeat(weights[term], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs]))
        ends = np.cumsum(sizes)
        self.place = dict(zip(term.tolist(), zip((ends - sizes).tolist(), ends.tolist(), strict=True), strict=True))
        self.bound = dict(zip(term.tolist(), (np.maximum.reduceat(self.gain, ends - sizes) if len(ends) else ends).tolist(), strict=True))


def maxscore(x: Lists, query: list[tuple[int, int]], best: Best) -> int:
    """Adds the shard's best documents for a query of (term, times) to ``best``; returns how many postings it looked at."""
    own = sorted((x.bound[t] * times, t, times) for t, times in query if t in x.place and x.bound[t] > 0)
    if not own:
        return 0
    bounds = np.cumsum([b for b, _, _ in own])  # of the lists up to each
    lists = [(x.docs[slice(*x.place[t])], x.gain[slice(*x.place[t])], times) for _, t, times in own]
    looked = 0
    for lo in range(0, len(x.ids), WINDOW):
        least = best.least()
        first = int(np.searchsorted(bounds, least))  # lists before it reach the threshold not even together
        if first == len(own):
            break
        score = np.zeros(min(WINDOW, len(x.ids) - lo), np.int64)
        for docs, gain, times in lists[first:]:
            a, b = np.searchsorted(docs, (lo, lo + WINDOW))
            score[docs[a:b] - lo] += gain[a:b] * times
            looked += int(b - a)
        can = np.flatnonzero(score > 0)
        for j in range(first - 1, -1, -1):
            can = can[score[can] + bounds[j] >= least]
            if not len(can):
                break
            docs, gain, times = lists[j]
            i = np.minimum(np.searchsorted(docs, can + lo), len(docs) - 1)
            hit = docs[i] == can + lo
            score[can[hit]] += gain[i[hit]] * times
            looked += len(can)
        can = can[score[can] >= least]
        if len(can):
            best.add(score[can], x.ids[lo + can])
    return looked


def _block(docs: DataFrame, key: str, text: str, items: list[list[tuple[int, int]]], hashes: np.ndarray, sizes: np.ndarray, k: int) -> DataFrame:
    """(item, key, score): each task's k best of every query of a block."""
    cut = written(shards(docs, key, text, hashes, sizes), "postings")
    n, total = cut.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(hashes), np.int64)
    each = cut.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    for t, c in each.collect():  # a row a term of the block at most
        df[t] = c
    sent = docs.sparkSession.sparkContext.broadcast((items, np.array([weight(n, int(c)) for c in df], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        best = [Best(k) for _ in items]
        for b in batches:
            for row in b.to_pylist():
                x = Lists(row, weights, n, total)
                for q, top in zip(items, best, strict=True):
                    maxscore(x, q, top)
        for i, top in enumerate(best):
            m = len(top.ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i, np.int32)), pa.array(top.ids, mask=top.ids == _LAST), pa.array(top.scores)], ["item", "key", "score"])

    return cut.select("terms", "sizes", "ids", "lengths", "docs", "tf").mapInArrow(lean(run), FOUND)


def search(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 20) -> DataFrame:
    """(query_key, rank, key, score): the ``k`` documents of highest score above 0 for each row of ``queries``; ties by key."""
    out, own, items, left = None, [], [], BLOCK_TERMS

    def flush() -> None:
        nonlocal out, own, items, left
        pairs, numbers = np.unique(np.concatenate([h for h, _ in items]), return_index=True)
        sizes = np.concatenate([s for _, s in items])[numbers]
        counted = [[(int(t), int(c)) for t, c in zip(*np.unique(np.searchsorted(pairs, h), return_counts=True), strict=True)] for h, _ in items]
        found = _block(docs, key, text, counted, pairs, sizes, k)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        top = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        ids = F.array(*(F.lit(v).cast(kind) for v in own))
        part = top.select(F.get(ids, F.col("item")).alias("query_key"), "rank", "key", "score")
        out, own, items, left = part if out is None else out.unionByName(part), [], [], BLOCK_TERMS

    kind = queries.schema[query_key].dataType
    for v, t in queries.select(query_key, query_text).toLocalIterator():
        _, h, s = terms(pa.array([t], pa.string()))
        if not len(h):
            continue
        own.append(v)
        items.append((h, s))
        left -= len(h)
        if left <= 0:
            flush()
    if items:
        flush()
    if out is None:
        return docs.sparkSession.createDataFrame([], "rank int, key long, score long").select(F.lit(None).cast(kind).alias("query_key"), "*")
    return out
