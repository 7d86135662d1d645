"""BPE training: distributed pair counts, merges chosen on the driver.

Equal sequences are counted once and kept as symbol arrays in blocks. A round applies a run of merges to the blocks and
gives back by how much pair counts changed, and, for the pairs that may come next, what stands to their left and right.

From these the driver knows what a merge does without looking at the blocks: (x, a) loses as many as (x, a, b) had, and no
new pair is more frequent than such a triple. So a run goes on, pair by pair in the order of a greedy trainer, as long as
the next pair's count is known exactly and is above all that new pairs can have; then the blocks are asked again. The
result is that of one merge after the other. The driver holds the pair counts (of the vocabulary squared at most).

A larger corpus is trained in phases. A phase makes the merges of pairs down to a count that few pairs reach. A pair rarer
than that when the phase begins is never part of such a merge, whatever is merged beside it: what grows out of its places are
at most as many pairs. So the words are cut there, and the pieces, short and much the same everywhere, are counted once each.
They give exactly the phase's merges, in one task or, if they are many, by the rounds above; the whole words are read twice a
phase. A token that is made a second time joins places that were counted apart: a phase ends there.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import discard, written
from .vocab import SPECIALS

#: Symbols of a block.
BLOCK = 1 << 19
#: A block, or a count: of a pair (kind 0), or of what stands left (1) or right (2) of a pair that was asked for.
BLOCKS = "ids binary, cnt binary, kind int, k long, n long"
#: Pairs that are asked for their neighbours, and pairs that a run is chosen from.
ASKED, CHOICE = 256, 4096
#: Pairs of which it is told how much a merge of an asked pair takes from them.
WANTED = 2048
#: Merges that each round does again before the blocks are written anew.
PENDING = 40
#: Letters from which a corpus is trained in phases, and symbols of a phase's pieces that one task takes.
PHASED, PIECES = 1 << 20, 1 << 22
#: Most of the pairs in the text, by their places, that a phase may merge: while symbols are few (up to 64), and later.
SHARES = 0.4, 0.2
#: Parts of it that are tried one after the other.
NARROWER = 1, 0.5, 0.2
#: Cells of a table of pairs that is held densely, and keys that are added up at a time.
DENSE, KEYS = 1 << 26, 1 << 22


def as_words(seqs: DataFrame, seq: str) -> DataFrame:
    """(parts, cnt): equal sequences counted once, letters apart."""
    d = seqs.filter(F.length(seq) > 0).groupBy(F.col(seq).alias("w")).agg(F.count("*").alias("cnt"))
    return d.select(F.trim(F.regexp_replace("w", "(.)", "$1 ")).alias("parts"), "cnt")


def pair_counts(words: DataFrame) -> DataFrame:
    """Neighbouring pairs (l, r) and how often they occur."""
    p = F.split("parts", " ")
    n = F.size(p)
    pairs = F.when(n > 1, F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: F.struct(a.alias("l"), b.alias("r"))))
    return words.select(F.explode(pairs).alias("p"), "cnt").groupBy("p.l", "p.r").agg(F.sum("cnt").alias("n"))


def _sum(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(k):
        return k, n
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
    keys, out = k[first], np.add.reduceat(n[order], first)
    return keys[out != 0], out[out != 0]


def _pairs(ids: np.ndarray, cnt: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the pairs that start ``at``; symbol 0 ends a word."""
    at = at[(at >= 0) & (at < len(ids) - 1)]
    at = at[(ids[at] != 0) & (ids[at + 1] != 0)]
    k = ids[at].astype(np.int64) * size + ids[at + 1]
    if (cnt == 1).all():
        return np.unique(k, return_counts=True)
    return _sum(k, cnt[np.searchsorted(np.flatnonzero(ids == 0), at)])


def levels(run: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The merges (left, right, made) of a run in groups: those of a group neither overlap nor use what another of it makes, so they are done at once."""
    out: list[list[tuple[int, int, int]]] = []
    for a, b, made in run:
        at = max((i + 1 for i, group in enumerate(out) if any(b == x or a == y or (a, b) == (x, y) or m in (a, b) or made in (x, y) for x, y, m in group)), default=0)
        if at == len(out):
            out.append([])
        out[at].append((a, b, made))
    return out


def _found(ids: np.ndarray, a: int, b: int) -> np.ndarray:
    """Places of a with b behind it; of a symbol with itself, every other place of a run."""
    hit, n = np.zeros(-(-len(ids) // 8) * 8, bool), len(ids) - 1
    if n < 1:
        return np.zeros(0, np.int64)
    np.equal(ids[:-1], a, out=hit[:n])
    hit[:n] &= ids[1:] == b
    some = np.flatnonzero(hit.view(np.uint64))  # eight places in one: most have none
    row, col = np.nonzero(hit.reshape(-1, 8)[some])
    at = some[row] * 8 + col
    if len(at) and a == b:
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
        at = at[(at - np.repeat(at[first], np.diff(np.append(first, len(at))))) % 2 == 0]
    return at


def _merge(ids: np.ndarray, group: list[tuple[int, int, int]], told: Callable[[np.ndarray, np.ndarray, int], None] | None = None) -> np.ndarray:
    """Does the merges of one of the :func:`levels`; ``told`` gets the places whose pairs change, before (-1) and after (1)."""
    found = [_found(ids, a, b) for a, b, _ in group]
    at = np.concatenate(found)
    if not len(at):
        return ids
    new = np.repeat(np.array([made for _, _, made in group], ids.dtype), [len(x) for x in found])
    if len(group) > 1:
        order = np.argsort(at)
        at, new = at[order], new[order]
    if told:
        told(ids, np.unique(np.concatenate([at - 1, at, at + 1])), -1)
    keep = np.ones(len(ids), bool)
    keep[at + 1] = False
    ids, at = ids[keep], at - np.arange(len(at))
    ids[at] = new
    if told:
        told(ids, np.unique(np.concatenate([at - 1, at])), 1)
    return ids


class _Beside:
    """What stands left and right of each pair of ``asked`` (sorted): ``sides`` (side, place in asked * size + symbol)."""

    def __init__(self, asked: np.ndarray, size: int) -> None:
        self.size, self.sides = size, np.zeros((2, len(asked) * size), np.int64)
        a, b = np.unique(asked // size), np.unique(asked % size)
        self.left, self.right = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.left[a], self.right[b] = np.arange(1, len(a) + 1) * (len(b) + 1), np.arange(1, len(b) + 1)
        self.place = np.full((len(a) + 1) * (len(b) + 1), -1, np.int32)
        self.place[self.left[asked // size] + self.right[asked % size]] = np.arange(len(asked))

    def add(self, ids: np.ndarray, cnt: np.ndarray) -> None:
        if not self.sides.size or len(ids) < 2:
            return
        j = self.place[self.left[ids[:-1]] + self.right[ids[1:]]]
        at = np.flatnonzero(j >= 0)
        j = j[at].astype(np.int64) * self.size
        w = None if (cnt == 1).all() else cnt[np.searchsorted(np.flatnonzero(ids == 0), at)]
        for side, beside in enumerate((at - 1, at + 2)):
            ok = slice(int(len(at) and at[0] == 0), None) if side == 0 else slice(0, len(at) - int(len(at) and beside[-1] == len(ids)))
            n = np.bincount(j[ok] + ids[beside[ok]], None if w is None else w[ok], self.sides.shape[1])
            self.sides[side] += n if w is None else np.rint(n).astype(np.int64)


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _rows(blocks: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    m = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b, _ in blocks], pa.binary()), pa.array([c.tobytes() for _, c in blocks], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], _NAMES)


class _Counts:
    """Counts by kind that a task adds up."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: [], 2: []}

    def add(self, kind: int, k: np.ndarray, n: np.ndarray) -> None:
        p = self.parts[kind]
        p.append((k, n))
        if len(p) > 64:
            self.parts[kind] = [_sum(*map(np.concatenate, zip(*p, strict=True)))]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for kind, p in self.parts.items():
            if p:
                k, n = _sum(*map(np.concatenate, zip(*p, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.binary()), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n)], _NAMES)


class _Pairs:
    """Counts of all pairs of symbols below ``known`` that a task adds up."""

    def __init__(self, known: int, size: int) -> None:
        self.known, self.size, self.held, self.many = known, size, [], 0
        self.n, self.got = np.zeros(known * known if known * known <= DENSE else 0, np.int64), _Counts()

    def add(self, ids: np.ndarray, cnt: np.ndarray) -> None:
        if not len(self.n):
            self.got.add(0, *_pairs(ids, cnt, np.arange(len(ids) - 1), self.size))
        elif (cnt == 1).all():
            self.held.append(_keys(ids, self.known))
            self.many += len(ids)
            if self.many > KEYS:
                self._flush()
        else:
            own = np.repeat(cnt, np.diff(np.flatnonzero(ids == 0), prepend=-1))
            self.n += np.rint(np.bincount(_keys(ids, self.known), own[:-1], len(self.n))).astype(np.int64)

    def _flush(self) -> None:
        if self.held:
            self.n += np.bincount(np.concatenate(self.held), minlength=len(self.n))
        self.held, self.many = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        if len(self.n):
            self._flush()
            n = self.n.reshape(self.known, self.known)
            n[0], n[:, 0] = 0, 0  # ends of words
            a, b = np.nonzero(n)
            self.got.add(0, a * self.size + b, n[a, b])
        yield from self.got.batches()


def _keys(ids: np.ndarray, known: int) -> np.ndarray:
    k = ids[:-1].astype(np.int32 if known * known < 1 << 31 else np.int64)
    k *= known
    k += ids[1:]
    return k


class Cut:
    """Cuts blocks everywhere but inside the pairs ``kept`` (left * size + right, sorted), into pieces that are told apart."""

    def __init__(self, kept: np.ndarray, known: int, size: int) -> None:
        a, b = kept // size, kept % size
        self.known, self.size, self.kept, self.table = known, size, a * known + b, None
        if known * known <= DENSE:
            self.table = np.zeros(known * known, bool)
            self.table[self.kept] = True

    def pieces(self, ids: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The pieces of two and more symbols in order, the places of their symbols, and where among these each begins."""
        inside = np.zeros(len(ids) + 1, bool)  # whether a place is in one piece with the place before
        if len(ids) > 1:
            k = _keys(ids, self.known)
            inside[1:-1] = self.table[k] if self.table is not None else np.isin(k, self.kept)
        at = np.flatnonzero(inside[:-1] | inside[1:])
        first = np.flatnonzero(~inside[at])
        ends = (np.append(first, len(at)) * ids.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(ids[at])]).dictionary_encode(), at, first

    def merge(self, ids: np.ndarray, run: list[tuple[int, int, int]]) -> np.ndarray:
        """The symbols after merges that lie within pieces and whose tokens are all new, done once for each different piece."""
        d, at, first = self.pieces(ids)
        if not len(at) or not run:
            return ids
        flat, many = _ranked(*_flat(d.dictionary, ids.dtype), run, self.size)
        code, ends, size = d.indices.to_numpy(), np.cumsum(many), np.diff(np.append(first, len(at)))
        come = np.arange(len(at)) + np.repeat((ends - many)[code] - first, size)
        stays = come < np.repeat(ends[code], size)
        out, keep = ids.copy(), np.ones(len(ids), bool)
        out[at[stays]], keep[at[~stays]] = flat[come[stays]], False
        return out[keep]


def _flat(words: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of binary words one after the other, and each word's length."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), size


def cut(blocks: DataFrame, kept: np.ndarray, known: int, size: int) -> DataFrame:
    """The pieces (w, n) of two and more symbols that :class:`Cut` leaves, and how often they occur."""
    kind = np.uint16 if size < 1 << 16 else np.uint32

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, parts, held = Cut(kept, known, size), [], 0

        def once() -> tuple[pa.Array, np.ndarray]:
            d = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
            return d.dictionary, np.rint(np.bincount(d.indices.to_numpy(), np.concatenate([n for _, n in parts]), len(d.dictionary))).astype(np.int64)

        for b in batches:
            for i, c in zip(b.column("ids"), b.column("cnt"), strict=True):
                ids, cnt = np.frombuffer(i.as_buffer(), kind), np.frombuffer(c.as_buffer(), np.int64)
                d, at, first = by.pieces(ids)
                own = None if (cnt == 1).all() else cnt[np.searchsorted(np.flatnonzero(ids == 0), at[first])]
                n = np.rint(np.bincount(d.indices.to_numpy(), own, len(d.dictionary))).astype(np.int64)
                parts.append((d.dictionary, n))
                held += len(n)
            if held > PIECES // 4:
                parts = [once()]
                if len(parts[0][0]) > PIECES // 8:
                    yield pa.RecordBatch.from_arrays([parts[0][0], pa.array(parts[0][1])], ["w", "n"])
                    parts = []
                held = sum(len(w) for w, _ in parts)
        if parts:
            w, n = once()
            for at in range(0, len(w), 1 << 16):
                yield pa.RecordBatch.from_arrays([w[at : at + (1 << 16)], pa.array(n[at : at + (1 << 16)])], ["w", "n"])

    return blocks.filter("ids IS NOT NULL").select("ids", "cnt").mapInArrow(go, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def pack(words: DataFrame, size: int) -> DataFrame:
    """Blocks of the words (w, n), and the counts of their pairs."""
    kind = np.uint16 if size < 1 << 16 else np.uint32

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Counts()
        for b in batches:
            if not len(b):
                continue
            ids, many = _flat(b.column("w"), kind)
            ids, cnt = np.insert(ids, np.cumsum(many), 0), b.column("n").to_numpy().astype(np.int64)
            got.add(0, *_pairs(ids, cnt, np.arange(len(ids) - 1), size))
            yield _rows([(ids, cnt)])
        yield from got.batches()

    return words.mapInArrow(go, BLOCKS)


def small(words: DataFrame, vocab: list[str], vocab_size: int, least: int, size: int) -> DataFrame:
    """The merges (i, l, r) that the words (w, n) give in one task, down to a count of ``least`` or to a token that is made again; a row of -1 if there are too many words."""
    kind = np.uint16 if size < 1 << 16 else np.uint32

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total, out = [], 0, []
        for b in batches:
            if len(b) and total <= PIECES:
                ids, many = _flat(b.column("w"), kind)
                parts.append((np.insert(ids, np.cumsum(many), 0), b.column("n").to_numpy().astype(np.int64)))
                total += len(ids)
        if total > PIECES:
            out = [(-1, -1)]
        elif parts:
            ids, cnt = (np.concatenate(x) for x in zip(*parts, strict=True))
            tokens, known = list(vocab), set(vocab)
            now = dict(zip(*(x.tolist() for x in _pairs(ids, cnt, np.arange(len(ids) - 1), size)), strict=True))
            queue = [(-c, k) for k, c in now.items() if c >= least]
            heapq.heapify(queue)

            def told(ids: np.ndarray, at: np.ndarray, sign: int) -> None:
                for k, n in zip(*(x.tolist() for x in _pairs(ids, cnt, at, size)), strict=True):
                    now[k] = now.get(k, 0) + sign * n
                    if sign > 0 and now[k] >= least:
                        heapq.heappush(queue, (-now[k], k))

            while len(tokens) < vocab_size and queue:
                c, k = heapq.heappop(queue)
                if now[k] != -c:
                    if least <= now[k] < -c:
                        heapq.heappush(queue, (-now[k], k))
                    continue
                a, b = divmod(k, size)
                token = tokens[a - 1] + tokens[b - 1]
                out.append((a, b))
                if token in known:
                    break
                tokens.append(token)
                known.add(token)
                ids = _merge(ids, [(a, b, len(tokens))], told)
        a, b = ([x[i] for x in out] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["i", "l", "r"])

    return words.repartition(1).mapInArrow(go, "i int, l long, r long")


def _ranked(ids: np.ndarray, many: np.ndarray, run: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (symbols one after the other, lengths) after the merges of a run whose tokens are all new: each word's earliest merge first, all words at once."""
    if not run or not len(ids):
        return ids, many
    keys = np.array([a * size + b for a, b, _ in run], np.int64)
    order = np.argsort(keys)
    keys, made = keys[order], np.array([m for _, _, m in run], ids.dtype)
    word, done, none = np.repeat(np.arange(len(many)), many), [], len(run)
    while len(ids):
        k = ids[:-1].astype(np.int64) * size + ids[1:]
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        rank = np.append(np.where((keys[i] == k) & (word[:-1] == word[1:]), order[i], none), none)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
        over = least == none
        done.append((ids[over], word[over]))
        ids, word, rank, least = ids[~over], word[~over], rank[~over], least[~over]
        at = np.flatnonzero(rank == least)
        if not len(at):
            break
        head = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))  # of a symbol with itself, every other place of a run
        at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
        ids, keep = ids.copy(), np.ones(len(ids), bool)
        ids[at], keep[at + 1] = made[rank[at]], False
        ids, word = ids[keep], word[keep]
    ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(many))


def phase(blocks: DataFrame, kept: np.ndarray, run: list[tuple[int, int, int]], again: bool, known: int, size: int) -> DataFrame:
    """Blocks after a phase's merges, done once for each piece of a block, and the counts of their pairs. ``again``: the last one's token is not new."""
    kind = np.uint16 if size < 1 << 16 else np.uint32

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, got = Cut(kept, known, size), _Pairs(max(known, *(made + 1 for _, _, made in run)), size)
        for b in batches:
            for i, c in zip(b.column("ids"), b.column("cnt"), strict=True):
                ids, cnt = np.frombuffer(i.as_buffer(), kind), np.frombuffer(c.as_buffer(), np.int64)
                ids = by.merge(ids, run[:-1] if again else run)
                if again:
                    ids = _merge(ids, run[-1:])
                got.add(ids, cnt)
                yield _rows([(ids, cnt)])
        yield from got.batches()

    return blocks.filter("ids IS NOT NULL").select("ids", "cnt").mapInArrow(go, BLOCKS)


def encode(words: DataFrame, letters: list[str], first: int, size: int) -> DataFrame:
    """Blocks of the words (w, cnt), letters as symbols from ``first`` on, and the counts of their pairs."""
    points = np.array([ord(c) for c in letters], np.uint32)
    kind = np.uint16 if size < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Pairs(first + len(letters), size)
        number = np.zeros(int(points.max()) + 1, kind)
        number[points] = np.arange(len(points)) + first
        for b in batches:
            w, cnt, at = b.column("w").to_pylist(), b.column("cnt").to_numpy(), 0
            while at < len(w):
                to, total = at, 0
                while to < len(w) and (total < BLOCK or to == at):
                    total += len(w[to]) + 1
                    to += 1
                codes = np.frombuffer("".join(w[at:to]).encode("utf-32-le", "surrogatepass"), np.uint32)
                ends = np.cumsum([len(x) for x in w[at:to]])
                ids = np.insert(number[codes], ends, 0)
                c = cnt[at:to].astype(np.int64)
                got.add(ids, c)
                yield _rows([(ids, c)])
                at = to
        yield from got.batches()

    return words.mapInArrow(run, BLOCKS)


def apply(blocks: DataFrame, run: list[tuple[int, int, int]], size: int) -> DataFrame:
    """Blocks after the merges (left, right, made) of a run."""
    kind, groups = np.uint16 if size < 1 << 16 else np.uint32, levels(run)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, c in zip(b.column("ids").to_pylist(), b.column("cnt").to_pylist(), strict=True):
                ids = np.frombuffer(i, kind)
                for group in groups:
                    ids = _merge(ids, group)
                yield _rows([(ids, np.frombuffer(c, np.int64))])

    return blocks.filter("ids IS NOT NULL").mapInArrow(go, BLOCKS)


def changes(blocks: DataFrame, done: list[tuple[int, int, int]], run: list[tuple[int, int, int]], asked: np.ndarray, wanted: list[np.ndarray], size: int) -> DataFrame:
    """After the merges that are ``done``: by how much those of ``run`` change pair counts, and then the ``wanted`` neighbours of ``asked``; as (kind, k, n)."""
    kind, before, now = np.uint16 if size < 1 << 16 else np.uint32, levels(done), levels(run)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, beside = _Counts(), _Beside(asked, size)
        for b in batches:
            for i, c in zip(b.column("ids").to_pylist(), b.column("cnt").to_pylist(), strict=True):
                ids, cnt = np.frombuffer(i, kind), np.frombuffer(c, np.int64)

                def told(ids: np.ndarray, at: np.ndarray, sign: int, cnt: np.ndarray = cnt) -> None:
                    k, n = _pairs(ids, cnt, at, size)
                    got.add(0, k, sign * n)

                for group in before:
                    ids = _merge(ids, group)
                for group in now:
                    ids = _merge(ids, group, told)
                beside.add(ids, cnt)
        for side in (0, 1):
            k = wanted[side]
            got.add(side + 1, k, beside.sides[side, k])
        yield from got.batches()

    return summed(blocks.filter("ids IS NOT NULL").mapInArrow(go, BLOCKS))


def summed(counts: DataFrame) -> DataFrame:
    return counts.filter("k IS NOT NULL").groupBy("kind", "k").agg(F.sum("n").alias("n"))


class Chooser:
    """The next merges, from exact pair counts at the start of a round and what stands beside the pairs that were asked for.

    ``now`` holds each pair's count, or a bound above it for pairs in ``unsure``; ``bound`` is above the counts of all pairs
    that the run makes or adds to. Neighbours are known only where they make a pair of more than ``floor`` with the nearer
    symbol; others make no pair above it, and the run ends there. A pair is known as long as it loses on one side only: what it loses to two merges on the
    same side are different places, but a place may be lost to a merge on its left and again to one on its right.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, beside: dict[int, tuple[list, list]], size: int, least: int, floor: int = 0) -> None:
        at, self.rest = np.flatnonzero(n >= least), least - 1  # at most so often do the pairs occur that are left out
        if len(at) > CHOICE:
            self.rest = int(np.partition(n[at], -CHOICE)[-CHOICE])
            at = at[n[at] >= self.rest]
        self.now = dict(zip(keys[at].tolist(), n[at].tolist(), strict=True))
        self.all = (keys, n)
        self.beside, self.size, self.least = beside, size, least
        self.queue = [(-c, k) for k, c in self.now.items()]
        heapq.heapify(self.queue)
        self.side: dict[int, int] = {}
        self.unsure: set[int] = set()
        self.bound, self.made = floor, {}  # bounds of pairs that were made or added to
        self.unforeseen: list[int] = []

    def next(self, first: bool) -> tuple[int, int] | None:
        """The most frequent pair (ties: the smaller left, then right symbol), or None where only the blocks can tell."""
        while self.queue:
            c, k = -self.queue[0][0], self.queue[0][1]
            if c == self.now[k]:
                break
            heapq.heappop(self.queue)
            if self.now[k] >= self.least:
                heapq.heappush(self.queue, (-self.now[k], k))
        if not self.queue or not first and (c <= self.bound or k in self.unsure or k not in self.beside):
            return None
        return divmod(k, self.size)

    def merge(self, a: int, b: int, made: int, new: bool) -> None:
        """What the merge does to the counts."""
        k, z = a * self.size + b, self.size
        heapq.heappop(self.queue)
        self.now[k] = 0
        if k not in self.beside:  # the first of a run, which was not foreseen: nothing is known behind it
            self.bound = 1 << 62
            self.unforeseen.append(made)
            return
        for side, rows in enumerate(self.beside[k]):
            for x, m in rows:
                pair = x * z + a if side == 0 else b * z + x
                made_pair = x * z + made if side == 0 else made * z + x
                self.made[made_pair] = self.made.get(made_pair, 0) + m
                self.bound = max(self.bound, self.made[made_pair] if new else self.made[made_pair] + self._before(made_pair))
                if not new and made_pair in self.now:
                    self.unsure.add(made_pair)
                if pair == k or pair not in self.now or not self.now[pair]:
                    continue
                if k in self.side or self.side.get(pair, side) != side or a == b and side == 1:
                    self.unsure.add(pair)
                else:
                    self.now[pair] -= m
                    self.side[pair] = side

    def _before(self, k: int) -> int:
        if k in self.now:
            return self.now[k]
        keys, n = self.all
        i = int(np.searchsorted(keys, k))
        return int(n[i]) if i < len(keys) and keys[i] == k else 0

    def likely(self) -> tuple[np.ndarray, list[np.ndarray], int]:
        """The pairs that may come next, by what is known of their counts; for each side the neighbours of them that are wanted, as (place * size + symbol); and the floor of these."""
        most = dict(self.now)
        for k, c in self.made.items():
            most[k] = most.get(k, 0 if k in self.now else self._before(k)) + c
        top = heapq.nlargest(ASKED, [(c, k) for k, c in self.now.items() if c] + [(c, k) for k, c in self.made.items() if k not in self.now])
        asked = np.array(sorted({k for _, k in top}), np.int64)
        keys, c = np.array(list(most), np.int64), np.array(list(most.values()), np.int64)
        floor = max(self.rest, int(np.partition(c, -WANTED)[-WANTED]) if len(c) > WANTED else 0)
        every = np.arange(1, self.size)
        keys = np.unique(np.concatenate([keys[c > floor], *(x for made in self.unforeseen for x in (every * self.size + made, made * self.size + every))]))
        a, b = keys // self.size, keys % self.size
        # (x, left) and (right, x) for each pair
        return asked, [np.concatenate([np.zeros(0, np.int64), *(np.sort(near[own == s]) + i * self.size for i, s in enumerate(ends.tolist()))]) for near, own, ends in ((a, b, asked // self.size), (b, a, asked % self.size))], floor


class _Made:
    """The vocabulary so far and its merges, as tokens and as symbols (left, right, made)."""

    def __init__(self, vocab: list[str], vocab_size: int) -> None:
        self.vocab, self.vocab_size, self.ids = vocab, vocab_size, {t: i for i, t in enumerate(vocab)}
        self.merges: list[tuple[str, str]] = []
        self.symbols: list[tuple[int, int, int]] = []
        self.again = False  # the last merge's token was there before

    def add(self, a: int, b: int) -> int:
        left, right = self.vocab[a - 1], self.vocab[b - 1]
        self.merges.append((left, right))
        self.again = left + right in self.ids
        if not self.again:
            self.ids[left + right] = len(self.vocab)
            self.vocab.append(left + right)
        self.symbols.append((a, b, self.ids[left + right] + 1))
        return self.symbols[-1][2]


def _rounds(blocks: DataFrame, made: _Made, least: int, size: int, phased: bool = False) -> DataFrame:
    """Merges down to a count of ``least``, or in a phase to a token that is made again; gives the last blocks."""
    done: list[tuple[int, int, int]] = []
    keys, n, asked, floor, news = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, summed(blocks)
    while len(made.vocab) < made.vocab_size:
        d = news.toArrow()  # the vocabulary squared at most
        kind, k, c = (d[x].to_numpy() for x in ("kind", "k", "n"))
        keys, n = _sum(np.concatenate([keys, k[kind == 0]]), np.concatenate([n, c[kind == 0]]))
        beside = {int(x): ([], []) for x in asked}
        for side in (1, 2):
            for x, m in zip(k[kind == side].tolist(), c[kind == side].tolist(), strict=True):
                beside[int(asked[x // size])][side - 1].append((x % size, m))
        run, pairs, over = [], Chooser(keys, n, beside, size, least, floor), False
        while not over and len(made.vocab) < made.vocab_size and (found := pairs.next(not run)):
            a, b = found
            token = made.add(a, b)
            over = phased and made.again
            run.append((a, b, token))
            pairs.merge(a, b, token, not made.again)
        if not run or over or len(made.vocab) >= made.vocab_size:
            break
        asked, wanted, floor = pairs.likely()
        if len(done) > PENDING:
            before, blocks, done = blocks, written(apply(blocks, done, size), "bpe"), []
            discard(before)
        news = changes(blocks, done, run, asked, wanted, size)
        done = done + run
    return blocks


def train(seqs: DataFrame, seq: str, vocab_size: int, min_frequency: int = 100, alphabet: str = "ACGTN") -> tuple[list[str], list[tuple[str, str]]]:
    """Vocabulary in order (specials, sorted letters, merges) and the merges.

    Stops at the size or when the best pair is rarer than ``min_frequency``; ties go to the smaller left id, then right id.
    """
    words = seqs.filter(F.length(seq) > 0).groupBy(F.col(seq).alias("w")).agg(F.count("*").alias("cnt"))

    def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for b in batches:
            data = np.frombuffer(b.column(0).cast(pa.large_binary()).buffers()[2] or b"", np.uint8)
            if not len(data) or data.max() < 0x80:
                met |= set(map(chr, np.flatnonzero(np.bincount(data)).tolist()))
                continue
            for w in b.column(0).to_pylist():
                met |= set(w or "")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["c"])

    words = written(words, "words")
    seen = [r[0] for r in words.select("w").mapInArrow(chars, "c string").distinct().collect()]  # letters
    letters = sorted(set(alphabet) | set(seen))
    size = max(vocab_size, len(SPECIALS) + len(letters)) + 1  # symbols are ids + 1
    made = _Made([*SPECIALS, *letters], vocab_size)
    blocks = written(encode(words, letters, len(SPECIALS) + 1, size), "bpe")
    discard(words)
    total = blocks.filter("ids IS NOT NULL").agg(F.sum(F.length("ids"))).first()[0] or 0
    if total // (2 if size < 1 << 16 else 4) < PHASED:
        discard(_rounds(blocks, made, min_frequency, size))
        return made.vocab, made.merges
    narrow = 0
    while len(made.vocab) < vocab_size:
        d = summed(blocks).toArrow()  # the vocabulary squared at most
        keys, n = _sum(d["k"].to_numpy(), d["n"].to_numpy())
        if not len(n) or n.max() < min_frequency:
            break
        known, before, most = len(made.vocab) + 1, len(made.merges), np.sort(n)[::-1]
        wide = None
        for part in NARROWER[narrow:]:  # fewer pairs, where the pieces are too many for one task
            share = np.searchsorted(np.cumsum(most), SHARES[known > 64] * part * n.sum(), "right")
            least = max(min_frequency, int(most[max(0, share - 1)]))
            kept = keys[n >= least]
            wide = wide or (least, kept)
            found = sorted(small(cut(blocks, kept, known, size), made.vocab, vocab_size, least, size).collect())  # the merges
            if found[0].l >= 0:
                narrow = NARROWER.index(part)
                break
        if found[0].l >= 0:
            for _, a, b in found:
                made.add(a, b)
        else:  # too many however few pairs
            least, kept = wide
            discard(_rounds(written(pack(cut(blocks, kept, known, size), size), "bpe"), made, least, size, True))
        if len(made.vocab) >= vocab_size:
            break
        old, blocks = blocks, written(phase(blocks, kept, made.symbols[before:], made.again, known, size), "bpe")
        discard(old)
    discard(blocks)
    return made.vocab, made.merges
