"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to three machines: the normaliser (the model's character map, blanks to the meta symbol, dummy
prefix, extra blanks), the pieces, and byte fallback for characters that no piece has. They are composed with each input,
and the shortest path in the tropical semiring (least sum of weights) is the encoding; :meth:`Machine.path` finds it for
every kind of model, best first, and composes only what it visits.

*Unigram* models weigh a piece by minus its score. For *merge* models (BPE) that path would not be the encoding, since
merging is greedy. Their pieces weigh nothing, and the composition gets a third machine over neighbouring pieces: an arc from piece a to
piece b weighs nothing if merging the characters of ab gives back exactly (a, b), and is infinite otherwise. Merging
is local in that sense: a sequence is an encoding exactly when each neighbouring pair is one, so one path of finite
weight is left and it equals the library's encoding (tests compare them). What the meta symbol starts never joins what comes before it,
so inputs are composed run by run and runs are remembered. User-defined pieces are found first, the longest at each
place, and nothing joins across them.

Tokenizers are read, never trained. Executors get the model's bytes, not its path. Rows are independent; no exchange.
Defined results: null and empty texts have no tokens and decode to ''; a meta symbol in a text reads as a blank;
invalid byte sequences decode to U+FFFD; ``round_trip`` says whether decoding gives the very text (null: '').
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Lookup
from .runtime import lean

META = "▁"
#: Bounds of a task's memory of runs and of neighbouring pieces, some 40 MB together (what is beyond is worked out again); bytes of texts that are encoded together, and characters of runs that are searched together.
RUNS, PAIRS, TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 100_000, 50_000, 750_000, 150_000
SCHEMA = "key long, ids array<int>, n_tokens int, round_trip boolean"

UNIGRAM, BPE = 1, 2
INFINITE = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        v = shift = 0
        while True:
            x = b[at]
            at += 1
            v |= (x & 127) << shift
            shift += 7
            if x < 128:
                return v, at

    while at < len(b):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            v, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            v, at = b[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            v, at = b[at : at + n], at + n
        yield tag >> 3, v


class Recent:
    """A map of bounded size: what was used since the last turn, and what was used in the turn before."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most // 2, {}, {}

    def get(self, k):
        v = self.new.get(k)
        if v is None:
            v = self.old.get(k)
            if v is not None:
                self.put(k, v)
        return v

    def put(self, k, v) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[k] = v


class CharacterMap:
    """A model's compiled map: a double-array trie over bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.replaced = blob[4 + size :]
        self.known: dict[str, str] = {}

    def longest(self, b: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest entry that starts at a byte."""
        units, found = self.units, None
        node = self._step(units[0])
        for i in range(at, len(b)):
            node ^= b[i]
            if node >= len(units) or units[node] & 0x800000FF != b[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._step(units[node])
            if leaf:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replaced[start : self.replaced.index(b"\0", start)]
        return found

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def apply(self, text: str) -> str:
        b, at, out = text.encode("utf-8", "replace"), 0, []
        while at < len(b):
            found = self.longest(b, at)
            if found is None:
                n = 1 if b[at] < 128 else 2 if b[at] < 224 else 3 if b[at] < 240 else 4
                found = n, b[at : at + n]
            at += found[0]
            out.append(found[1])
        return b"".join(out).decode("utf-8", "replace")


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings that go on by one character."""
    h = (h + c + np.uint64(1)) * _BASE
    return h ^ (h >> np.uint64(29))


def table(of: dict[str, int]) -> Lookup:
    """Strings, by their hashes, to numbers."""
    size = np.fromiter(map(len, of), np.int64, len(of))
    c = np.frombuffer("".join(of).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start, h = np.cumsum(size) - size, np.zeros(len(of), np.uint64)
    for j in range(int(size.max(initial=0))):
        on = size > j
        h[on] = _hashed(h[on], c[start[on] + j])
    return Lookup(h, np.fromiter(of.values(), np.int32, len(of)))


class Machine:
    """The compiled transducer of a model."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.dummy, self.squeeze, self.map = True, True, None
        for n, v in _fields(model):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif n == 2:
                f = dict(_fields(v))
                self.kind, self.byte_fallback, self.unk = f.get(3, UNIGRAM), bool(f.get(35, 0)), f.get(40, 0)
                if f.get(24):
                    raise ValueError("blanks as suffixes are not supported")
            elif n == 3:
                f = dict(_fields(v))
                self.map = CharacterMap(f[2]) if f.get(2) else None
                self.dummy, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:i]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        self.bytes_of = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        # weights; the same amount for each character on every path keeps them from being negative
        normal = [self.scores[i] for i in self.ids.values()]
        self.level = 0.0 if self.kind == BPE else max(0.0, max((self.scores[i] / len(p) for p, i in self.ids.items()), default=0.0))
        self.weights = {i: 0.0 if self.kind == BPE else self.level * len(p) - self.scores[i] for p, i in self.ids.items()}
        self.fallback_weight = self.level + 10.0 - min(normal, default=0.0)
        raw = {i: b for b, i in self.bytes_of.items()}
        self.text_of = [bytes([raw[i]]) if i in raw else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(META, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True))]
        self.text_size = np.array([len(t) for t in self.text_of])
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_bytes = np.frombuffer(b"".join(self.text_of), np.uint8)
        self.own = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == USER}
        own = "|".join(map(re.escape, sorted(self.own, key=len, reverse=True)))
        self.user = re.compile(f"({own})") if own else None
        if any(META in p.lstrip(META) for p in self.ids):  # then nothing can be cut
            self.run = re.compile(r"[\s\S]+")
        elif any("\n" in p and len(p) > 1 for p in self.ids):
            self.run = re.compile(f"{META}*[^{META}]+|{META}+")
        else:  # a line feed joins nothing either
            self.run = re.compile(f"\n|{META}*[^{META}\n]+|{META}+")
        self.runs, self.pairs = Recent(RUNS), Recent(PAIRS)
        self.table = table(self.prefixes) if self.kind == BPE else None
        self.met, self.weight_of = np.zeros(0, np.int64), np.zeros(0)  # neighbours that have been weighed, in order
        self._steps: dict[int, tuple] = {}

    # --- normaliser
    def normalise(self, text: str) -> str:
        if self.map is not None:
            text = "".join(x if i % 2 else self.map.apply(x) for i, x in enumerate(self.user.split(text) if self.user else [text]))
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.dummy else "") + text).replace(" ", META)

    # --- neighbouring pieces
    def steps(self, p: int) -> tuple[bool, str, list[tuple[float, str]], str, list[tuple[float, str]]]:
        """How merging makes piece p: whether it does, then first right-hand part and each step's (score, right-hand part after it), the same for the left hand."""
        got = self._steps.get(p)
        if got is None:
            parts = list(self.pieces[p])
            last, first, right, left = parts[-1], parts[0], [], []
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    n = self.ids.get(parts[i] + parts[i + 1])
                    if n is not None and (best is None or self.scores[n] > best):
                        best, at = self.scores[n], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                right.append((best, parts[-1]))
                left.append((best, parts[0]))
            got = self._steps[p] = (len(parts) == 1, last, right, first, left)
        return got

    def joins(self, a: int, b: int) -> float:
        """Weight of piece b after piece a (-1: none): 0 or infinite.

        The steps that make a and b are played in order of score; it is infinite if the parts at their border would
        merge at any time before the next step (equal scores: the leftmost first).
        """
        key = a * 1_048_576 + b
        w = self.pairs.get(key)
        if w is not None:
            return w
        whole, _, _, l, sb = self.steps(b)
        ok = whole
        if ok and a >= 0:
            _, r, sa, _, _ = self.steps(a)
            i = j = 0
            get, scores = self.ids.get, self.scores
            while True:
                n = get(r + l)
                na = sa[i][0] if i < len(sa) else None
                nb = sb[j][0] if j < len(sb) else None
                if n is not None and (na is None or scores[n] > na) and (nb is None or scores[n] >= nb):
                    ok = False
                    break
                if na is None and nb is None:
                    break
                if nb is None or na is not None and na >= nb:
                    r = sa[i][1]
                    i += 1
                else:
                    l = sb[j][1]
                    j += 1
        w = 0.0 if ok else INFINITE
        self.pairs.put(key, w)
        return w

    # --- composition with a run, shortest path
    def path(self, s: str) -> list[int]:
        """Arcs of the least weight through a run, best first.

        A state is a position and the piece before it. A position is settled once: the pieces of a unigram model join
        with no weight, so the least weight is all that matters, and in a merge model one piece ends there with a finite
        weight, since a prefix has one encoding. Weights are summed as arcs are taken, and the weight of two neighbours
        is worked out when their arc's turn comes; an infinite sum is no path. Characters without a piece are fallback
        arcs, which join anything. Arcs wait in a heap, by weight, then the furthest, then the longest piece; in a merge
        model all finite weights are equal, and a stack, the furthest on top, is such a heap.
        """
        n, get, weights, longest, merge = len(s), self.prefixes.get, self.weights, self.longest, self.kind == BPE
        known, joins = self.pairs.new.get, self.joins
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        at, prev, weight, e, p = 0, -1, 0.0, 0, 0
        open_: list[tuple] = []
        while at < n:
            arcs, p = [], get(s[at])
            if p is None or p < 0:
                arcs.append((at + 1, -1))
            for e in range(at + 2, min(n, at + longest) + 2):
                if p is None:
                    break
                if p >= 0:
                    arcs.append((e - 1, p))
                p = get(s[at:e])
            if merge:
                while True:
                    if arcs:
                        e, p = arcs.pop()
                        if back[e] is None:
                            if p < 0:
                                total = weight
                                break
                            w = known(prev * 1_048_576 + p)
                            total = weight + weights[p] + (joins(prev, p) if w is None else w)
                            if total < INFINITE:
                                break
                    elif open_:
                        arcs, at, prev, weight = open_.pop()
                    else:
                        raise ValueError("no path through a run")
                if arcs:
                    open_.append((arcs, at, prev, weight))
            else:
                for e, p in arcs:
                    heapq.heappush(open_, (weight + (weights[p] if p >= 0 else self.fallback_weight), -e, at, p))
                total, e, at, p = heapq.heappop(open_)
                while back[-e] is not None:
                    total, e, at, p = heapq.heappop(open_)
                e = -e
            back[e] = (at, p)
            at, prev, weight = e, p, total
        out: list[int] = []
        while at:
            at, p = back[at]
            if p >= 0:
                out.append(p)
            else:
                out += self.fallback(s[at])[::-1]
        return out[::-1]

    def paths(self, runs: list[str]) -> list[bytes]:
        """:meth:`path` of many runs, as bytes of 32-bit ids.

        For a merge model all runs are searched side by side, in the same order of arcs; a run that needs a fallback arc
        is left to :meth:`path`.
        """
        if self.table is None:
            return [np.array(self.path(r), np.int32).tobytes() for r in runs]
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        cuts = np.flatnonzero(np.diff(ends // CHARACTERS_AT_ONCE, prepend=0))
        return [x for lo, hi in pairwise([0, *cuts[cuts > 0].tolist(), len(runs)]) for x in self._side_by_side(runs[lo:hi])]

    def _side_by_side(self, runs: list[str]) -> list[bytes]:
        if not runs:
            return []
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(size)
        c = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        run = np.repeat(np.arange(len(runs)), size)
        # arcs: at each place the pieces that start there, the longest first
        at, h, found = np.arange(len(c)), np.zeros(len(c), np.uint64), []
        left = ends[run] - at
        for k in range(1, self.longest + 1):
            on = left[at] >= k
            at, h = at[on], h[on]
            if not len(at):
                break
            h = _hashed(h, c[at + k - 1])
            v = self.table.get(h)
            hit = v >= 0
            found.append((at[hit].astype(np.int32), v[hit]))
            at, h = at[v > -2], h[v > -2]
        many, single = np.zeros(len(c), np.int64), np.zeros(len(c), bool)
        for place, _ in found:
            many[place] += 1
        single[found[0][0]] = True
        last = np.cumsum(many)
        length, piece, free = np.empty(last[-1], np.int16), np.empty(last[-1], np.int32), last - many
        for k in range(len(found), 0, -1):
            place, v = found.pop()
            length[free[place]], piece[free[place]] = k, v
            free[place] += 1
        fits = np.zeros(len(runs), bool)
        fits[size < 256] = True
        fits[run[~single]] = False  # a fallback arc
        # a run has a place more than characters; it waits at a place, with the piece before it and the arcs tried there
        own, stop = np.arange(len(c)) + run, ends + np.arange(len(runs))
        arc, no_arc = np.zeros(len(c) + len(runs), np.int64), np.zeros(len(c) + len(runs), np.int64)
        arc[own], no_arc[own] = np.concatenate([[0], last[:-1]]), last
        before, came, settled = (np.full(len(arc), -1) for _ in range(3))
        token = np.full(len(arc), -1, np.int32)
        r = np.flatnonzero(fits)
        at = first = (stop - size)[r]
        while len(r):
            k = arc[at]
            some = k < no_arc[at]
            arc[at] += some
            k = np.minimum(k, len(piece) - 1)
            p, to = piece[k], at + length[k]
            free = np.flatnonzero(some & (settled[np.where(some, to, at)] < 0))
            free = free[self._weights(before[at[free]], p[free]) < INFINITE]
            token[at[free]] = p[free]
            came[to[free]], before[to[free]], settled[to[free]] = at[free], p[free], 1
            lost = ~some & (at == first)
            fits[r[lost]] = False
            token[at[~some]] = -1  # back to the place before
            at = np.where(some, at, came[at])
            at[free] = to[free]
            go = ~lost & (at != stop[r])
            r, at, first = r[go], at[go], first[go]
        token = token[own]
        token[~fits[run]] = -1
        ids = token[token >= 0].tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(run[token >= 0], minlength=len(runs)))]).tolist()
        return [ids[4 * a : 4 * b] if ok else np.array(self.path(x), np.int32).tobytes() for x, ok, a, b in zip(runs, fits.tolist(), cuts[:-1], cuts[1:], strict=True)]

    def _weights(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`joins` of many neighbours."""
        key = a * 1_048_576 + b
        i = np.searchsorted(self.met, key)
        known = np.zeros(len(key), bool)
        if len(self.met):
            known = self.met[np.minimum(i, len(self.met) - 1)] == key
        if not known.all():
            new = np.unique(key[~known])
            if len(self.met) + len(new) > 10 * PAIRS:
                self.met, self.weight_of = np.zeros(0, np.int64), np.zeros(0)
                new = np.unique(key)
            w = np.array([self.joins(k >> 20, k & 1_048_575) for k in new.tolist()])
            met = np.concatenate([self.met, new])
            order = np.argsort(met, kind="stable")
            self.met, self.weight_of = met[order], np.concatenate([self.weight_of, w])[order]
            i = np.searchsorted(self.met, key)
        return self.weight_of[i]

    def fallback(self, c: str) -> list[int]:
        return [self.bytes_of[x] for x in c.encode("utf-8", "replace")] if self.byte_fallback else [self.unk]

    # --- whole texts
    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. A run is worked out once for all the texts, and remembered beyond them if it came twice."""
        cut = [self._cut(self.normalise(t or "")) for t in texts]
        ids = {x: np.array([i], np.int32).tobytes() for x, i in self.own.items()}
        new, many = [], []
        for r, n in Counter(chain.from_iterable(cut)).items():
            if r not in ids:
                b = self.runs.get(r)
                if b is None:
                    new.append(r)
                    many.append(n)
                else:
                    ids[r] = b
        for r, n, b in zip(new, many, self.paths(new), strict=True):
            ids[r] = b
            if n > 1 and len(r) < 200:
                self.runs.put(r, b)
        return [np.frombuffer(b"".join(map(ids.__getitem__, c)), np.int32) for c in cut]

    def _cut(self, text: str) -> list[str]:
        """Runs and user-defined pieces of a normalised text."""
        if self.user is None:
            return self.run.findall(text)
        return [r for i, x in enumerate(self.user.split(text)) for r in ([x] if i % 2 else self.run.findall(x))]

    def decode(self, ids: np.ndarray) -> str:
        n = self.text_size[ids]
        at = np.repeat(self.text_start[ids] - (np.cumsum(n) - n), n)
        b = self.text_bytes[at + np.arange(len(at))].tobytes()
        if self.dummy and b[:1] == b" ":
            b = b[1:]
        return b.decode("utf-8", "replace")


def encode(docs: DataFrame, key: str, text: str, model: bytes, decoded: bool = False) -> DataFrame:
    """Per row: key, ids, their number, whether the text decoded from them is the text again, and with ``decoded`` that text.

    The machine is compiled, and its memory of runs freed, task by task. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            m = m or Machine(sent.value)
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy())
            cuts = np.flatnonzero(np.diff(ends // TEXTS_AT_ONCE, prepend=0))  # a new part where so many bytes are full
            for at, end in pairwise([0, *cuts[cuts > 0], len(b)]):
                part = b.slice(at, end - at)
                texts = part.column(1).to_pylist()
                ids = m.encode_all(texts)
                back, same = [], []
                for i, t in zip(ids, texts, strict=True):
                    d = m.decode(i)
                    same.append(d == (t or ""))
                    if decoded:
                        back.append(d)
                n = np.array([len(i) for i in ids], np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.array([], np.int32)))
                more = {"decoded": pa.array(back, pa.string())} if decoded else {}
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "ids": flat, "n_tokens": pa.array(n), "round_trip": pa.array(same, pa.bool_()), **more})

    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(lean(run), SCHEMA + ", decoded string" * decoded)
