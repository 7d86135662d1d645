"""Tokenizers over sequence columns: additive-score Viterbi, rank-merging BPE, the motif tokenizer, k-mers.

Sequential decoders run as Arrow UDFs over a vocabulary that is sent out once (a few thousand entries, checked).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.columns import chunks
from .bpe_train import Cut

MAX_VOCAB = 1_000_000
TOKENS = "array<struct<token:string,start:int,end:int>>"
UNK = "[UNK]"


def load_tokenizer(text: str) -> dict:
    """A tokenizer JSON of either kind as {kind, vocab: [(token, id, score)], merges: [(left, right)], unk_id}.

    Vocabularies come as maps or lists of pairs, merges as pairs or 'left right' strings; a missing unk_id is set where [UNK] is in the vocabulary.
    """
    model = json.loads(text)["model"]
    v = model["vocab"]
    rows = [(t, i, 0.0) for t, i in v.items()] if isinstance(v, dict) else [(t, i, float(s)) for i, (t, s) in enumerate(v)]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model.get("merges", [])]
    unk = model.get("unk_id")
    if unk is None:
        unk = next((i for t, i, _ in rows if t == UNK), None)
    return {"kind": "unigram" if isinstance(v, list) else "bpe", "vocab": rows, "merges": merges, "unk_id": unk}


def dump_tokenizer(kind: str, vocab: list[tuple[str, float]], merges: list[tuple[str, str]] | None = None, unk_id: int | None = None) -> str:
    """K8: the model as JSON."""
    if kind == "unigram":
        return json.dumps({"model": {"type": "Unigram", "vocab": [[t, s] for t, s in vocab], "unk_id": unk_id}})
    return json.dumps({"model": {"type": "BPE", "vocab": {t: i for i, (t, _) in enumerate(vocab)}, "merges": [list(m) for m in merges or []], "unk_token": UNK}})


def viterbi(text: str, scores: dict[str, float], longest: int, unk: float | None = None) -> list[tuple[str, int, int]]:
    """Best sum of scores; on ties the earliest start of the last token. Runs of unknown letters are one token, or an error without ``unk``."""
    n = len(text)
    best, back = [0.0] + [None] * n, [0] * (n + 1)
    known = [True] * (n + 1)
    for i in range(1, n + 1):
        for j in range(max(0, i - longest), i):
            if best[j] is not None and (s := scores.get(text[j:i])) is not None and (best[i] is None or best[j] + s > best[i]):
                best[i], back[i], known[i] = best[j] + s, j, True
        if text[i - 1] not in scores and best[i - 1] is not None:
            if unk is None:
                if best[i] is None:
                    raise ValueError(f"unknown letter {text[i - 1]!r}")
            elif best[i] is None or best[i - 1] + unk > best[i]:
                best[i], back[i], known[i] = best[i - 1] + unk, i - 1, False
    out: list[tuple[str, int, int]] = []
    i = n
    while i:
        j = back[i]
        if not known[i]:
            while j and not known[j]:
                j = back[j]
        out.append((text[j:i], j, i))
        i = j
    return out[::-1]


def bpe(text: str, ranks: dict[tuple[str, str], int], vocab: set[str] | None = None) -> list[tuple[str, int, int]]:
    """Merges the neighbouring pair of lowest rank, the leftmost first; letters outside the vocabulary are [UNK].

    A queue of pairs over a linked list: n log n in the length.
    """
    n = len(text)
    part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i] if part[i] == a else n
        if j >= n or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get((part[i], part[after[j]]))) is not None:
                heapq.heappush(queue, (r, i, part[i], part[after[j]]))
        if before[i] >= 0 and (r := ranks.get((part[before[i]], part[i]))) is not None:
            heapq.heappush(queue, (r, before[i], part[before[i]], part[i]))
    return [(p if vocab is None or p in vocab else UNK, i, i + len(p)) for i, p in enumerate(part) if p is not None]


def motif_tokens(text: str, motifs: set[str], triples: set[str], choose: Callable[[int, list[str]], str], short: int = 4, long: int = 12) -> list[str]:
    """At each place one of the dictionary words of 4 to 12 letters that ``choose`` picks, else a known 3-mer, else a letter.

    From a token of more than one letter, a strictly longer one that starts one or two places on is preferred, and the
    letters before it stand alone; a single letter looks no further.
    """

    def pick(i: int) -> str:
        found = [w for k in range(short, long + 1) if i + k <= len(text) and (w := text[i : i + k]) in motifs]
        if found:
            return found[0] if len(found) == 1 else choose(i, found)
        return text[i : i + 3] if text[i : i + 3] in triples else text[i : i + 1]

    out, i = [], 0
    while i < len(text):
        w, at = pick(i), i
        for ahead in (1, 2) if len(w) > 1 else ():
            if i + ahead < len(text) and len(x := pick(i + ahead)) > len(w):
                w, at = x, i + ahead
        out += list(text[i:at])
        out.append(w)
        i = at + len(w)
    return out


# --- many sequences at once
#: Letters that are decoded side by side; sequences below which a single one is decoded by itself.
LETTERS, SIDE_BY_SIDE = 400_000, 16
#: Letters of a stretch that an automaton reads side by side with others.
STRETCH = 256
#: A prime below 2**31 that is not 1 modulo 3, so that cubes modulo it are all different (a fixed value).
PRIME = 2_147_483_579


class Letters:
    """Sequences one after the other: code points, and where each begins and ends."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "".join(texts)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.row = np.repeat(np.arange(len(texts)), size)


class Automaton:
    """The words that end at each letter, found in one pass (Aho and Corasick 1975), as packed tables that are sent out once.

    ``go`` (state, letter) -> state, column 0 for letters in no word; ``ends`` (state, k - 1) -> number of the word of k
    letters that ends there, or -1.
    """

    def __init__(self, words: list[str]) -> None:
        self.letters = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
        self.longest = max(map(len, words), default=1) or 1
        column = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        child: list[dict[int, int]] = [{}]
        own = {}
        for i, w in enumerate(words):
            at = 0
            for c in w:
                if column[c] not in child[at]:
                    child[at][column[c]] = len(child)
                    child.append({})
                at = child[at][column[c]]
            if w:
                own[at] = (len(w), i)
        self.go = np.zeros((len(child), len(column) + 1), np.int32)
        self.ends = np.full((len(child), self.longest), -1, np.int32)
        fall, level = np.zeros(len(child), np.int64), [0]
        while level:  # by depth, so that what a state falls back to is ready
            below = []
            for at in level:
                if at:
                    self.go[at] = self.go[fall[at]]
                    self.ends[at] = self.ends[fall[at]]
                if at in own:
                    k, i = own[at]
                    self.ends[at, k - 1] = i
                for c, to in child[at].items():
                    fall[to] = self.go[at, c] if at else 0
                    self.go[at, c] = to
                    below.append(to)
            level = below

    def columns(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros(len(codes), np.int64)
        i = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[i] == codes, i + 1, 0)

    def states(self, t: Letters) -> np.ndarray:
        """The state behind each letter. Long sequences are cut into stretches: a state hangs on the last ``longest`` letters only."""
        out = np.zeros(len(t.codes), np.int32)
        if not len(out):
            return out
        col = self.columns(t.codes)
        size = t.end - t.start
        many = -(-size // STRETCH)
        first = np.repeat(t.start, many) + STRETCH * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        stop = np.minimum(first + STRETCH, np.repeat(t.end, many))
        at = np.maximum(first - self.longest + 1, np.repeat(t.start, many))
        state = np.zeros(len(at), np.int32)
        while len(at):
            state = self.go[state, col[at]]
            on = at >= first
            out[at[on]] = state[on]
            at = at + 1
            left = at < stop
            if not left.all():
                at, state, first, stop = at[left], state[left], first[left], stop[left]
        return out


def viterbi_all(t: Letters, words: Automaton, scores: np.ndarray, unk: float | None, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """:func:`viterbi` of many sequences, a place of all of them at a time: (first letter of each token, whether it is known).

    A word of score -inf is none; ``state`` is what the automaton gives for ``t``, if it is known already.
    """
    n, longest = len(t.codes), words.longest
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    gain = np.full((longest + 1, len(words.ends)), -np.inf)  # by state; the longest word first, an unknown letter last
    for k in range(1, longest + 1):
        w = words.ends[:, k - 1]
        gain[longest - k, w >= 0] = scores[w[w >= 0]]
    if unk is not None:
        gain[longest, ~np.isfinite(gain[longest - 1])] = unk
    state = words.states(t) if state is None else state
    back = np.array([*range(longest, 0, -1), 1])
    size = t.end - t.start
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")
    slot = (t.start + np.arange(len(size)))[order]  # a sequence has a place more than letters
    best = np.full(n + len(size) + longest, -np.inf)[: n + len(size)]
    arc = np.zeros(len(best), np.int64)
    best[slot] = 0.0
    for i in range(1, int(size.max()) + 1):
        at = slot[: live[i - 1]] + i
        total = best[at - back[:, None]] + gain[:, state[t.start[order[: len(at)]] + i - 1]]
        arm = total.argmax(0)
        best[at], arc[at] = total[arm, np.arange(len(at))], arm
    ends = t.end + np.arange(len(size))
    if not np.isfinite(best[ends]).all():
        raise ValueError("unknown letter")
    first, known = np.zeros(n, bool), np.zeros(n, bool)
    own = np.flatnonzero(size)
    at = ends[own]
    while len(own):
        arm = arc[at]
        at = at - back[arm]
        place = at - own
        first[place], known[place] = True, arm < longest
        on = place > t.start[own]
        own, at = own[on], at[on]
    start = np.flatnonzero(first)
    known = known[start]
    again = np.zeros(len(start), bool)  # an unknown letter behind another
    again[1:] = ~known[1:] & ~known[:-1] & (t.row[start[1:]] == t.row[start[:-1]])
    return start[~again], known[~again]


class Merges:
    """Ranked merges over numbered tokens: 0 for letters that no merge takes."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        ranks = {m: i for i, m in enumerate(merges)}  # of equal merges the last
        number: dict[str, int] = {}
        for a, b in ranks:
            for x in (a, b, a + b):
                number.setdefault(x, len(number) + 1)
        self.size = len(number) + 1
        one = sorted((ord(x), i) for x, i in number.items() if len(x) == 1)
        self.points, self.numbers = np.array([c for c, _ in one], np.uint32), np.array([i for _, i in one], np.int32)
        n = len(merges)
        self.left, self.right, self.made = (np.zeros(n, np.int32) for _ in range(3))
        for (a, b), r in ranks.items():
            self.left[r], self.right[r], self.made[r] = number[a], number[b], number[a + b]
        pairs = sorted((number[a] * self.size + number[b], r) for (a, b), r in ranks.items())
        self.keys, self.ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        takes: dict[int, int] = {}  # token -> the least rank of a merge that takes it
        for (a, b), r in ranks.items():
            for x in (number[a], number[b]):
                takes[x] = min(r, takes.get(x, r))
        #: Merges whose token an earlier merge takes.
        self.back = np.array([takes.get(int(m), n) < r for r, m in enumerate(self.made)], bool)
        self.lengths = np.array([0, 1, *map(len, number)])  # of numbers one higher: 0 ends a sequence, 1 is a letter that no merge takes
        self.names = [None, None, *number]
        once = len(ranks) == n and all(a and b for a, b in ranks) and len(set(self.made.tolist())) == n and not self.back.any()
        self.phases = self._phases() if once else []

    def _phases(self) -> list[tuple[Cut, list[tuple[int, int, int]]]]:
        """Runs of merges, each twice as long as all before, and where they may be cut: a merge joins two tokens of the run's beginning, whatever was merged beside them."""
        out, lo = [], 0
        while lo < len(self.made):
            hi, first, last, kept = max(4, 2 * lo), {}, {}, set()
            run = [(int(a) + 1, int(b) + 1, int(m) + 1) for a, b, m in zip(self.left[lo:hi], self.right[lo:hi], self.made[lo:hi], strict=True)]
            for a, b, m in run:
                kept.add((last.get(a, a), first.get(b, b)))
                first[m], last[m] = first.get(a, a), last.get(b, b)
            known = 1 + int(max(self.numbers.max(initial=0) + 1, self.made[:lo].max(initial=0) + 1, *(max(x) for x in kept)))
            size = self.size + 1
            out.append((Cut(np.array(sorted(a * size + b for a, b in kept), np.int64), known, size), run))
            lo = hi
        return out

    def tokens(self, t: Letters) -> np.ndarray:
        """The tokens, as numbers one higher; 0 after each sequence. Equal pieces are merged once a phase."""
        ids = np.insert((self.letters(t.codes) + 1).astype(np.uint16 if self.size < (1 << 16) - 1 else np.uint32), t.end, 0)
        for cut, run in self.phases:
            ids = cut.merge(ids, run)
        return ids

    def letters(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(codes), np.int32)
        i = np.minimum(np.searchsorted(self.points, codes), len(self.points) - 1)
        return np.where(self.points[i] == codes, self.numbers[i], 0).astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; -1 for those that aren't merged."""
        if not len(self.keys):
            return np.full(len(a), -1)
        k = a.astype(np.int64) * self.size + b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.ranks[i], -1)


def bpe_all(t: Letters, merges: Merges) -> np.ndarray:
    """:func:`bpe` of many sequences: first letter of each token.

    Places wait under the rank of the pair that begins there; the least rank of all comes next and is done at all its places
    at once, and only the pairs beside them are looked up anew. So a letter is touched as often as it is merged, whatever the
    number of merges. Where a merge's token is taken by an earlier merge, one place of each sequence is done at a time,
    since the next least rank may then be lower.
    """
    n = len(t.codes)
    token = merges.letters(t.codes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    own = t.end > t.start
    after[t.end[own] - 1], before[t.start[own]] = -1, -1
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        r = merges.rank(token[at], token[after[at]])
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(np.diff(r, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
            rank = int(r[lo])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(queue, rank)
            waiting[rank].append(at[lo:hi])

    enter(np.flatnonzero(after >= 0))
    while queue:
        r = heapq.heappop(queue)
        parts = waiting.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[(token[at] == merges.left[r]) & (after[at] >= 0)]
        at = at[token[after[at]] == merges.right[r]]
        if not len(at):
            continue
        if merges.left[r] == merges.right[r]:  # every other place of a run
            head = np.concatenate([[True], after[at[:-1]] != at[1:]])
            first = np.flatnonzero(head)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
        if merges.back[r]:
            one = np.concatenate([[True], np.diff(t.row[at]) != 0])
            if not one.all():
                waiting[r] = [at[~one]]
                heapq.heappush(queue, r)
                at = at[one]
        gone = after[at]
        behind = after[gone]
        token[at], token[gone], after[at] = merges.made[r], -1, behind
        inner = behind >= 0
        before[behind[inner]] = at[inner]
        left = before[at]
        enter(np.unique(np.concatenate([left[left >= 0], at[inner]])))
    return np.flatnonzero(token >= 0)


def word_factors(words: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below 2**28 for each word, from md5 of seed and word."""
    h = [hashlib.md5(f"{seed}:{w}".encode()).hexdigest() for w in words]
    return np.array([int(x[:7], 16) for x in h], np.int64), np.array([int(x[7:14], 16) + 1 for x in h], np.int64)


def drawn(place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A word's lot at a place: the cube of place plus a, times b, modulo ``PRIME``."""
    x = (place + a) % PRIME
    return x * x % PRIME * x % PRIME * b % PRIME


def motif_starts(t: Letters, words: Automaton, triples: Automaton, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """:func:`motif_tokens` of many sequences, of several words the one of the least lot (the shorter on ties): first letter of each token."""
    n = len(t.codes)
    if not n:
        return np.zeros(0, np.int64)
    pick, least = np.ones(n, np.int64), np.full(n, PRIME)
    if triples.longest == 3:
        at = np.flatnonzero(triples.ends[triples.states(t), 2] >= 0) - 2
        pick[at] = 3
    state = words.states(t)
    place = np.arange(n) - t.start[t.row]
    for k in range(1, words.longest + 1):
        w = words.ends[state, k - 1]
        at = np.flatnonzero(w >= 0)
        w = w[at]
        at = at - k + 1
        lot = drawn(place[at], factors[0][w], factors[1][w])
        on = lot < least[at]
        pick[at[on]], least[at[on]] = k, lot[on]
    end = t.end[t.row]
    padded = np.append(pick, [0, 0])
    one = np.where(np.arange(n) + 1 < end, padded[1 : n + 1], 0)
    two = np.where(np.arange(n) + 2 < end, padded[2 : n + 2], 0)
    skip = ((pick > 1) & (one > pick)).astype(np.int64)
    size = np.where(skip == 1, one, pick)
    skip[(pick > 1) & (two > size)] = 2
    size = np.where(skip == 2, two, size)
    to = np.arange(n) + skip + size
    jump = np.append(np.where(to < end, to, n), n)  # n: behind the last token
    met = np.zeros(n + 1, bool)
    met[t.start[t.end > t.start]] = True
    reach, most = 1, int((t.end - t.start).max())
    while reach <= most:  # the places met so far, and as many tokens on: twice as many each round
        met[jump[np.flatnonzero(met)]] = True
        jump = jump[jump]
        reach *= 2
    at = np.flatnonzero(met[:n])
    return np.unique(np.concatenate([at, at[skip[at] > 0] + 1, at[skip[at] > 1] + 2]))


def _arrays(t: Letters, start: np.ndarray, unknown: np.ndarray | None, offsets: bool) -> tuple[pa.Array, np.ndarray]:
    """Tokens that begin at ``start`` and go on to the next, as strings (or structs with their offsets), and their number in each sequence."""
    c = t.codes
    at = np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])
    ends = np.append(start, len(c)).astype(np.int64)
    names_ = pa.StringArray.from_buffers(len(start), pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(t.text.encode("utf-8", "surrogatepass")))
    if unknown is not None and unknown.any():
        names_ = pc.if_else(pa.array(unknown), UNK, names_)
    row = t.row[start] if len(start) else np.zeros(0, np.int64)
    many = np.bincount(row, minlength=len(t.start))
    if not offsets:
        return names_, many
    first = t.start[row]
    return pa.StructArray.from_arrays([names_, pa.array((start - first).astype(np.int32)), pa.array((ends[1:] - first).astype(np.int32))], ["token", "start", "end"]), many


def _udf(spark: SparkSession, state: object, f: Callable[[Letters, object], tuple[np.ndarray, np.ndarray | None]], offsets: bool) -> Callable[[Column], Column]:
    sent = spark.sparkContext.broadcast(state)

    def run(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = sent.value
        for c in col:
            texts, parts, many = c.fill_null("").to_pylist(), [], []
            at = 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and (total < LETTERS or to == at):
                    total += len(texts[to])
                    to += 1
                t = Letters(texts[at:to])
                part, n = _arrays(t, *f(t, state), offsets)
                parts.append(part)
                many.append(n)
                at = to
            if not parts:
                yield pa.array([], pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]) if offsets else pa.string()))
                continue
            ends = np.concatenate([[0], np.cumsum(np.concatenate(many))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts), mask=c.is_null())

    return F.arrow_udf(run, TOKENS if offsets else "array<string>")


def unigram_decoder(spark: SparkSession, scores: dict[str, float], unk: float | None = None, offsets: bool = True) -> Callable[[Column], Column]:
    """Column function: sequence -> tokens with offsets, or as strings."""
    if len(scores) > MAX_VOCAB:
        raise ValueError("vocabulary too large to send out")
    longest = max(map(len, scores), default=1)

    def f(t: Letters, s: tuple) -> tuple[np.ndarray, None]:
        words, values, plain = s
        if len(t.start) >= SIDE_BY_SIDE:
            return viterbi_all(t, words, values, unk)[0], None
        return np.array([a + int(x) for a, b in zip(t.start, t.end, strict=True) for _, x, _ in viterbi(t.text[a:b], plain, longest, unk)], np.int64), None

    return _udf(spark, (Automaton(list(scores)), np.array(list(scores.values()), float), scores), f, offsets)


def bpe_encoder(spark: SparkSession, merges: list[tuple[str, str]], vocab: set[str] | None = None, offsets: bool = True) -> Callable[[Column], Column]:
    """Column function: sequence -> tokens with offsets, or as strings; tokens outside ``vocab`` are [UNK]."""
    if len(merges) > MAX_VOCAB:
        raise ValueError("too many merges to send out")

    def f(t: Letters, s: tuple) -> tuple[np.ndarray, np.ndarray | None]:
        if s[0].phases:
            ids = s[0].tokens(t)
            ids, ends = ids[ids > 0], np.cumsum(s[0].lengths[ids])[ids > 0]
            start = ends - s[0].lengths[ids]
            if s[1] is None:
                return start, None
            unknown = np.array([x not in s[1] for x in s[0].names])[ids]
            letters = np.flatnonzero(ids == 1)
            unknown[letters] = [t.text[a] not in s[1] for a in start[letters].tolist()]
            return start, unknown
        start = bpe_all(t, s[0])
        if s[1] is None:
            return start, None
        ends = np.append(start[1:], len(t.codes))
        return start, np.fromiter((t.text[a:b] not in s[1] for a, b in zip(start.tolist(), ends.tolist(), strict=True)), bool, len(start))

    return _udf(spark, (Merges(merges), vocab), f, offsets)


def motif_tokenizer(spark: SparkSession, motifs: set[str], seed: int = 0, triples: set[str] | None = None, offsets: bool = True) -> Callable[[Column], Column]:
    """Of several words the one whose lot, drawn from seed, word and place, is least: equal texts tokenise alike in any partitioning."""
    known = {a + b + c for a in "ATCG" for b in "ATCG" for c in "ATCG"} if triples is None else triples
    words = sorted(w for w in motifs if 4 <= len(w) <= 12)
    state = (Automaton(words), Automaton(sorted(known)), word_factors(words, seed))
    return _udf(spark, state, lambda t, s: (motif_starts(t, *s), None), offsets)


#: Counts that a worker of a sweep holds before it sends them on.
HELD = 1 << 22


def sweep_counts(df: DataFrame, seq: str, by: list[str], models: dict[str, dict[str, float]], unk: float) -> DataFrame:
    """(model, by..., token, cnt): each sequence decoded by several additive vocabularies in one pass; unknown runs count as [UNK].

    One automaton holds the words of all models, so a letter is looked up once; a model is a vector of scores over them.
    """
    if sum(map(len, models.values())) > MAX_VOCAB:
        raise ValueError("vocabularies too large to send out")
    words = sorted({w for m in models.values() for w in m if w})
    scores = {name: np.array([m.get(w, -np.inf) for w in words]) for name, m in models.items()}
    sent = df.sparkSession.sparkContext.broadcast((Automaton(words), words, scores))
    kinds = [df.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, words, scores = sent.value
        names = np.array([*words, UNK], dtype=object)
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (model, *key), n in held.items():
                on = np.flatnonzero(n)
                cols = [pa.array([model] * len(on), pa.string()), *(pa.array([v] * len(on), x) for v, x in zip(key, types, strict=True))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names[on], pa.string()), pa.array(n[on])], ["model", *by, "token", "cnt"])
            held.clear()

        for b in batches:
            types = [b.column(i).type for i in range(len(by))]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * len(b)
            texts, at = b.column(len(by)).fill_null("").to_pylist(), 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and (total < LETTERS or to == at):
                    total += len(texts[to])
                    to += 1
                t, number = Letters(texts[at:to]), {}
                group = np.array([number.setdefault(k, len(number)) for k in keys[at:to]], np.int64)
                at = to
                if not len(t.codes):
                    continue
                state = automaton.states(t)
                for model, s in scores.items():
                    start, known = viterbi_all(t, automaton, s, unk, state)
                    ends = np.append(start[1:], len(t.codes))
                    w = np.where(known, automaton.ends[state[ends - 1], np.minimum(ends - start, automaton.longest) - 1], len(words))
                    n = np.bincount(group[t.row[start]] * len(names) + w, minlength=len(number) * len(names)).reshape(-1, len(names))
                    for key, g in number.items():
                        held[model, *key] = held.get((model, *key), 0) + n[g]
                if len(held) * len(names) > HELD:
                    yield from out()
        if held:
            yield from out()

    schema = StructType([StructField("model", StringType()), *kinds, StructField("token", StringType()), StructField("cnt", LongType())])
    return df.select(*by, seq).mapInArrow(run, schema).groupBy("model", *by, "token").agg(F.sum("cnt").alias("cnt"))


class Tokenizer(Protocol):
    """Anything that turns a sequence column into a column of tokens (with offsets) and knows its vocabulary."""

    vocab: set[str]

    def tokenize(self, seq: Column) -> Column: ...


class LoadedTokenizer:
    """The tokenizer of :func:`load_tokenizer`'s result; unknown letters cost ``unk`` in a unigram model."""

    def __init__(self, spark: SparkSession, model: dict, unk: float = -100.0) -> None:
        self.vocab = {t for t, _, _ in model["vocab"]}
        if model["kind"] == "unigram":
            self._column = unigram_decoder(spark, {t: s for t, _, s in model["vocab"] if t}, unk if model["unk_id"] is not None else None)
        else:
            self._column = bpe_encoder(spark, model["merges"], self.vocab)

    def tokenize(self, seq: Column) -> Column:
        return self._column(seq)


def in_chunks(df: DataFrame, seq: str, size: int, tokenize: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """Pieces of ``size`` letters tokenised alone; no token spans a piece's edge."""
    d = df.select(*keep, F.posexplode(chunks(seq, size)).alias("piece", "part"))
    return d.withColumn("tokens", tokenize(F.col("part")))


def names(tokens: Column | str) -> Column:
    return F.transform(tokens, lambda t: t["token"])


def has_unknown(tokens: Column | str) -> Column:
    """Whether [UNK] is among the tokens."""
    return F.array_contains(names(tokens), UNK)
