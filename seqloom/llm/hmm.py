"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

*Tokens.* Lower-cased (A-Z) words between blanks, then one end. *Symbols.* The ``HEAD`` commonest words, the end, and
64 spelling classes for all other words; a word of a class has the share (c+0.5) of the class's mass, of which one
share of 0.5 is for words never seen. States emit symbols, so the model is one distribution over all texts while its
tables stay bounded.

*Training.* Word counts come from all training texts, which are then written once as symbols. Each pass runs forward and
backward over every training text and sums the expected counts over all partitions; the driver gets the summed tables,
whose size is fixed. The first pass starts from seeded noise. Passes go on until one raises the training texts' log10
likelihood by less than ``TOLERANCE`` a token, at least ``LEAST_PASSES`` and at most ``MOST_PASSES``. Texts of more than
``PIECE`` tokens are counted in pieces whose messages at the borders are those of the whole text: of a window beside the
border where nothing beyond it can change them by more than ``ALIKE``, else carried through the matrices of the pieces, so
the counts are exact in bounded memory. Counts are summed as integers, so sums don't depend on the order of partitions.

*Scores.* The forward recursion runs over whole texts, however long. Words outside the head need their counts, of
which there are as many as distinct words: the commonest ``KNOWN`` are sent to all, the others are joined by word, as narrow
rows (a hash of the word, the text's number), and summed per text. Head words, the hot keys of such a join, never enter it.

Defined results: a null or empty text is its end alone; a null key is training data; without training texts every word
has the share of unseen words; repeated rows are scored and counted each. Words are told apart by 57 bits of hash and class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Lookup, buffer_of, words
from .runtime import discard, lean, written

HEAD, CLASSES, STATES = 65_536, 64, 8
LEAST_PASSES, MOST_PASSES, TOLERANCE, PIECE = 12, 24, 0.002, 2048
TOKENS_AT_ONCE = 1_000_000
#: Forward sums are scaled each so many tokens: far fewer than would take a product of probabilities out of a double's range.
SCALED = 8
#: Tokens whose emissions are looked up at once.
ROWS = 16_384
#: A border's message is taken from up to so many tokens beside it once nothing further away can change any of its numbers by more than this share.
WINDOW, ALIKE = 512, 1e-12
#: Words beyond the head whose counts are sent to all; the counts of all others are joined.
KNOWN = 500_000
#: Rows of the tables that go as one row from a pass's tasks to those that add them up.
BLOCK = 128
#: Bytes of symbols that are counted or scored together: the more texts, the wider the steps from token to token.
SYMBOLS_AT_ONCE = 24_000_000
#: Least weight of the unigram in a state's emissions, in tokens.
PRIOR = 100.0
_U = np.uint64
_UNIT = 2.0**16
END_KEY = -1  # as a signed word key; no word has it


def spelling(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each word below 64: its last character, and the first that isn't ASCII (its code point)."""
    kind = _ENDING[data[end - 1]]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead) < len(start):  # each is looked for among the words, else each word among them
        at = np.searchsorted(start, lead, side="right") - 1
        one = np.flatnonzero(np.diff(at, prepend=-1))
        on, at = at[one], one
    else:
        at = np.searchsorted(lead, start)
        on = np.flatnonzero(at < np.searchsorted(lead, end))
        at = at[on]
    if len(on):
        p = lead[at]
        b = np.stack([data[np.minimum(p + j, len(data) - 1)] for j in range(4)]).astype(np.int64)
        low = b & 63
        point = np.where(b[0] < 0xE0, (b[0] & 31) << 6 | low[1], np.where(b[0] < 0xF0, (b[0] & 15) << 12 | low[1] << 6 | low[2], (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]))
        kind[on] += 1 + point % 15
    return kind


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_ENDING = np.where(_ALNUM | (np.arange(256) >= 0x80), 0, 48)
_ENDING[[0x2E, 0x2C]] = 16, 32


def tokens(col: pa.Array, head: Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, and the number of words of each text (null: none).

    A code is the symbol of a head word, else the word's key: top bit set, hash, class in the low bits.
    """
    data, offsets = buffer_of(col)
    start, end, h = words(data, offsets)
    n = np.diff(np.searchsorted(start, offsets))
    key = _U(1 << 63) | (h >> _U(7) << _U(6)) & _U(2**63 - 1) | spelling(data, start, end).astype(_U)
    key -= (key == _U(2**64 - 1)).astype(_U) << _U(6)
    if head is not None:
        symbol = head.get(key)
        key = np.where(symbol >= 0, symbol.astype(np.int64).view(_U), key)
    return key, n


def _count_words(docs: DataFrame) -> DataFrame:
    """(key, c) over all texts, the end too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(k)
            k, c = k[order], c[order]
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            return k[cut], np.add.reduceat(c, cut) if len(cut) else c

        def out(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["key", "c"])

        for b in batches:
            code, n = tokens(b.column(0))
            ends += len(n)
            k, c = np.unique(code, return_counts=True)
            held.append((k, c.astype(np.int64)))
            size += len(k)
            if size > 1_500_000:
                k, c = merged()
                if len(k) > 750_000:
                    yield out(k, c)
                    held, size = [], 0
                else:
                    held, size = [(k, c)], len(k)
        if held:
            yield out(*merged())
        if ends:
            yield out(np.array([END_KEY]), np.array([ends]))

    return docs.select("text").mapInArrow(lean(run), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Model:
    """Start, transition and emission tables (symbols x states), head symbols, and the unigram's parts."""

    def __init__(self, head: np.ndarray, head_c: np.ndarray, end_c: int, mass: np.ndarray, total: int, distinct: int, states: int = STATES) -> None:
        self.head = Lookup(head.view(np.uint64), np.arange(len(head)))
        self.n_head, self.end = len(head), len(head)
        self.total, self.distinct = total, distinct
        self.norm = total + 0.5 * (distinct + 1)
        self.least = int(head_c.min()) if len(head_c) else 0  # count of a head word
        self.mass = mass  # of each class: counts and halves of its words, and one half
        c = np.concatenate([head_c + 0.5, [end_c + 0.5], mass])
        self.base = np.log10(np.concatenate([head_c + 0.5, [end_c + 0.5]]) / self.norm)
        self.end_known = end_c > 0
        self.unigram = c / c.sum()
        self.passes = 0
        self.a = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        self.pi = np.full(states, 1 / states)
        noise = np.exp(np.random.default_rng(2).normal(scale=0.5, size=(len(c), states)))
        b = self.unigram[:, None] * noise
        self.b = b / b.sum(0)

    def symbols(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Symbols of texts in a row, each with its end."""
        code = code.view(np.int64)  # a word's key is negative
        out, word = np.full(len(code) + len(n), self.end, np.int64), np.ones(len(code) + len(n), bool)
        word[np.cumsum(n + 1) - 1] = False
        out[word] = np.where(code < 0, (code & 63) + self.end + 1, code)
        return out

    def expected(self, sym: np.ndarray, n: np.ndarray, into: list[np.ndarray]) -> None:
        """Adds expected counts of texts (symbols in a row, lengths n, none empty) to [start, transitions, emissions, log likelihood]."""
        pieces = -(-n // PIECE)
        p = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # a piece's place in its text
        first = np.repeat(np.cumsum(n) - n, pieces) + p * PIECE
        size = np.minimum(np.repeat(np.cumsum(n), pieces) - first, PIECE)
        k = len(self.pi)
        before, behind = np.zeros((len(p), k)), np.ones((len(p), k))
        if len(long := np.flatnonzero(np.repeat(pieces, pieces) > 1)):
            before[long], behind[long] = self._messages(sym, first[long], size[long], p[long])
        order = np.argsort(-size, kind="stable")
        ends = np.cumsum(size[order])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ends // TOKENS_AT_ONCE)) + 1, [len(order)]])
        most = int(np.diff(np.concatenate([[0], ends])[cut]).max())
        room = _room(most * k)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = order[lo:hi]
            self._count(sym, first[own], size[own], p[own] == 0, before[own], behind[own], into, room)

    def _messages(self, sym: np.ndarray, first: np.ndarray, size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`_borders` returns: by windows beside the borders, and through the pieces' matrices for texts where a window doesn't do."""
        k = len(self.pi)
        before, behind = np.zeros((len(p), k)), np.ones((len(p), k))
        text, own = np.cumsum(p == 0) - 1, np.flatnonzero(p)
        stop = (first + size)[np.append(p[1:] == 0, True)][text]
        v, told = self._windows(sym, first[own] - 1, p[own] * PIECE, True)
        w, foretold = self._windows(sym, first[own], (stop - first)[own], False)
        before[own], behind[own - 1] = v, w
        rest = np.isin(text, text[own[~(told & foretold)]])
        if rest.any():
            before[rest], behind[rest] = self._borders(sym, first[rest], size[rest], p[rest])
        return before, behind

    def _windows(self, sym: np.ndarray, at: np.ndarray, tokens: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Messages over borders by the tokens on one side (``at`` is the nearest, the text has so many there), and which of them are found.

        A window's matrix, state at its far end by state at the border, grows token by token. Once its rows are alike to ``ALIKE`` of each number,
        so is their weighted mean, whatever the weights: the message doesn't depend on what lies beyond. At the text's edge it is known anyway.
        """
        k, step = len(self.pi), -1 if forward else 1
        out, found = np.ones((len(at), k)), np.zeros(len(at), bool)
        back, run = np.ascontiguousarray(self.a.T), np.arange(len(at))
        x = np.repeat(np.eye(k)[:, :, None], len(at), axis=2)
        for d in range(WINDOW):
            if not len(run):
                break
            e = np.ascontiguousarray(self.b.take(sym.take(at[run] + step * d, mode="clip"), axis=0).T)[:, None]
            x = x * e if forward else (back @ x.reshape(k, -1)).reshape(x.shape) * e
            if len(edge := np.flatnonzero(tokens[run] == d + 1)):
                out[run[edge]] = np.einsum("i,ijp->pj", self.pi if forward else np.ones(k), x[:, :, edge])
                found[run[edge]] = True
            if forward:
                x = (self.a @ x.reshape(k, -1)).reshape(x.shape)
            if d % SCALED == SCALED - 1:
                x /= x.max((0, 1))
            if d % 32 == 31:
                r = x / x.sum(1, keepdims=True)
                low = r.min(0)
                alike = (r.max(0) - low <= ALIKE * low).all(0) & ~found[run]
                out[run[alike]] = r[:, :, alike].mean(0).T
                found[run[alike]] = True
                go = ~found[run]
                run, x = run[go], x[:, :, go]
        return out / (out.sum(1, keepdims=True) if forward else out.max(1, keepdims=True)), found

    def _borders(self, sym: np.ndarray, first: np.ndarray, size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pieces of long texts, in order: the states' distribution at the token before, and the weights of all that follows, by state.

        A text's first piece takes a vector forward, its last piece one backward, from its end; only pieces between them need their matrix
        (from the state before the emission at the first token to that at the last). All pieces go side by side, a token of each at a time;
        then vectors go through the matrices from piece to piece. All are exact but for a factor a piece.
        """
        k = len(self.pi)
        ends = np.append(p[1:] == 0, True)
        opens, mid, last = np.flatnonzero((p == 0) & ~ends), np.flatnonzero((p > 0) & ~ends), np.flatnonzero((p > 0) & ends)
        last = last[np.argsort(-size[last], kind="stable")]  # the longest first: those at work are a prefix; all others are of one size
        begins, stops, n = first[np.concatenate([opens, mid])], first[last] + size[last] - 1, len(opens)
        live = np.searchsorted(-size[last], -np.arange(1, int(size.max()) + 1), side="right")
        back = np.ascontiguousarray(self.a.T)
        v, w, x = np.empty((n, k)), np.empty((len(last), k)), np.repeat(np.eye(k)[:, :, None], len(mid), axis=2)  # (state at the end, state before, piece)
        for t, m in enumerate(live):
            e = self.b[sym[np.concatenate([begins + t, stops[:m] - t])]]
            f, g = e[: len(begins)], e[len(begins) :]
            v = (v @ self.a if t else self.pi) * f[:n]
            w[:m] = w[:m] @ back * g if t else g
            if len(mid):
                x = (x if t == 0 else (back @ x.reshape(k, -1)).reshape(x.shape)) * np.ascontiguousarray(f[n:].T)[:, None]
            if t % SCALED == SCALED - 1:
                v /= v.max(1, keepdims=True)
                w[:m] /= w[:m].max(1, keepdims=True)
                x /= x.max((0, 1))
        before, behind = np.zeros((len(p), k)), np.ones((len(p), k))
        before[opens + 1] = v / v.sum(1, keepdims=True)
        w = w @ back
        behind[last - 1] = w / w.max(1, keepdims=True)
        x = x.transpose(2, 1, 0)
        at = [np.flatnonzero(p[mid] == i) for i in range(1, int(p.max()))]
        for own in at:
            v = np.einsum("pi,pij->pj", before[mid[own]] @ self.a, x[own])
            before[mid[own] + 1] = v / v.sum(1, keepdims=True)
        for own in reversed(at):
            w = np.einsum("pij,pj->pi", x[own], behind[mid[own]]) @ back
            behind[mid[own] - 1] = w / w.max(1, keepdims=True)
        return before, behind

    def _count(self, sym: np.ndarray, first: np.ndarray, size: np.ndarray, opens: np.ndarray, before: np.ndarray, behind: np.ndarray, into: list[np.ndarray], room: list[np.ndarray]) -> None:
        """Forward and backward over pieces, the longest first, all at once token by token; rows are ordered by (token, piece).

        Emissions are looked up for some tokens at a time, forward and again backward, and used while they are in cache.
        """
        k, longest = len(self.pi), int(size[0])
        live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # pieces of at least t tokens
        off = np.concatenate([[0], np.cumsum(live)])
        x = np.empty(off[-1], np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(off[:-1] // ROWS)) + 1, [longest]]).tolist()
        groups = list(zip(cuts[:-1], cuts[1:], strict=True))
        live, off = live.tolist(), off.tolist()
        for t in range(longest):
            np.add(first[: live[t]], t, out=x[off[t] : off[t + 1]])
        x = sym[x].astype(np.int64, copy=False)
        alpha, state = room[0][: len(x) * k].reshape(-1, k), room[1][: len(x) * k].reshape(k, -1)
        e, post = np.empty((2, max(off[hi] - off[lo] for lo, hi in groups), k))
        ones, back, shares = np.ones(k), np.ascontiguousarray(self.a.T), {}
        alpha[: live[0]] = np.where(opens[:, None], self.pi, before @ self.a)
        for lo, hi in groups:
            o = off[lo]
            np.take(self.b, x[o : off[hi]], axis=0, out=e[: off[hi] - o], mode="clip")
            for t in range(lo, hi):
                cur = alpha[off[t] : off[t + 1]]
                if t:
                    np.dot(alpha[off[t - 1] : off[t - 1] + live[t]], self.a, out=cur)
                cur *= e[off[t] - o : off[t + 1] - o]
                if t % SCALED == SCALED - 1:
                    shares[t] = share = 1 / (cur @ ones)
                    into[3] -= np.log(share).sum()
                    cur *= share[:, None]
        last = alpha[np.array(off)[size - 1] + np.arange(len(size))]
        into[3] += np.log(last @ ones).sum()
        beta = behind / (last * behind).sum(1, keepdims=True)  # of each piece's last token; alpha times beta sums to 1 at each token
        met = np.zeros((k, k))
        for lo, hi in reversed(groups):
            o, n = off[lo], off[hi] - off[lo]
            np.take(self.b, x[o : o + n], axis=0, out=e[:n], mode="clip")
            for t in range(hi - 1, lo - 1, -1):
                own = slice(off[t] - o, off[t + 1] - o)
                now, follow = e[own], beta[: live[t]]
                np.multiply(alpha[off[t] : off[t + 1]], follow, out=post[own])
                now *= follow
                if t in shares:
                    now *= shares[t][:, None]
                if t:
                    np.dot(now, back, out=follow)
            for i in range(0, n, 256):
                state[:, o + i : o + min(i + 256, n)] = post[i : min(i + 256, n)].T
            at = max(lo, 1)
            if at < hi and live[at - 1] == live[hi - 1]:  # no piece ends: each row's token before is one step of rows away
                met += alpha[off[at - 1] : off[hi - 1]].T @ e[off[at] - o : n]
            else:
                for t in range(at, hi):
                    met += alpha[off[t - 1] : off[t - 1] + live[t]].T @ e[off[t] - o : off[t + 1] - o]
        into[0] += state[:, : live[0]][:, opens].sum(1)
        into[1] += self.a * (met + before[~opens].T @ e[: live[0]][~opens])
        for i in range(k):
            into[2][:, i] += np.bincount(x, state[i], len(self.b))

    def update(self, got: list[np.ndarray]) -> None:
        start, trans, emit, _ = got
        self.pi = (start + 1) / (start + 1).sum()
        self.a = (trans + 1) / (trans + 1).sum(1, keepdims=True)
        # Witten-Bell: a state's share for the unigram follows its number of different symbols; unmet symbols keep the unigram's
        met = emit.sum(1) > 0
        n, kinds = emit.sum(0), PRIOR + (emit > 0.5).sum(0)
        u = np.where(met, self.unigram, 0.0)
        self.b = np.where(met[:, None], u.sum() * (emit + kinds * (u / u.sum())[:, None]) / (n + kinds), self.unigram[:, None])

    def empty(self) -> list[np.ndarray]:
        k = self.b.shape[1]
        return [np.zeros(k), np.zeros((k, k)), np.zeros_like(self.b), np.zeros(1)]

    def forward(self, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 likelihood of each text: the scaled forward recursion over all its symbols."""
        order = np.argsort(-n, kind="stable")
        first, length = (np.cumsum(n) - n)[order], n[order]
        out = np.zeros(len(n))
        if not len(n):
            return out
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts of at least t symbols
        cur, log, ones = self.pi * self.b[sym[first]], np.zeros(len(n)), np.ones(self.b.shape[1])
        for t in range(1, int(length[0])):
            m = live[t]
            now = cur[:m]  # texts that have ended stay as they are
            now[:] = now @ self.a
            now *= self.b.take(sym[first[:m] + t], axis=0)
            if t % SCALED == SCALED - 1:
                s = now @ ones
                now /= s[:, None]
                log[:m] += np.log(s)
        log += np.log(cur @ ones)
        out[order] = log / np.log(10)
        return out


#: Two arrays of a worker, which a pass leaves to the next one: fresh memory costs about as much as its use.
_ROOM: list[np.ndarray] = []


def _room(n: int) -> list[np.ndarray]:
    if not _ROOM or len(_ROOM[0]) < n:
        _ROOM.clear()
        _ROOM.extend((np.empty(n), np.empty(n)))
    return list(_ROOM)


def _free() -> None:
    _ROOM.clear()


def _batched(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 4_000_000) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= bytes_at_once:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(docs: DataFrame, text: str, learn: Column) -> tuple[Model, DataFrame]:
    """The model, and the table (key, c) of all words' counts."""
    spark = docs.sparkSession
    d = docs.filter(learn).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = written(_count_words(d), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    word = F.col("key") != END_KEY
    head = counts.filter(word).orderBy(F.desc("c"), "key").limit(HEAD).toArrow()
    top, c = head["key"].to_numpy(), head["c"].to_numpy().astype(float)
    end_c = sum(r["c"] for r in counts.filter(~word).collect())
    by_class = counts.filter(word).groupBy(F.col("key").bitwiseAND(F.lit(63)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass = np.full(CLASSES, 0.5)
    for r in by_class:
        mass[r["k"]] += r["c"] + 0.5 * r["n"]
    np.subtract.at(mass, top & 63, c + 0.5)
    model = Model(top, c, end_c, np.maximum(mass, 0.5), total, distinct)
    if not total:
        return model, counts

    sent = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n = tokens(b.column(0), sent.value.head)
            sym, n = sent.value.symbols(code, n).astype(np.int32), n + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 4), pa.py_buffer(sym)])
            yield pa.RecordBatch.from_arrays([pa.array(n), blobs.cast(pa.binary())], ["n", "s"])

    coded = written(d.select("text").mapInArrow(lean(encode), "n long, s binary"), "symbols")
    before = -np.inf
    for done in range(1, MOST_PASSES + 1):
        got = _pass(coded, model)
        model.update(got)
        gain, before = (got[3][0] - before) / total / np.log(10), got[3][0]
        if done >= LEAST_PASSES and gain < TOLERANCE:
            break
    model.passes = done
    discard(coded)
    return model, counts


def _pass(coded: DataFrame, model: Model) -> list[np.ndarray]:
    """Expected counts over all texts, summed over partitions."""
    k, n_sym = model.b.shape[1], len(model.b)
    sent = coded.sparkSession.sparkContext.broadcast(model)  # HEAD + CLASSES + 1 rows of STATES doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        got = m.empty()
        for held in _batched(batches, SYMBOLS_AT_ONCE):
            t = pa.Table.from_batches(held)
            m.expected(buffer_of(t["s"].combine_chunks())[0].view(np.int32), t["n"].to_numpy(), got)
        rows = np.vstack([got[2], got[1], got[0][None], np.concatenate([got[3], np.zeros(k - 1)])[None]])
        units = np.zeros((-(-len(rows) // BLOCK), BLOCK * k), np.int64)
        units.reshape(-1, k)[: len(rows)] = np.rint(rows * _UNIT)
        yield _blocks({i: units[i] for i in np.flatnonzero(units.any(1)).tolist()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u = _units(u, k)
                total[i] = total[i] + u if i in total else u
        if total:
            yield _blocks(total)

    kind = "block int, units binary"
    # a pass leaves its memory to the next one; the stages around the passes give it back
    summed = coded.mapInArrow(run, kind).repartition("block").mapInArrow(lean(add), kind).toArrow()
    sent.unpersist()
    table = np.zeros((-(-(n_sym + k + 2) // BLOCK), BLOCK * k))
    for i, u in zip(summed["block"].to_pylist(), summed["units"].to_pylist(), strict=True):
        table[i] = _units(u, k) / _UNIT
    table = table.reshape(-1, k)
    return [table[n_sym + k], table[n_sym : n_sym + k], table[:n_sym], table[n_sym + k + 1, :1]]


def _blocks(units: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A block goes as 32-bit numbers where all fit, else as 64-bit ones."""
    blobs = [(u.astype(np.int32) if np.abs(u).max() < 2**31 else u).tobytes() for u in units.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(units), pa.int32()), pa.array(blobs, pa.binary())], ["block", "units"])


def _units(blob: bytes, k: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32 if len(blob) == 4 * BLOCK * k else np.int64).astype(np.int64)


def common(counts: DataFrame, model: Model) -> tuple[Lookup, DataFrame]:
    """Counts of the commonest words beyond the head, ``KNOWN`` at most: all from the least count that keeps them so few; and the counts of the rest."""
    below = counts.filter((F.col("key") != END_KEY) & (F.col("c") <= model.least))
    c = below.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(KNOWN + 1).toArrow()
    c, n = c["c"].to_numpy(), c["n"].to_numpy()
    fit = c[np.cumsum(n) <= KNOWN]
    if not len(fit):
        return Lookup(np.zeros(0, np.uint64), np.zeros(0)), below
    sent = F.col("c").between(int(fit[-1]), 2**31 - 1)
    got = below.filter(sent).toArrow()
    return Lookup(got["key"].to_numpy().view(np.uint64), got["c"].to_numpy()), below.filter(~sent)


SCORED = "rid long, doc_key long, mark boolean, word long, whole boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, key: str, text: str, mark: Column, model: Model, counts: DataFrame) -> DataFrame:
    """Per row: key, mark, n_tokens, n_known, base_score, score."""
    known, rest = common(counts, model)
    sent = docs.sparkSession.sparkContext.broadcast((model, known))
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_key"), mark.alias("mark"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _free()
        m, known = sent.value
        held, size = [], 0

        def whole() -> pa.RecordBatch:
            rid, doc, mark, n, met, base, score, sym = (np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*held, strict=True))
            score += m.forward(sym, n)
            return pa.RecordBatch.from_arrays([pa.array(rid), doc, mark, pa.array(rid * 64 % 2**62), pa.array(np.ones(len(n), bool)), pa.array(n), pa.array(met), pa.array(base), pa.array(score)], _NAMES)

        for some in _batched(batches):
            t = pa.Table.from_batches(some)
            rid = t["rid"].to_numpy()
            code, n = tokens(t["text"].combine_chunks(), m.head)
            row, raw = np.repeat(np.arange(len(n)), n), np.flatnonzero(code >= np.uint64(1 << 63))
            c = known.get(code[raw])
            told, raw, c = raw[c >= 0], raw[c < 0], c[c >= 0] + 0.5
            head = np.flatnonzero(code < np.uint64(1 << 63))
            log = np.zeros(len(code))
            log[head], log[told] = m.base[code[head].astype(np.int64)], np.log10(c / m.norm)
            base = np.bincount(row, log, len(n)) + m.base[m.end]
            met = np.bincount(row[head], minlength=len(n)) + np.bincount(row[told], minlength=len(n)) + int(m.end_known)
            share = np.log10(c / m.mass[(code[told] & _U(63)).astype(np.int64)])
            sym = m.symbols(code, n).astype(np.int32)
            held.append((rid, t["doc_key"].combine_chunks(), t["mark"].combine_chunks(), n + 1, met, base, np.bincount(row[told], share, len(n)).astype(float), sym))
            size += sym.nbytes
            if size >= SYMBOLS_AT_ONCE:
                yield whole()
                held, size = [], 0
            tail, at = code[raw].view(np.int64), rid[row[raw]]
            for lo in range(0, len(tail), 200_000):
                w, r = tail[lo : lo + 200_000], at[lo : lo + 200_000]
                null = [pa.nulls(len(w), x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(r), null[0], null[1], pa.array(w), pa.array(np.zeros(len(w), bool)), *null[2:]], _NAMES)
        if held:
            yield whole()

    e = d.mapInArrow(lean(run), SCORED)
    c = F.coalesce("c", F.lit(0)) + 0.5
    mass = F.element_at(F.array(*(F.lit(float(x)) for x in model.mass)), F.col("word").bitwiseAND(F.lit(63)).cast("int") + 1)
    # a whole text's row has a key of its own that stands for no word
    j = e.join(rest.select(F.col("key").alias("word"), "c"), "word", "left")
    tail = ~F.col("whole")
    j = j.select(
        "rid", "doc_key", "mark", "n_tokens",
        F.when(tail, F.col("c").isNotNull().cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(tail, F.log10(c / model.norm)).otherwise(F.col("base")).alias("base"),
        F.when(tail, F.log10(c / mass)).otherwise(F.col("score")).alias("score"),
    )
    g = j.groupBy("rid").agg(F.max("doc_key").alias("key"), F.max("mark").alias("mark"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return g.drop("rid")


_NAMES = [x.split()[0] for x in SCORED.split(", ")]
