"""Words of a binary Arrow column, found and hashed over its whole buffer at once.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Its hash is a polynomial over random codes of its bytes modulo
2**64, taken from prefix sums, so the cost follows the bytes and no word becomes an object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(4)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CASED = _CODE.copy()
_CODE[0x41:0x5B] = _CODE[0x61:0x7B]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _U(pow(base, k, 2**64))
        k += m
    return out


_POW = _powers(_BASE, _STEP + 1)
_INV = _powers(pow(_BASE, -1, 2**64), _STEP + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array and the offsets of its rows; nulls are empty."""
    col = col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def counts(col: pa.Array) -> np.ndarray:
    """Number of words of each row; null: 0."""
    data, offsets = buffer_of(col)
    ink = np.concatenate([[False], ~_BLANK[data]])
    begins = ink[1:] & ~ink[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = ink[inner + 1]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def words(data: np.ndarray, cuts: np.ndarray, cased: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word; words also end at ``cuts`` (row starts and ends). A-Z hash as a-z unless ``cased``."""
    code = _CASED if cased else _CODE
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(_U)
    ink = np.empty(n + 2, bool)
    ink[0] = ink[-1] = False
    np.logical_not(_BLANK[data], out=ink[1:-1])
    begins = ink[1:-1] & ~ink[:-2]
    ends = ink[1:-1] & ~ink[2:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begins[inner] |= ink[inner + 1]
    ends[inner - 1] |= ink[inner]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(s), _U)
    at = 0
    while at < len(s):
        lo = int(s[at])
        to = max(at + 1, int(np.searchsorted(e, lo + _STEP, side="right")))
        hi = int(e[to - 1])
        if hi - lo <= _STEP:
            total = np.zeros(hi - lo + 1, _U)
            np.cumsum(code[data[lo:hi]] * _POW[: hi - lo], out=total[1:])
            h[at:to] = (total[e[at:to] - lo] - total[s[at:to] - lo]) * _INV[s[at:to] - lo]
        else:  # one word longer than a step
            v = np.zeros(1, _U)
            for p in range(lo, hi, _STEP):
                c = code[data[p : min(hi, p + _STEP)]]
                v = mix(v + (c * _POW[: len(c)]).sum(dtype=_U))
            h[at] = v[0]
        at = to
    return s, e, mix(h)


class Lookup:
    """64-bit keys to numbers, for many look-ups at once: open addressing, at most a quarter full. Key 0 is not for use."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, _U), np.full(1 << bits, -2, np.int32)
        h, v = keys, np.asarray(values, np.int32)
        i = self._slot(h)
        while len(h):
            first = np.zeros(len(h), bool)
            first[np.unique(i, return_index=True)[1]] = True
            first &= self.keys[i] == 0
            self.keys[i[first]], self.values[i[first]] = h[first], v[first]
            h, v, i = h[~first], v[~first], (i[~first] + 1) & self.mask

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The numbers; -2 for keys that are not there."""
        i = self._slot(h)
        k = self.keys[i]
        out = np.where(k == h, self.values[i], np.int32(-2))
        on = np.flatnonzero((k != h) & (k != 0))
        while len(on):
            i[on] = (i[on] + 1) & self.mask
            k = self.keys[i[on]]
            hit = k == h[on]
            out[on[hit]] = self.values[i[on[hit]]]
            on = on[~hit & (k != 0)]
        return out
