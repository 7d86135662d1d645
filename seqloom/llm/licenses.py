"""Licence scan: ordered signature rules behind a keyword prefilter.

A text becomes its words (runs of a-z, 0-9 and non-ASCII bytes after lower-casing A-Z), joined by blanks.
A rule's regex runs only where the rule's gate, a literal, occurs. Of overlapping detections the one of
higher priority, then the longer, then the earlier, is kept, and what lies within a kept interval is
suppressed. Base phrases are plain word sequences and are never suppressed.

One pass over the rows, no exchange. Defined results: a null text is empty; an empty text has no words,
no places, no labels and score 0; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES

#: Phrase -> label of the base scan (fixed by the query's contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((c + 32) if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))

SCHEMA = "key long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first:long,end:long,priority:int>>"


@cache
def compiled() -> list[tuple[bytes, list[tuple[str, int, re.Pattern[bytes]]]]]:
    """Gates, each with the rules it opens, in the rules' order."""
    by: dict[bytes, list] = {}
    for line in RULES.strip().splitlines():
        label, priority, gate, rx = (x.strip() for x in line.split(" ; "))
        by.setdefault(gate.encode(), []).append((label, int(priority), re.compile(b"(?<= )(?:" + rx.encode() + b")(?= )")))
    return list(by.items())


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def places(padded: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase's words stand consecutively; ``padded`` has a blank at both ends."""
    out, at, n, last, look = [], padded.find(b" " + phrase + b" "), 0, 0, b" " + phrase + b" "
    while at >= 0:
        n += padded.count(b" ", last, at)
        last = at
        out.append(n)
        at = padded.find(look, at + 1)
    return out


def suppress(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(first, end, priority, label): by priority, length, place and label; drops what a kept one contains.

    Kept intervals that no other kept one contains have ascending starts and ends, so the last that starts by a
    place reaches furthest.
    """
    kept: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        i = bisect_right(starts, d[0])
        if i and ends[i - 1] >= d[1]:
            continue
        kept.append(d)
        lo = bisect_left(starts, d[0])
        hi = max(lo, bisect_right(ends, d[1]))
        starts[lo:hi], ends[lo:hi] = [d[0]], [d[1]]
    return sorted(kept)


def detect(padded: bytes) -> list[tuple[int, int, int, str]]:
    found, blanks = [], None
    for gate, rules in compiled():
        if gate in padded:
            for label, priority, rx in rules:
                for m in rx.finditer(padded):
                    if blanks is None:
                        blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
                    first = int(np.searchsorted(blanks, m.start())) - 1
                    found.append((first, first + 1 + m.group().count(b" "), priority, label))
    return suppress(found) if found else found


def scan_text(text: bytes | None, base: dict[bytes, str]) -> tuple:
    w = words(text or b"")
    padded = b" " + b" ".join(w) + b" "
    hits: list[int] = []
    own = set()
    for phrase, label in base.items():
        if phrase in padded and (p := places(padded, phrase)):
            hits += p
            own.add(label)
    kept = detect(padded)
    labels = own | {d[3] for d in kept}
    score = max((d[2] / 100 for d in kept), default=0.5 if own else 0.0)
    return len(w), len(hits), min(hits) if hits else None, max(hits) if hits else None, ",".join(sorted(own)), ",".join(sorted(labels)), score, [{"label": x[3], "first": x[0], "end": x[1], "priority": x[2]} for x in kept]


def scan(docs: DataFrame, key: str, text: str, base: dict[str, str] | None = None) -> DataFrame:
    """Per row: key and what :data:`SCHEMA` lists; ``detections`` holds the kept intervals in words."""
    phrases = {k.encode(): v for k, v in (BASE if base is None else base).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))]
        for b in batches:
            rows = [scan_text(t, phrases) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["key", *names])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
