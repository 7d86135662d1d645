"""Spelling variants: words at edit distance one found by a join on single deletions, then chains of forms followed to roots.

1. Words are counted over all texts (counts are summed before they are shuffled, so a common word is no hot key), numbered
   in code-point order and written.
2. Every word emits a key of itself and of each distinct single deletion, as a 64-bit hash: a row of a few numbers for each
   letter, however long the word. Deleting any letter of a run of equal ones gives the same text, so a row holds that run.
3. Words that share a key are candidates. With equal lengths the two runs must overlap (else letters are swapped, not
   replaced); otherwise the lengths differ by one. What is left is verified on the words themselves. A key has at most
   90 words a place (the letters that may have been deleted), so no key is hot.
4. A word's form is its most frequent near word, where that is ``ratio`` times as frequent; forms are followed to the last
   by joins that double the length of the way each round. Counts grow by ``ratio`` each step, so rounds are few.

Odd rows: null and empty texts hold no words; a null id reads as empty; repeated rows count again; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _powers, mix
from .runtime import ascii_lower, discard, lean, written

_B = 0x9E3779B97F4A7C15
_U = np.uint64
LETTERS = r"A-Za-zÀ-ÿ"
KEYS = "k long, id long, n long, size int, lo int, hi int"


def damaged(run: Column, key: Column, every: int) -> Column:
    """A run of letters, lower-cased; where ``every`` divides the crc32 h of ``key:run``, without its letter h modulo its length."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, key: str, text: str, least: int, times: int, every: int) -> DataFrame:
    """(word, n) of the words of at least ``least`` letters that occur ``times`` times or more."""
    runs = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(f"[{LETTERS}]{{{least},}}"), 0)  # a run of fewer letters can't become a word
    d = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run"))
    w = d.select(damaged(F.col("run"), F.col("key"), every).alias("word")).filter(F.length("word") >= least)
    return w.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def deletions(words: DataFrame) -> DataFrame:
    """Keys of each word (word, n, id): its own hash (lo = -1) and that of each distinct single deletion (lo to hi: the run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            size = np.fromiter(map(len, w), np.int64, len(w))
            code = np.frombuffer("".join(w).encode("utf-32-le"), np.uint32).astype(_U) + _U(1)
            end = np.cumsum(size)
            start = end - size
            row = np.repeat(np.arange(len(w)), size)
            place = np.arange(len(code)) - start[row]
            longest = int(size.max(initial=0)) + 1
            up = _powers(_B, longest)
            term = code * up[place]
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(term, dtype=_U)])
            whole = sums[end] - sums[start]
            first = np.ones(len(code), bool)  # of each run of equal letters
            first[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            last = np.append(at[1:], len(code)) - 1
            r = row[at]
            before = sums[at] - sums[start[r]]
            behind = (sums[end[r]] - sums[at + 1]) * _U(pow(_B, -1, 2**64))
            k = np.concatenate([mix(whole + size.astype(_U)), mix(before + behind + (size[r] - 1).astype(_U))]).view(np.int64)
            rows = np.concatenate([np.arange(len(w)), r])
            lo = np.concatenate([np.full(len(w), -1), place[at]])
            hi = np.concatenate([np.full(len(w), -1), place[last]])
            n, ids = b.column(1).to_numpy(), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids[rows]), pa.array(n[rows]), pa.array(size[rows].astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["k", "id", "n", "size", "lo", "hi"])

    return words.select("word", "n", "id").mapInArrow(lean(run), KEYS)


def near(words: DataFrame) -> DataFrame:
    """(id, n, other, other_n): both directions of all pairs of words (word, n, id) at distance exactly one."""
    k = deletions(words)
    a = k.select(*(F.col(c).alias(f"a_{c}") if c != "k" else F.col(c) for c in k.columns))
    b = k.select(*(F.col(c).alias(f"b_{c}") if c != "k" else F.col(c) for c in k.columns))
    replaced = (F.col("a_size") == F.col("b_size")) & (F.col("a_lo") >= 0) & (F.col("b_lo") >= 0) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    longer = (F.col("b_size") == F.col("a_size") + 1) & (F.col("a_lo") < 0) & (F.col("b_lo") >= 0) | (F.col("a_size") == F.col("b_size") + 1) & (F.col("b_lo") < 0) & (F.col("a_lo") >= 0)
    c = a.join(b, "k").filter((F.col("a_id") < F.col("b_id")) & (replaced | longer)).select("a_id", "a_n", "b_id", "b_n")
    c = c.join(words.select(F.col("id").alias("a_id"), F.col("word").alias("a_word")), "a_id").join(words.select(F.col("id").alias("b_id"), F.col("word").alias("b_word")), "b_id")
    c = c.filter(F.levenshtein("a_word", "b_word", 1) == 1)
    both = F.array(*(F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_id").alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")))
    return c.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of pointers (id, form): the end of each chain, by doubling."""
    r = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = r.select(F.col("id").alias("at"), F.col("root").alias("next"))
        step = r.join(on, r["root"] == on["at"], "left")
        new = written(step.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(r)
        moved = new.filter("moved").limit(1).count()
        folder, r = new._seqloom_folder, new.drop("moved")
        r._seqloom_folder = folder
        if not moved:
            return r


def group(docs: DataFrame, key: str, text: str, least: int = 7, times: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word; ``form`` and ``form_n`` are null where no near word is ``ratio`` times as frequent."""
    counted = written(count_words(docs, key, text, least, times, every), "words")
    words = written(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")  # ids in code-point order
    discard(counted)
    best = F.max(F.struct(F.col("other_n"), (-F.col("other")).alias("minus")))
    g = near(words).groupBy("id").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("b"))
    fit = F.col("b.other_n") >= F.col("n") * ratio
    near_of = written(g.select("id", "n_near", F.when(fit, -F.col("b.minus")).alias("form"), F.when(fit, F.col("b.other_n")).alias("form_n")), "near")
    forms = near_of.filter("form IS NOT NULL")
    ends = roots(forms.select("id", "form"))
    name = lambda c: words.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    told = ends.withColumnRenamed("root", "root_id").join(name("root"), "root_id").join(forms.select("id", F.col("form").alias("form_id")), "id").join(name("form"), "form_id").select("id", "form", "root")
    out = words.join(near_of.select("id", "n_near", "form_n"), "id", "left").join(told, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
