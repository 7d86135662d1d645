import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import hmm, quality, queries, wfst
from seqloom.llm.runtime import fold

HELD = lambda i, n, k: zlib.crc32(str(i).encode()) % n == k


# --- hidden Markov model
def toy():
    m = hmm.Model(np.array([10, 20]), np.array([5.0, 3.0]), 4, np.full(hmm.CLASSES, 0.5), 12, 3, states=2)
    m.a, m.pi = np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([0.6, 0.4])
    return m


def all_paths(m, sym):
    """Likelihood by the sum over every state sequence."""
    import itertools

    total = 0.0
    for p in itertools.product(range(2), repeat=len(sym)):
        x = m.pi[p[0]] * m.b[sym[0], p[0]]
        for t in range(1, len(sym)):
            x *= m.a[p[t - 1], p[t]] * m.b[sym[t], p[t]]
        total += x
    return math.log10(total)


def test_forward_is_the_sum_over_paths():
    m = toy()
    texts = [[0, 1, 2], [2], [1, 1, 5, 0, 2], [3, 2]]
    got = m.forward(np.array(sum(texts, [])), np.array(list(map(len, texts))))
    assert got == pytest.approx([all_paths(m, t) for t in texts])


def posteriors(m, sym):
    """Expected counts of one text by the sum over every state sequence."""
    import itertools

    got = m.empty()
    weight = {}
    for p in itertools.product(range(2), repeat=len(sym)):
        x = m.pi[p[0]] * m.b[sym[0], p[0]]
        for t in range(1, len(sym)):
            x *= m.a[p[t - 1], p[t]] * m.b[sym[t], p[t]]
        weight[p] = x
    total = sum(weight.values())
    for p, x in weight.items():
        got[0][p[0]] += x / total
        for t, (s, q) in enumerate(zip(sym, p, strict=True)):
            got[2][s, q] += x / total
            if t:
                got[1][p[t - 1], q] += x / total
    return got


def test_border_matrices_work_on_the_pieces_that_still_run(monkeypatch):
    """Pieces are at work as a prefix, the longest first: each token's matrix is made once, and borders equal a plain forward and backward."""
    m = hmm.Model(np.array([10, 20]), np.array([5.0, 3.0]), 4, np.full(hmm.CLASSES, 0.5), 12, 3, states=3)
    rng = np.random.default_rng(4)
    n = np.array([23, 9, 17])
    sym = rng.integers(0, len(m.b), n.sum())
    monkeypatch.setattr(hmm, "PIECE", 8)
    size = np.array([8, 8, 7, 8, 1, 8, 8, 1])
    first, p = np.array([0, 8, 16, 23, 31, 32, 40, 48]), np.array([0, 1, 2, 0, 1, 0, 1, 2])
    met = []

    class Table(np.ndarray):
        def __getitem__(self, at):
            met.append(np.size(at))
            return np.asarray(self)[at]

    m.b = m.b.view(Table)
    before, behind = m._borders(sym, first, size, p)
    assert sum(met) == n.sum() and len(met) == 8
    b = np.asarray(m.b)
    for i in range(len(p)):
        lo = first[i] - 8 * p[i]
        hi = lo + n[np.searchsorted(np.cumsum(n), lo, side="right")]
        if p[i]:
            v = m.pi * b[sym[lo]]
            for x in sym[lo + 1 : first[i]]:
                v = v @ m.a * b[x]
            assert np.allclose(before[i], v / v.sum(), rtol=1e-12)
        w = np.ones(3)
        for x in sym[first[i] + size[i] : hi][::-1]:
            w = m.a @ (b[x] * w)
        assert np.allclose(behind[i] / behind[i].max(), w / w.max(), rtol=1e-12)


def test_borders_come_from_windows_where_these_forget(monkeypatch):
    """A window does once all beyond it can't matter; texts of a model that doesn't forget go through their pieces' matrices. Both are exact."""
    m = hmm.Model(np.array([10, 20]), np.array([5.0, 3.0]), 4, np.full(hmm.CLASSES, 0.5), 12, 3, states=3)
    n = np.array([700, 300, 513])
    sym = np.random.default_rng(4).integers(0, len(m.b), n.sum())
    monkeypatch.setattr(hmm, "PIECE", 256)
    p = np.array([0, 1, 2, 0, 1, 0, 1, 2])
    first = np.array([0, 256, 512, 700, 956, 1000, 1256, 1512])
    size = np.diff(np.append(first, n.sum()))
    called, borders = [], hmm.Model._borders
    monkeypatch.setattr(hmm.Model, "_borders", lambda self, s, f, *a: (called.append(f.tolist()), borders(self, s, f, *a))[1])
    for sticky, matrices in ((0.5, []), (1 - 1e-6, [first[[*range(3), 3, 4]].tolist()])):
        m.a = np.full((3, 3), (1 - sticky) / 2) + (1.5 * sticky - 0.5) * np.eye(3)
        if matrices:
            m.b = np.full_like(m.b, 1 / len(m.b)) * [1, 1 + 1e-6, 1 - 1e-6]  # hardly tells states apart
            monkeypatch.setattr(hmm, "WINDOW", 64)
        called.clear()
        got = m._messages(sym, first, size, p)
        assert len(called) == bool(matrices)
        want = borders(m, sym, first, size, p)
        assert np.allclose(got[0], want[0], rtol=1e-11, atol=0)
        assert np.allclose(got[1] / got[1].max(1, keepdims=True), want[1] / want[1].max(1, keepdims=True), rtol=1e-11, atol=0)


def test_passes_leave_their_room_to_the_next():
    m = toy()
    hmm._free()
    m.expected(np.array([0, 1, 2, 0]), np.array([3, 1]), m.empty())
    was = list(map(id, hmm._ROOM))
    m.expected(np.array([0, 2]), np.array([2]), m.empty())
    assert len(was) == 2 and list(map(id, hmm._ROOM)) == was
    hmm._free()
    assert not hmm._ROOM


def test_blocks_are_as_wide_as_their_numbers():
    small, large = np.arange(hmm.BLOCK * 8), np.arange(hmm.BLOCK * 8) - 2**40
    got = hmm._blocks({3: small, 5: large}).to_pydict()["units"]
    assert list(map(len, got)) == [4 * len(small), 8 * len(large)]
    assert (hmm._units(got[0], 8) == small).all() and (hmm._units(got[1], 8) == large).all()


@pytest.mark.parametrize("known, at_once", [(0, 24_000_000), (40, 2_000)])
def test_counts_that_are_sent_equal_those_that_are_joined(spark, sf, monkeypatch, known, at_once):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(200).localCheckpoint()
    monkeypatch.setattr(hmm, "HEAD", 100)
    monkeypatch.setattr(hmm, "LEAST_PASSES", 1)
    monkeypatch.setattr(hmm, "TOLERANCE", 1e9)
    model, counts = hmm.train(d, "text", F.lit(True))
    every, rest = hmm.common(counts, model)
    want = hmm.score(d, "doc_id", "text", F.lit(False), model, counts).orderBy("key").collect()
    monkeypatch.setattr(hmm, "KNOWN", known)
    monkeypatch.setattr(hmm, "SYMBOLS_AT_ONCE", at_once)
    few, more = hmm.common(counts, model)
    assert rest.count() < more.count() and (few.values >= 0).sum() <= known < (every.values >= 0).sum()
    got = hmm.score(d, "doc_id", "text", F.lit(False), model, counts).orderBy("key").collect()
    assert len(got) == 200 and [r[:4] for r in got] == [r[:4] for r in want] and all(r.n_known == r.n_tokens for r in got)
    for a, b in zip(got, want, strict=True):
        assert (a.base_score, a.score) == pytest.approx((b.base_score, b.score), rel=1e-12)


def test_expected_counts_are_sums_over_paths():
    m = toy()
    texts = [[0, 1, 2, 1, 0, 2], [2], [1, 1, 0]]
    got = m.empty()
    m.expected(np.array(sum(texts, [])), np.array(list(map(len, texts))), got)
    want = [sum(x) for x in zip(*(posteriors(m, t)[:3] for t in texts), strict=True)]
    assert all(a == pytest.approx(b) for a, b in zip(got[:3], want, strict=True))


@pytest.mark.parametrize("piece, at_once", [(16, 500_000), (1, 50), (33, 64)])
def test_pieces_count_as_whole_texts(monkeypatch, piece, at_once):
    """Every token and transition once; pieces whose borders carry the whole text's messages count as the text does."""
    m = toy()
    r = np.random.default_rng(1)
    n = np.array([3, 400, 64, 1, 129, 33])
    sym = r.integers(0, 3, n.sum())
    whole, cut = m.empty(), m.empty()
    m.expected(sym, n, whole)
    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", at_once)
    m.expected(sym, n, cut)
    assert cut[2].sum() == pytest.approx(n.sum()) and cut[1].sum() == pytest.approx((n - 1).sum()) and cut[0].sum() == pytest.approx(len(n))
    assert all(a == pytest.approx(b, rel=1e-9, abs=1e-9) for a, b in zip(cut, whole, strict=True))
    assert whole[3][0] / np.log(10) == pytest.approx(m.forward(sym, n).sum())


def test_a_pass_scales_now_and_then_and_in_room_that_its_parts_share(monkeypatch):
    """Of n tokens every eighth is scaled, and each text's end; parts of a batch use the same memory; ever smaller probabilities stay exact."""
    m = toy()
    m.b = np.full_like(m.b, 1e-30) * [1.0, 0.5]
    n, logged, rooms = np.array([40, 8, 7, 1, 300, 33]), [], []
    sym = np.random.default_rng(1).integers(0, 3, n.sum())
    log, count = np.log, hmm.Model._count
    monkeypatch.setattr(hmm.np, "log", lambda x: (logged.append(np.size(x)), log(x))[1])
    monkeypatch.setattr(hmm.Model, "_count", lambda *a: (rooms.append([id(r) for r in a[8]]), count(*a))[1])
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", 50)
    got = m.empty()
    m.expected(sym, n, got)
    assert sum(logged) <= n.sum() // 8 + len(n)
    assert len(rooms) > 1 and all(r == rooms[0] for r in rooms)
    logged.clear()
    each = m.forward(sym, n)
    assert sum(logged) <= n.sum() // 8 + len(n) + 1
    monkeypatch.undo()
    assert got[3][0] / np.log(10) == pytest.approx(each.sum())
    for i, size in enumerate(n):
        v, want = m.pi * 1, 0.0
        for t in range(size):
            v = (v @ m.a if t else v) * [1.0, 0.5]
            want += math.log10(v.sum()) - 30
            v /= v.sum()
        assert each[i] == pytest.approx(want)
    assert got[2].sum() == pytest.approx(n.sum()) and got[1].sum() == pytest.approx((n - 1).sum())


def test_a_pass_sends_few_rows_and_sums_all_partitions(spark, monkeypatch):
    m = toy()
    r = np.random.default_rng(1)
    texts = [r.integers(0, 3, n).astype(np.int32) for n in (3, 40, 1, 9, 200, 64)]
    coded = spark.createDataFrame([(len(t), t.tobytes()) for t in texts], "n int, s binary").repartition(3).localCheckpoint()
    sent, add = [], type(coded).mapInArrow
    monkeypatch.setattr(type(coded), "mapInArrow", lambda d, *a: (sent.append(add(d, *a)), sent[-1])[1])
    got, want = hmm._pass(coded, m), m.empty()
    monkeypatch.undo()
    m.expected(np.concatenate(texts), np.array(list(map(len, texts))), want)
    assert sum(x.sum() for x in want[:3]) > 600 and all(a == pytest.approx(b, abs=1e-3) for a, b in zip(got, want, strict=True))
    assert len(sent) == 2 and sent[0].count() <= 3  # of 71 rows of tables, by partition


def test_training_goes_on_until_it_settles(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    held = fold("doc_id", 5) == 1
    model, _ = hmm.train(d, "text", ~held)
    assert hmm.LEAST_PASSES <= model.passes <= hmm.MOST_PASSES

    def symbols(keep):
        code, n = hmm.tokens(d.filter(keep).select(F.coalesce("text", F.lit("")).alias("t")).toArrow()["t"].combine_chunks(), model.head)
        return model.symbols(code, n), n + 1

    learn, test = symbols(~held), symbols(held)
    was = model.forward(*test).sum()
    got = model.empty()
    model.expected(*learn, got)
    model.update(got)
    assert abs(model.forward(*test).sum() - was) / test[1].sum() < hmm.TOLERANCE


def test_passes_raise_the_likelihood():
    m = toy()
    r = np.random.default_rng(1)
    n = np.array([3, 200, 64, 1, 65])
    sym = r.integers(0, 3, n.sum())
    last = -np.inf
    for _ in range(4):
        ll = m.forward(sym, n).sum()
        assert ll >= last - 0.5  # the prior may cost a little
        last, got = ll, m.empty()
        m.expected(sym, n, got)
        m.update(got)


def test_hmm_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c = Counter()
    for i, t in docs.items():
        if not HELD(i, 5, 1):
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    got = queries.op2_hmm_lm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        w = [*(docs[r.doc_id] or "").encode().lower().split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (HELD(r.doc_id, 5, 1), len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than the unigram on held-out texts


def test_hmm_on_odd_rows(spark, odd_docs, no_docs):
    d = odd_docs.withColumnRenamed("lang", "word").withColumn("score", F.lit(1))
    model, counts = hmm.train(d, "text", F.lit(True))
    rows = hmm.score(d, "doc_id", "text", fold("doc_id", 5) == 1, model, counts).collect()
    assert len(rows) == 12 and all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in rows) and sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1]
    model, counts = hmm.train(no_docs, "text", F.lit(True))
    assert model.total == 0 and [r.n_known for r in hmm.score(d.limit(1), "doc_id", "text", F.lit(False), model, counts).collect()] == [0]
    assert hmm.score(no_docs, "doc_id", "text", F.lit(False), model, counts).count() == 0


# --- quality
def test_ratio_model_on_held_out_rows(spark, sf01):
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    rows = queries.op3_nb_svm(spark, sf01).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == HELD(r.doc_id, 5, 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in lab]
    assert sum(r.predicted == lab[r.doc_id] for r in held) / len(held) > 0.95


def test_shapes_of_buffers():
    import random

    from seqloom.llm import bytewords

    r = random.Random(6)
    texts = ["".join(r.choice("aZq7é½中.,!?|_*# \n\tAB") for _ in range(r.randrange(60))) for _ in range(400)] + [None, "", "A", "x" * 40, "é"]
    data, cuts = bytewords.buffer_of(pa.array(texts))
    start, end, h = bytewords.words(data, cuts, True)
    words = [w for t in texts for w in (t or "").encode().split()]
    assert quality.shapes(data, start, end).tolist() == [quality.shape(w) for w in words]
    assert len(set(h.tolist())) == len(set(words))


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 4)), np.where(r.random(60) < 0.5, 1.0, -1.0)
    w, b = quality.dual_coordinate_descent([(np.arange(4), v) for v in x], y, 4, c=0.5, epochs=3000)
    f = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = f(w, b)
    assert all(best <= f(w + 1e-2 * d[:4], b + 1e-2 * d[4]) + 1e-6 for d in r.normal(size=(200, 5)))


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    s = quality.score(odd_docs, "doc_id", "text", None, "lang").collect()
    assert len(s) == 12 and all(r.quality_score == 0.5 for r in s)
    lab = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1), (8, 7)], "doc_id long, quality int")
    m = quality.train(odd_docs, "doc_id", "text", lab, "doc_id", "quality")
    assert m is not None and all(0 <= r.quality_score <= 1 for r in quality.score(odd_docs, "doc_id", "text", m).collect())
    assert quality.train(odd_docs, "doc_id", "text", lab.filter("quality = 1"), "doc_id", "quality") is None
    assert quality.train(no_docs, "doc_id", "text", lab.limit(0), "doc_id", "quality") is None and quality.score(no_docs, "doc_id", "text", m).count() == 0


def test_copies_of_one_class_leave_the_other_in_the_fit(spark):
    """A key of class 0 that occurs 10,000 times, beside 4,000 keys of class 0 and 30 of class 1."""
    rows = [(i, f"good words number {i}" if i < 30 else f"Bad!! text {i} ***") for i in range(4030)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 30)) for i, _ in rows], "doc_id long, quality int")
    hot = lab.filter("quality = 0").orderBy(F.xxhash64(F.lit(quality.SEED), "doc_id")).first().doc_id
    copies = spark.range(10_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("Bad!! copy ***"), F.lit(" |"), F.col("id") % 7).alias("text"))
    m = quality.train(docs.unionByName(copies), "doc_id", "text", lab, "doc_id", "quality")
    assert m is not None
    got = {r.doc_id: r.quality_score for r in quality.score(docs, "doc_id", "text", m).collect()}
    assert min(got[i] for i in range(30)) > max(got[i] for i in range(30, 4030))


# --- SentencePiece
@pytest.fixture(scope="module")
def piece():
    sentencepiece = pytest.importorskip("sentencepiece")
    return wfst.Machine(queries.read_model()), sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_PATH)


def test_same_ids_as_the_library(spark, sf, piece):
    m, lib = piece
    import random

    r = random.Random(4)
    letters = list("ab the ing  \t\r\n(){};'\"=+-*/.,:0123ABCéüñ中文😀▁\x00\x01_#<>")
    texts = [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    for t in texts:
        ids = m.encode(t)
        assert ids.tolist() == lib.encode(t) and m.decode(ids) == lib.decode(ids.tolist())


def test_unigram_path_is_the_least(piece):
    import itertools

    def field(n, kind, v):
        return bytes([n << 3 | kind]) + (bytes([len(v)]) + v if kind == 2 else v)

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("ba", -0.5, 1), ("▁a", -1.5, 1)]
    proto = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    m = wfst.Machine(proto + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00")))
    cost = {p: -s for p, s, _ in pieces[1:]}
    for t in map("".join, itertools.product("ab", repeat=5)):
        s = m.normalise(t)
        best = min(sum(cost[x] for x in seg) for seg in segmentations(s, cost))
        assert sum(cost[m.pieces[i]] for i in m.encode(t)) == pytest.approx(best)
    assert m.encode("c").tolist() == [1, 0]


def segmentations(s, pieces):
    if not s:
        return [[]]
    return [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in pieces for rest in segmentations(s[k:], pieces)]


def test_encode_odd_rows(spark, odd_docs, no_docs):
    rows = wfst.encode(odd_docs.withColumn("ids", F.lit(1)), "doc_id", "text", queries.read_model()).collect()
    assert len(rows) == 12 and all(r.n_tokens == len(r.ids) for r in rows) and sum(r.n_tokens == 0 for r in rows) == 3
    assert [r.key for r in rows if not r.round_trip] == [7]  # its meta symbol reads as a blank
    assert {r.decoded for r in wfst.encode(odd_docs.filter("doc_id = 6"), "doc_id", "text", queries.read_model(), decoded=True).collect()} == {"alpha beta gamma delta epsilon zeta eta"}
    assert wfst.encode(no_docs, "doc_id", "text", queries.read_model()).count() == 0


def proto(pieces, kind, **spec):
    """A model file of (piece, score, kind) rows."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(n, v):
        return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3 | 2) + varint(len(v)) + v

    body = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    normal = field(1, b"own") + field(2, spec.get("map", b"")) + field(3, int(spec.get("dummy", True))) + field(4, int(spec.get("squeeze", True))) + field(5, 1)
    return body + field(2, field(3, kind) + field(4, len(pieces))) + field(3, normal)


def character_map():
    """The map of the library's own rule, out of the file that it writes."""
    sp = pytest.importorskip("sentencepiece")
    spec = dict(wfst._fields(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    return dict(wfst._fields(spec))[2]


def odd_texts(n, seed):
    import random

    r = random.Random(seed)
    letters = "abbaab  ab ＡＢｃ①ﬁ\t　ｶﾞé́½…中<x><xy>q"
    return ["", " ", "a", "<x>", "<xy> ab"] + ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("kind", [wfst.UNIGRAM, wfst.BPE])
@pytest.mark.parametrize("mapped", [False, True])
def test_models_of_each_kind_as_the_library(kind, mapped):
    """Own vocabularies: user-defined pieces, unknown characters, and the compiled character map."""
    sp = pytest.importorskip("sentencepiece")
    words = ["▁", "a", "b", "c", "A", "B", "ab", "ba", "▁a", "▁ab", "abb", "bab", "▁b", "f", "i", "fi"]
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("<x>", 0, 4), ("<xy>", 0, 4)] + [(w, -(i * 0.6180339887 % 1) * 7 - 1 if kind == wfst.UNIGRAM else -float(i), 1) for i, w in enumerate(words)]
    model = proto(pieces, kind, map=character_map() if mapped else b"")
    m, lib = wfst.Machine(model), sp.SentencePieceProcessor(model_proto=model)

    def merged(ids):  # the library writes neighbouring unknown characters as one
        return [x for i, x in enumerate(ids) if x or not i or ids[i - 1]]

    for t in odd_texts(3000, 5):
        assert merged(m.encode(t).tolist()) == merged(lib.encode(t)), t


def test_texts_together_as_alone(piece):
    m, _ = piece
    texts = odd_texts(200, 8) + [None]
    assert [x.tolist() for x in m.encode_all(texts)] == [m.encode(t).tolist() for t in texts]


def test_score_takes_a_free_name(spark):
    from seqloom.llm.runtime import fresh

    d = spark.createDataFrame([(1, "x", 9)], "doc_id long, text string, QUALITY_SCORE int")
    name = fresh(d.columns, "quality_score")[0]
    r = quality.score(d, "doc_id", "text", None, "QUALITY_SCORE", name=name).first()
    assert r["QUALITY_SCORE"] == 9 and r[name] == 0.5


def test_runs_are_searched_in_little_memory():
    """Arcs are held as narrow numbers at their places, not sorted: under 190 bytes a character where pieces are dense."""
    import tracemalloc

    m = wfst.Machine(queries.read_model())
    r = np.random.default_rng(5)
    common = sorted((p for p in m.ids if p.isascii() and p.isalpha()), key=lambda p: m.ids[p])[:3000]
    runs = ["▁" + "".join(common[i] for i in r.integers(0, len(common), 2)) for _ in range(9000)]
    runs = list(dict.fromkeys(runs))
    want = m._side_by_side(runs)  # neighbours are weighed
    tracemalloc.start()
    got = m._side_by_side(runs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and got[:300] == [np.array(m.path(x), np.int32).tobytes() for x in runs[:300]]
    assert peak < 190 * sum(map(len, runs))
