"""The classifier and the pipeline's stages against plain versions, over all documents of the small table."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import bytewords, mixing, quality, queries

from .test_dedup import brute_groups, brute_lines

M64 = 2**64 - 1


def mixed_bits(x):
    x &= M64
    x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & M64
    return x ^ (x >> 29)


def plain_features(text):
    """Buckets of a text, n-gram by n-gram."""
    words = (text or "").encode().split()
    h = [int(bytewords.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), True)[2][0]) >> 8 for w in words]
    s = [quality.shape(w) * 2 + (i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
    out = set()
    for i in range(len(words)):
        out |= {mixed_bits(h[i]), mixed_bits(s[i] + 0x165667B19E3779F9)}
        if i + 1 < len(words):
            out |= {mixed_bits(h[i] * 0xC2B2AE3D27D4EB4F + h[i + 1]), mixed_bits((s[i] << 9 | s[i + 1]) + 0xC2B2AE3D27D4EB4F)}
        if i + 2 < len(words):
            out.add(mixed_bits((s[i] << 18 | s[i + 1] << 9 | s[i + 2]) + 0x9E3779B97F4A7C15))
    return sorted({x >> (64 - quality.BITS) for x in out})


def plain_scores(docs, labels):
    """Ratios, dual coordinate descent and the curve over all labelled training rows (fewer than the bound of the fit)."""
    fit = [(i, t, labels[i]) for i, t in docs.items() if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    n = [Counter(), Counter()]
    rows = [0, 0]
    for _, t, y in fit:
        n[y].update(plain_features(t))
        rows[y] += 1
    dim = 1 << quality.BITS
    total = [sum(c.values()) + dim for c in n]
    ratio = {b: math.log((n[1][b] + 1) / total[1]) - math.log((n[0][b] + 1) / total[0]) for b in n[0] | n[1]}

    def scaled(t):
        f = [(b, ratio[b]) for b in plain_features(t) if b in ratio]
        norm = math.sqrt(sum(r * r for _, r in f))
        return [(b, r / max(norm, 1e-12)) for b, r in f]

    return fit, rows, scaled


def test_classifier_against_a_plain_version(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    fit, rows, scaled = plain_scores(docs, labels)
    model = queries.quality_model(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    x = [scaled(t) for _, t, _ in fit]
    y = np.array([1.0 if k else -1.0 for _, _, k in fit])
    # the fitted weights are interpolated towards their mean; undone, they are the optimum of the hinge loss over the plain features
    w, b = model.weight, model.bias
    margin = np.array([sum(w[c] * v for c, v in f) + b for f in x])
    got = {r.doc_id: r.score for r in queries.op3_nb_svm(spark, sf).collect()}
    for (i, _, _), m in zip(fit, margin, strict=True):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.a * m + model.b))), rel=1e-9)
    for i, t in docs.items():
        m = sum(w[c] * v for c, v in scaled(t)) + b
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.a * m + model.b))), rel=1e-9)
    # the plain descent over the same rows separates them as the model does
    order = np.argsort([i for i, _, _ in fit], kind="stable")
    pw, pb = quality.dual_coordinate_descent([(np.array([c for c, _ in x[k]], int), np.array([v for _, v in x[k]])) for k in order], y[order], 1 << quality.BITS)
    pw = (1 - quality.BETA) * np.abs(pw).sum() / max(1, (pw != 0).sum()) + quality.BETA * pw
    plain = np.array([sum(pw[c] * v for c, v in f) + pb for f in x])
    assert np.corrcoef(plain, margin)[0, 1] > 0.99 and rows == [int((y < 0).sum()), int((y > 0).sum())]


def test_stages_against_plain_versions(spark, sf):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.MODEL_PATH)
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    score = {r.doc_id: r.score for r in queries.op3_nb_svm(spark, sf).collect()}

    good = stages["quality"](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, s in score.items() if s >= corpus_pipeline.GOOD)

    rows = {r.doc_id: r.text for r in good.collect()}
    out, _ = brute_lines(list(rows.items()))
    want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in out[i, t or ""]) for i, t in rows.items()}
    lines = stages["line_dedup"](spark, good, sf).cache()
    assert {r.doc_id: r.text or "" for r in lines.collect()} == want and all(r.n_chars == len(r.text or "") for r in lines.collect())

    ids = sorted(want)
    group = brute_groups([want[i] for i in ids])
    near = stages["near_dedup"](spark, lines, sf).cache()
    assert sorted(r.doc_id for r in near.collect()) == sorted({ids[g] for g in group})

    kept = {r.doc_id: r for r in near.collect()}
    size = {i: len((r.text or "").encode().split()) for i, r in kept.items()}
    by = defaultdict(int)
    for i, r in kept.items():
        by[r.source] += size[i]
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    goal = dict(zip(order, mixing.targets([by[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))]), strict=True))
    mix = stages["mix"](spark, near, sf).cache()
    took = defaultdict(int)
    for r in mix.collect():
        words, whole = (r.text or "").split(), iter((kept[r.doc_id].text or "").split())
        assert all(w in whole for w in words)  # in the order of the text
        took[r.source] += len((r.text or "").encode().split())
    assert all(abs(took[s] - goal[s]) <= 1 for s in order)

    texts = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in mix.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in stages["sentencepiece"](spark, mix, sf).collect()) == texts
