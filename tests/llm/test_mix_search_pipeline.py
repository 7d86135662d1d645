import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import ann, mixing, queries


def highest_quotients(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))):
        i = max((i for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_apportionment_is_the_highest_quotient_rule():
    r = random.Random(1)
    assert mixing.apportion([53.0, 24.0, 23.0], 7, [9, 9, 9]) == [3, 2, 2]
    for _ in range(200):
        v = [r.choice([0.0, 1.0, r.random() * 100]) for _ in range(r.randrange(1, 9))]
        c = [r.randrange(0, 30) for _ in v]
        n = r.randrange(0, 60)
        assert mixing.apportion(v, n, c) == highest_quotients(v, n, c)


def test_targets():
    assert mixing.targets([100, 100], [3, 1]) == [200.0, 100.0]
    assert mixing.targets([10, 1000, 0], [3, 1, 2]) == pytest.approx([20, 1495, 0])
    assert mixing.targets([], []) == []


def test_mix_query(spark, sf01):
    rows = queries.op5_mix_sainte_lague(spark, sf01).collect()
    again = queries.op5_mix_sainte_lague(spark, sf01).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source, r.source_size, r.target), []).append(r)
    assert sum(t for _, _, t in by) == pytest.approx(1.5 * sum(r.size for r in rows))
    for (_, n, t), own in by.items():
        assert n == sum(r.size for r in own) and abs(sum(r.taken for r in own) - t) <= 1 and t <= 2 * n


def test_mix_odd_rows(spark, odd_docs, no_docs):
    d = odd_docs.withColumn("size", mixing.token_count(F.col("text"))).withColumn("shard", F.lit(1))
    rows = mixing.mix(d, "doc_id", "size", "source").collect()
    assert len(rows) == 12 and all(r.spans == [] for r in rows if not r.size)
    assert mixing.mix(no_docs.withColumn("size", F.lit(1)), "doc_id", "size", "source").count() == 0
    out = mixing.mixed(odd_docs, "doc_id", "text", "source", "n_chars")
    assert out.columns == odd_docs.columns and all(r.text and r.n_chars == len(r.text) for r in out.collect())


def test_cut_keeps_whole_texts():
    s = lambda a, b, t: {"first": a, "end": b, "times": t}
    assert mixing.cut("a  b c\n", [s(0, 2, 2), s(2, 3, 1)], 3) == ["a  b c\n", "a  b"]
    assert mixing.cut("a b c", [s(0, 1, 1), s(2, 3, 1)], 3) == ["a\nc"] and mixing.cut("a", [], 1) == []


def test_hot_source_is_many_shards(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(100).alias("n"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    rows = mixing.mix(d, "doc_id", "n", "source", shard=5000).withColumn("t", mixing.taken(F.col("spans"))).groupBy("source").agg(F.sum("t").alias("t"), F.max("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 1 for r in rows)


def test_small_sources_meet_their_targets(spark):
    sizes = [(i, 1000 if s != "b" else n, s) for i, (s, n) in enumerate([("a", 0), ("b", 2), ("b", 4), ("c", 0), (None, 0), ("d", 0)])] + [(9, 0, "e"), (10, 1, "f"), (11, 17, "g")]
    d = spark.createDataFrame([(i, n, s, "x", 1) for i, n, s in sizes], "doc_id long, n long, source string, shard string, `end` int")
    rows = mixing.mix(d, "doc_id", "n", "source").withColumn("t", mixing.taken(F.col("spans"))).collect()
    by = {}
    for r in rows:
        assert r.t <= 2 * r.size
        by.setdefault((r.source, r.target), []).append(r.t)
    assert len(by) == 7 + 1 and all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())


def test_spans_take_each_place_as_often(spark):
    """Whole passes and the rest: places are taken once more or not, whatever the block and shard."""
    r = random.Random(7)
    d = spark.createDataFrame([(i, r.randrange(0, 60), "ab"[i % 3 == 0]) for i in range(200)], "doc_id long, n long, source string")
    for block in (1, 7, 16):
        for row in mixing.mix(d, "doc_id", "n", "source", block=block, shard=700).collect():
            at = sorted((s.first, s.end, s.times) for s in row.spans)
            assert all(0 <= a < b <= row.size and 1 <= t <= 2 for a, b, t in at) and all(x[1] <= y[0] for x, y in zip(at, at[1:], strict=False))


def test_a_mix_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b c", "s", 5, 6, 7)], "doc_id long, text string, source string, size int, size_ int, carry int")
    assert mixing.mixed(d, "doc_id", "text", "source").columns == d.columns


# --- search
def brute(keys, x, qs, k):
    out = {}
    for q in qs:
        s = (x[q] * x).sum(1)
        o = [i for i in np.lexsort((keys, -s)) if i != q][:k]
        out[keys[q]] = [(keys[i], s[i]) for i in o]
    return out


def test_search_against_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1200, 24)) * r.uniform(0.5, 2, size=(1200, 1))
    x[600:640] = x[5]  # ties
    x = x.astype(np.float32).astype(float)
    keys = np.arange(1200) * 3
    d = spark.createDataFrame([(int(k), v.tolist(), 1) for k, v in zip(keys, x, strict=True)], "vec_id long, embedding array<float>, block int")
    got = ann.nearest(d, "vec_id", "embedding", F.col("key") % 20 == 0).collect()
    want = brute(keys, x, np.flatnonzero(keys % 20 == 0), 20)
    by = {}
    for g in sorted(got, key=lambda g: (g.query_key, g.rank)):
        by.setdefault(g.query_key, []).append((g.key, g.score))
    assert set(by) == {int(k) for k in want} and all(len(v) == 20 for v in by.values())
    hits = sum(len({k for k, _ in by[q]} & {k for k, _ in want[q]}) for q in want) / (20 * len(want))
    assert hits >= 0.9
    score = {(q, k): s for q, v in want.items() for k, s in v}
    assert all(s == pytest.approx(score[q, k], rel=1e-12) for q, v in by.items() for k, s in v if (q, k) in score)
    assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for v in by.values() for a, b in zip(v, v[1:], strict=False))


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (40, [0.0, 0.0]), (60, None), (80, [float("nan"), 1.0]), (None, [1.0, 1.0]), (1, [2.0]), (1, [2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((g.query_key, g.rank, g.key, g.score) for g in ann.nearest(d, "vec_id", "embedding", F.col("key") % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 1, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 1, 0.0)]
    assert ann.nearest(d.limit(0), "vec_id", "embedding", F.col("key") % 20 == 0).count() == 0


def test_search_scores_doubles_exactly(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 5))
    d = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(d, "vec_id", "embedding", F.col("key") % 20 == 0).collect()
    assert all(g.score == pytest.approx(x[g.query_key // 10] @ x[g.key // 10], rel=1e-14) for g in got) and len(got) == 30 * 20


def test_chi_square():
    r = np.random.default_rng(0)
    x = (r.normal(size=(200_000, 8)) ** 2).sum(1)
    assert ann.chi2_cdf(np.array([5.0, 13.36]), 8) == pytest.approx([(x < 5).mean(), 0.9], abs=5e-3)


# --- pipeline
def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mix", "sentencepiece"]
    at = docs
    for name, f in corpus_pipeline.STAGES:
        before, at = at, f(spark, at, sf).cache()
        if name != "sentencepiece":
            assert at.schema.names == docs.schema.names and dict(at.dtypes) == dict(docs.dtypes)
        if name == "quality":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in at.collect()}
            assert sum(lab.get(i) == 1 for i in gone) <= 1 and sum(lab.get(i) == 0 for i in gone) >= 0.8 * sum(v == 0 for v in lab.values())
    rows = at.collect()
    assert rows and all(r.round_trip for r in rows)


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    """Columns called as the operators' own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for c in ("n_lines", "n_removed", "N_LINKS", "quality_score", "__k1", "id", "k1", "size", "removed", "comp"):
        docs = docs.withColumn(c, F.lit(c))
    at = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, sf).cache()
        assert at.columns == docs.columns and {r["__k1"] for r in at.collect()} <= {"__k1"}, name
    assert at.count()


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, sf):
    for d in (odd_docs, no_docs):
        at = d
        for _, f in corpus_pipeline.STAGES:
            at = f(spark, at, sf).cache()
        at.count()
