"""Golden vectors of the operators, and properties that hold for any input."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import bpe_train as B
from seqloom.operators import corpus as K
from seqloom.operators import datasets as D
from seqloom.operators import intervals as I
from seqloom.operators import motifs as M
from seqloom.operators import signal as S
from seqloom.operators import stats as A
from seqloom.operators import tokenizers as T
from seqloom.operators import vocab as V


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def value(df, expr):
    return df.select(expr.alias("x")).first()[0]


def test_stratify(spark):
    rows = [("chr1", b * 100, b * 100 + 1, 0.0) for b in (0, 1, 2, 4, 5, 7, 9, 10)] + [("chr1", 300, 301, 5.0), ("chr1", 800, 801, -5.0)]
    t = spark.createDataFrame(rows, "chrom string, start long, end long, score double")
    got = [(r.genomic_start, r.genomic_end, r.category) for r in S.segments(t, 100).orderBy("genomic_start").collect()]
    assert got == [(0, 300, "neutral"), (300, 400, "conserved"), (400, 600, "neutral"), (700, 800, "neutral"), (800, 900, "accelerated"), (900, 1100, "neutral")]
    assert C.z_cutoff(0.1) * S.bins(t, 100).agg(F.stddev_samp("binned_score")).first()[0] == pytest.approx(3.876957178922244)
    assert 1.645 * S.bins(t, 100).agg(F.stddev_pop("binned_score")).first()[0] == pytest.approx(3.6783318229871544)


def test_nan_scores_are_missing(spark):
    t = spark.createDataFrame([("c", 0, 1, float("nan")), ("c", 1, 2, 2.0)], "chrom string, start long, end long, score double")
    assert S.bins(t, 10).first().binned_score == 2.0


def test_merge_touches_but_not_gaps(spark):
    iv = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 15, 30), ("c", 31, 40)], "chrom string, start long, end long")
    m = I.merge_bed(iv)
    assert [(r.start, r.end) for r in m.orderBy("start").collect()] == [(0, 30), (31, 40)]
    assert [(r.start, r.end) for r in I.merge_bed(m.select("chrom", "start", "end")).orderBy("start").collect()] == [(0, 30), (31, 40)]


def test_intersect(spark):
    a = spark.createDataFrame([("c", 0, 100)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 50, 60), ("c", 90, 120)], "chrom string, start long, end long")
    for bucket in (7, 50, 1000):
        assert sorted((r.o_start, r.o_end) for r in I.overlap_join(a, b, slices=bucket).collect()) == [(50, 60), (90, 100)]


def test_bucketed_join_equals_nested_loop(spark):
    r = random.Random(1)
    mk = lambda n: [(r.choice("ab"), s := r.randrange(200), s + r.randrange(1, 60)) for _ in range(n)]
    a, b = mk(40), mk(40)
    want = sorted((x[0], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    s = "chrom string, start long, end long"
    for n in (1, 3, 8):
        j = I.overlap_join(spark.createDataFrame(a, s).repartition(n), spark.createDataFrame(b, s), slices=25)
        assert sorted((x.chrom, x.o_start, x.o_end) for x in j.collect()) == want


def test_fetch(spark):
    ref = I.chunked(spark.createDataFrame([("chr", "ACGTACGT")], "chrom string, seq string"), 3)
    iv = spark.createDataFrame([(1, "chr", 1, 4), (2, "chr", 5, 9)], "k int, chrom string, start long, end long")
    assert [(r.k, r.seq) for r in I.fetch(iv, ref, 3, ["k"]).collect()] == [(1, "CGT")]


def test_canonical(spark):
    d = spark.createDataFrame([(c,) for c in "chr1 chr22 chrX chr23 chrM chr1_alt chr01".split()], "c string")
    rows = d.select(C.canonical_chrom("c"), C.canonical_chrom_set("c")).collect()
    assert [r[0] for r in rows] == [True, True, True, False, False, False, True] and [r[1] for r in rows][-1] is False


VOCAB = "A C G T N AC ACG GT CGT".split()


def test_viterbi():
    names = lambda t, f: " ".join(x[0] for x in T.viterbi(t, {v: f(v) for v in VOCAB}, 3, -100.0))
    sq, ln = (lambda v: float(len(v) ** 2)), (lambda v: float(len(v)))
    assert names("ACGT", sq) == "A CGT" and names("ACGTACGGT", sq) == "A CGT ACG GT"
    assert names("ACGT", ln) == "A CGT" and names("ACGTACGGT", ln) == "A CGT ACG GT"
    assert [x[0] for x in T.viterbi("AxyC", {v: sq(v) for v in VOCAB}, 3, -5.0)] == ["A", "xy", "C"]
    with pytest.raises(ValueError):
        T.viterbi("Ax", {"A": 1.0}, 1)


@given(st.text("ACGTN", max_size=40))
@settings(max_examples=60, deadline=None)
def test_viterbi_partitions_the_text(s):
    t = T.viterbi(s, {v: float(len(v) ** 2) for v in VOCAB}, 3)
    assert "".join(x[0] for x in t) == s and all(a[2] == b[1] for a, b in zip(t, t[1:], strict=False))


def naive_bpe(text, ranks):
    parts = list(text)
    while True:
        c = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not c:
            return parts
        i = min(c)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.text("ACGT", max_size=60))
@settings(max_examples=100, deadline=None)
def test_bpe_equals_naive(s):
    m = [("A", "C"), ("G", "T"), ("AC", "GT"), ("A", "A"), ("AA", "A"), ("T", "AC")]
    r = {p: i for i, p in enumerate(m)}
    assert [x[0] for x in T.bpe(s, r)] == naive_bpe(s, r)


def test_bpe_training_equals_library(spark):
    from tokenizers import Tokenizer, models, trainers

    r = random.Random(3)
    seqs = ["".join(r.choice("ACGT") for _ in range(80)) for _ in range(30)]
    v, merges = B.train(spark.createDataFrame([(s,) for s in seqs], "seq string"), "seq", 20, 2)
    t = Tokenizer(models.BPE(unk_token="[UNK]"))
    t.train_from_iterator(seqs, trainers.BpeTrainer(vocab_size=20, min_frequency=2, special_tokens=V.SPECIALS, initial_alphabet=list("ACGTN")))
    assert v == sorted(t.get_vocab(), key=t.get_vocab().get)


def test_bpe_query_trains_to_the_reference_size_or_the_least_frequency(spark, sf):
    from tokenizers import Tokenizer, models, trainers

    from seqloom.plans import q_tokens as Q

    texts = [r.seq for r in Q.seqs(spark, sf).collect()]
    pieces = [t[i : i + 1000] for t in texts for i in range(0, len(t or ""), 1000)]
    t = Tokenizer(models.BPE(unk_token="[UNK]"))
    t.train_from_iterator(pieces, trainers.BpeTrainer(vocab_size=2048, min_frequency=100, special_tokens=V.SPECIALS, initial_alphabet=list("ACGTN")))
    assert {r.token: r.id for r in Q.bpe_train(spark, sf).collect()} == t.get_vocab()


def test_bpe_training_on_ties_runs_and_copies(spark):
    """Runs of one letter, equal counts, repeated sequences; every merge against a recount after each."""
    r = random.Random(5)
    seqs = ["A" * n for n in range(1, 30)] + ["".join(r.choice("AC") for _ in range(40)) for _ in range(20)] * 3
    words, vocab, merges = [list(s) for s in seqs], [*V.SPECIALS, *"ACGNT"], []
    while len(vocab) < 60:
        n = {}
        for w in words:
            for p in zip(w, w[1:], strict=False):
                n[p] = n.get(p, 0) + 1
        best = min(n, key=lambda p: (-n[p], vocab.index(p[0]), vocab.index(p[1])), default=None)
        if best is None or n[best] < 2:
            break
        merges.append(best)
        vocab += [best[0] + best[1]] if best[0] + best[1] not in vocab else []
        for w in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [w[i] + w[i + 1]]
                i += 1
    assert B.train(spark.createDataFrame([(s,) for s in seqs], "seq string"), "seq", 60, 2) == (vocab, merges)


def test_bpe_merges_side_by_side_equal_one_after_the_other():
    """Merges of a group are done at once; equal, overlapping and chained pairs, and tokens made twice."""
    r = random.Random(11)
    for _ in range(200):
        ids = np.array([r.choice([0, 1, 2, 3, 3, 4]) for _ in range(r.randint(1, 80))] + [0], np.uint16)
        run = [(r.randint(1, 4 + i), r.randint(1, 4 + i), r.choice([5 + i, 5 + i, 5])) for i in range(r.randint(1, 9))]
        want = ids.tolist()
        for a, b, made in run:
            out, i = [], 0
            while i < len(want):
                hit = want[i : i + 2] == [a, b]
                out.append(made if hit else want[i])
                i += 1 + hit
            want = out
        got, told = ids, []
        for group in B.levels(run):
            got = B._merge(got, group, lambda x, at, sign: told.extend((p, sign) for p in zip(x[at[(at >= 0) & (at < len(x) - 1)]].tolist(), x[at[(at >= 0) & (at < len(x) - 1)] + 1].tolist(), strict=True)))
        assert got.tolist() == want
        n = Counter(zip(ids.tolist(), ids.tolist()[1:], strict=False))
        for p, sign in told:
            n[p] += sign
        assert +n == Counter(zip(want, want[1:], strict=False))
    assert len(B.levels([(1, 2, 9), (3, 4, 10), (1, 4, 11), (2, 3, 12)])) == 2


def test_bpe_round_sends_only_neighbours_that_can_matter(spark, monkeypatch):
    """Rows about neighbours follow the pairs that may come next, not the vocabulary; floors cut rows, never a result."""
    r = random.Random(7)
    seqs = spark.createDataFrame([("".join(r.choices("ACGT", [4, 3, 2, 1], k=300)),) for _ in range(40)], "seq string").localCheckpoint()
    sent, whole = [], B.changes

    def changes(blocks, done, run, asked, wanted, size):
        d = whole(blocks, done, run, asked, wanted, size)
        sent.append((d.filter("kind > 0").count(), len(asked)))
        return d

    full = B.train(seqs, "seq", 120, 2)
    monkeypatch.setattr(B, "changes", changes)
    monkeypatch.setattr(B, "WANTED", 40)
    assert B.train(seqs, "seq", 120, 2) == full
    last = sent[-1]
    assert last[1] > 200 and last[0] < 10 * last[1]  # each pair has some hundred neighbours


def test_unk_check(spark):
    f = T.unigram_decoder(spark, {"A": 1.0, "C": 1.0, "G": 1.0, "T": 1.0})
    assert value(one(spark, s="TCCTGCCTCAGCCAAAA"), T.has_unknown(f(F.col("s")))) is False


def test_tokenizer_json():
    u = T.load_tokenizer('{"model": {"vocab": [["[UNK]", 0.0], ["A", 1.0]]}}')
    assert u["kind"] == "unigram" and u["unk_id"] == 0
    b = T.load_tokenizer('{"model": {"vocab": {"A": 0, "C": 1}, "merges": ["A C", ["C", "A"]]}}')
    assert b["merges"] == [("A", "C"), ("C", "A")] and b["unk_id"] is None
    assert T.load_tokenizer(T.dump_tokenizer("unigram", [("A", 1.0)]))["vocab"] == [("A", 0, 1.0)]


def test_chunks_are_tokenised_alone(spark):
    d = one(spark, id=1, s="ACGTACGTAC")
    f = T.unigram_decoder(spark, {v: float(len(v) ** 2) for v in VOCAB})
    rows = T.in_chunks(d, "s", 4, f, ["id"]).orderBy("piece").collect()
    assert [r.part for r in rows] == ["ACGT", "ACGT", "AC"] and all("".join(t.token for t in r.tokens) == r.part for r in rows)


def test_windows_and_n(spark):
    d = spark.createDataFrame([(["AN"] * 256 + ["A"] * 844,)], "t array<string>")
    w = d.select(F.explode(K.count_windows(F.col("t"), 512)).alias("w")).select(K.n_share(F.col("w")).alias("n"), F.size("w").alias("k")).collect()
    assert [(r.n, r.k) for r in w] == [(0.5, 512), (0.0, 512)]
    assert value(spark.createDataFrame([(["A"],)], "t array<string>"), K.count_windows(F.col("t"), 512)) == []


def test_split_sizes(spark):
    d = spark.range(17)
    n = {r[0]: r[1] for r in K.split(d, "id", 0.8, 0.1).groupBy("split").count().collect()}
    assert n == {"train": 13, "val": 1, "test": 3}
    a = sorted(tuple(r) for r in K.split(d.repartition(1), "id", 0.8, 0.1).collect())
    assert a == sorted(tuple(r) for r in K.split(d.repartition(8), "id", 0.8, 0.1).collect())


def test_motif_expansion(spark):
    d = spark.createDataFrame([("A*T",), ("A******T",)], "motif string")
    assert sorted(r.variant for r in M.expand(d).collect()) == ["AAT", "ACT", "AGT", "ATT"]


def test_scalar_functions(spark):
    d = one(spark, s="ACGTA", g="GATTACA", c="AACG", e="")
    assert value(d, C.kmers("s", 3)) == ["ACG", "CGT", "GTA"] and value(d, C.kmers("e", 3)) == []
    assert value(d, C.gc_fraction("g")) == pytest.approx(2 / 7) and value(d, C.gc_fraction("e")) == 0.0
    assert value(d, C.complement("c")) == "TTGC" and value(d, C.reverse_complement("c")) == "CGTT"
    names = ["chr1_dELS_positive.fa", "PLS_negative.fa", "chrQ_x_positive.fa"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(C.label_from_name("n")).collect()] == ["dELS", "PLS", "chrQ_x"]
    p = value(one(spark, c="chr-2-4"), C.parse_coord("c"))
    assert (p.chrom, p.start, p.end) == ("chr", 2, 4) and value(one(spark, c="chr-2"), C.parse_coord("c")) is None


def test_vocab_tiers(spark):
    pools = {"c": "xyzw", "n": "xyvu", "a": "xwu"}
    v = spark.createDataFrame([(p, t, i, 1) for p, s in pools.items() for i, t in enumerate(s)], "pool string, token string, id long, cnt long")
    m = V.priority_merge(V.partition(v), 10)
    assert [r.token for r in m.orderBy("rank").collect()] == ["x", "z", "y", "v"]
    e = V.with_essentials(m, 8)
    assert [r.token for r in e.orderBy("id").collect()] == ["x", "z", "y", "v", "[UNK]", "[CLS]", "[SEP]", "[PAD]"]
    assert [r.jaccard for r in V.jaccard_pairs(v).collect() if (r.pool_a, r.pool_b) == ("c", "n")] == [round(2 / 6, 4)]


def test_enrichment(spark):
    c = spark.createDataFrame([("p", "t", 30), ("p", "o", 970), ("e", "t", 10), ("e", "o", 1190)], "s string, token string, cnt long")
    r = A.enrichment(c, "s", "p", "e").filter("token = 't'").withColumn("p", C.normal_p("z")).first()
    assert r.log2fc == pytest.approx(1.80145432061792) and r.z == pytest.approx(3.787365285058881) and r.p == pytest.approx(1.522531853246872e-4)


def test_bh(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "k int, p double")
    for f in (A.bh, A.bh_large):
        assert [r.q for r in f(d, "p", "k").orderBy("k").collect()] == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_importance(spark):
    o = spark.createDataFrame([("A", 50), ("C", 50)], "token string, cnt long")
    r = spark.createDataFrame([(i, t, n) for i in range(10) for t, n in (("A", 10), ("G", 90))], "rep int, token string, cnt long")
    got = {x.token: x for x in A.importance(o, r, 10).collect()}
    assert got["A"].p_ge == pytest.approx(1 / 11) and got["C"].p_ge == pytest.approx(1 / 11) and got["G"].p_ge == pytest.approx(1.0)
    assert got["A"].count_bg_mean == 10 and got["A"].count_bg_sd == 0 and got["C"].count_bg_mean == 0 and not any(x.important for x in got.values())


def test_importance_of_counts_whose_squares_leave_64_bits(spark):
    """A few gigabytes of letters: the commonest tokens occur 1e8 times in each of 59 replicates."""
    import statistics

    rng = random.Random(2)
    n = {t: [m + rng.randrange(-3 * 10**4, 3 * 10**4) for _ in range(59)] for t, m in (("AAAA", 4 * 10**8), ("AAAC", 16 * 10**7), ("CGCG", 10**6))}
    n["GGGG"] = [0] * 58 + [5 * 10**9]
    o = spark.createDataFrame([("AAAA", 6 * 10**8), ("CGCG", 10**5)], "token string, cnt long")
    r = spark.createDataFrame([(i, t, c) for t, counts in n.items() for i, c in enumerate(counts) if c], "rep int, token string, cnt long")
    got = {x.token: x for x in A.importance(o, r, 59).collect()}
    assert got.keys() == n.keys()
    for t, counts in n.items():
        assert got[t].count_bg_mean == pytest.approx(statistics.fmean(counts), rel=1e-14)
        assert got[t].count_bg_sd == pytest.approx(statistics.stdev(counts), rel=1e-12)


def test_mean_log2fc(spark):
    c = spark.createDataFrame([("x", "A", 3), ("x", "AC", 1)], "k string, token string, cnt long")
    b = spark.createDataFrame([("A", 1), ("G", 4)], "token string, cnt long")
    cell, bg, n, m, v = {"A": 3, "AC": 1}, {"A": 1, "G": 4}, 4, 5, 3
    want = sum(math.log2((cell.get(t, 0) + 0.5) / (n + 0.5 * v)) - math.log2((bg.get(t, 0) + 0.5) / (m + 0.5 * v)) for t in cell | bg) / v
    assert A.mean_log2fc(c, b, ["k"]).first().mean_log2fc == pytest.approx(want) == pytest.approx(0.12015140637555881)


def test_js(spark):
    d = one(spark, a=1)
    p, q = [F.lit(x) for x in (0.10, 0.40, 0.35, 0.15)], [F.lit(x) for x in (0.05, 0.30, 0.40, 0.25)]
    assert value(d, A.js_divergence(p, q)) == pytest.approx(0.021614302255818566)
    assert value(d, A.js_distance(p, q)) == pytest.approx(0.1470180337775559) and value(d, A.js_distance(p, q, True)) == pytest.approx(0.14696938456699069)


def test_entropy(spark):
    c = spark.createDataFrame([("x", t, n) for t, n in zip("ACGT", (4, 2, 1, 1), strict=True)], "k string, token string, cnt long")
    r = A.entropy(c, ["k"], spark.createDataFrame([("x", 80)], "k string, bases long")).first()
    assert r.shannon_h_bits == pytest.approx(1.75) and r.h_normalized == pytest.approx(0.875) and r.bp_per_token == 10


def test_kappa(spark):
    c = spark.createDataFrame([("x", "a", "a", 4), ("x", "b", "b", 4), ("x", "a", "b", 1), ("x", "b", "a", 1)], "k string, a string, b string, w long")
    r = S.kappa(c, ["k"], "a", "b", "w").first()
    assert r.agreement == pytest.approx(0.8) and r.kappa == pytest.approx(0.6)


def test_boundaries(spark):
    r = {x.bin_size: x for x in S.boundary_probability(spark.createDataFrame([(100,), (10,), (10,)], "bin_size int"), spark.createDataFrame([(12,)], "motif_length int")).collect()}
    assert (r[100].p_cross, r[100].p_contain, r[10].p_cross, r[10].p_contain) == (0.11, 0.89, 1.0, 0.0)


def test_consistency(spark):
    d = spark.createDataFrame([("t", "m", n) for n in (1, 2, 3)] + [("t", "s", 4)], "tokenizer string, motif string, n_tokens int")
    assert {r.motif: r.sd_tokens for r in M.consistency(d).collect()} == {"m": 1.0, "s": 0.0}


def test_classification(spark):
    d = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 2, -100], [0, 0, 1, 1, 1, 0, 1], strict=True)), "y int, h int")
    r = A.classification(d, "y", "h").first()
    assert [round(x, 4) for x in (r.accuracy, r.precision, r.recall, r.f1)] == [0.6667, 0.4444, 0.5556, 0.4889] and r.mcc == pytest.approx(0.45226701686664544)


def test_labels_and_pairs(spark):
    p = spark.createDataFrame([(1, "chr1-2-4", "a, b,"), (2, "bad", "a"), (3, "chr1-1-9", " ,")], "peak_id long, coord string, labels string")
    rows = D.peak_rows(p)
    assert [(r.peak_id, r.start, r.end, r.labels) for r in rows.collect()] == [(1, 1, 4, ["a", "b"])]
    assert D.expand_labels(rows, "drop").count() == 0 and D.expand_labels(rows).count() == 2
    f = spark.createDataFrame([("x_positive.fa",), ("x_negative.fa",), ("y_positive.fa",)], "name string")
    assert {r.label: (r.positive is not None, r.negative is not None) for r in D.pair_files(f).collect()} == {"x": (True, True), "y": (True, False)}
    with pytest.raises(ValueError):
        D.manifest_row(f, name="none")


def test_mask_rates(spark):
    d = spark.range(200).select("id", F.expr("transform(sequence(1, 100), x -> cast(10 + x as int))").alias("ids"))
    m = d.select(F.explode(K.mask(F.col("ids"), F.col("id"), 4, 5000, [11])).alias("m")).select("m.*").collect()
    hit = [x for x in m if x.label != -100]
    assert abs(len(hit) / len(m) - 0.15) < 0.01 and abs(sum(x.id == 4 for x in hit) / len(hit) - 0.8) < 0.03 and all(x.label != 11 for x in hit)


def test_tiles_change_nothing(spark):
    r = random.Random(9)
    iv = [(r.choice("ab"), s := r.randrange(400), s + r.choice([1, 3, 10, 150])) for _ in range(120)]
    d = spark.createDataFrame(iv, "chrom string, start long, end long")
    want = sorted(map(tuple, I.merge_bed(d, tile=10**6).collect()))
    assert sum(x[3] for x in want) == 120
    for t in (1, 7, 64):
        assert sorted(map(tuple, I.merge_bed(d, tile=t).collect())) == want
    b = spark.createDataFrame([("c", i * 10, i * 10 + 10, "ab"[(i // 7) % 2]) for i in range(100) if i % 13], "chrom string, genomic_start long, genomic_end long, category string")
    runs = sorted(map(tuple, S.merge_adjacent(b).collect()))
    for t in (10, 30, 250):
        assert sorted(map(tuple, S.merge_adjacent(b, t).collect())) == runs


# --- motif tokenizer
def test_motif_tokens_with_one_word_choices():
    """No choice is left: golden vectors of the look-ahead."""
    never = lambda i, found: pytest.fail("a choice")
    t = lambda text, words, triples=(): T.motif_tokens(text, set(words), set(triples), never)
    assert t("NACGTTAG", ["ACGT", "GTTAG"]) == ["N", "A", "C", "GTTAG"]  # a letter looks no further, a word does
    assert t("ACGTACG", ["ACGT", "CGTACG"]) == ["A", "CGTACG"]
    assert t("ACGTTTTTT", ["ACGT", "GTTTTTT"]) == ["A", "C", "GTTTTTT"]
    assert t("AACG", ["ACGT"], ["AAC"]) == ["AAC", "G"] and t("AAC", [], []) == ["A", "A", "C"] and t("", ["ACGT"]) == []
    assert t("ACACGT", ["ACGT"], ["ACA"]) == ["A", "C", "ACGT"]


def test_motif_choice_is_seeded(spark):
    d = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGT"), (3, None)], "id long, s string")
    f = lambda seed: T.motif_tokenizer(spark, {"ACGT", "ACGTA", "ACGTAC"}, seed)
    got = [{r.id: r.t for r in d.repartition(n).select("id", T.names(f(1)(F.col("s"))).alias("t")).collect()} for n in (1, 3)]
    assert got[0] == got[1] and got[0][1] == got[0][2] and got[0][3] is None and "".join(got[0][1]) == "ACGTACGT"
    assert len({tuple(d.filter("id = 1").select(T.names(f(k)(F.col("s")))).first()[0]) for k in range(12)}) > 1


# --- counts and shuffles
def test_kmer_counts_against_counting(spark):
    from collections import Counter

    rows = [("a", "ACGTNACG"), ("a", "AC"), ("b", ""), ("b", None), (None, "acgTT"), ("c", "A" * 30)]
    d = spark.createDataFrame(rows, "k string, s string").repartition(3)
    want = Counter((k, s[i : i + n]) for k, s in rows if s for n in (1, 3) for i in range(len(s) - n + 1) if set(s[i : i + n]) <= set("ACGT"))
    assert {(r.k, r.token): r.cnt for r in A.kmer_counts(d, ["k"], "s", [1, 3]).collect()} == dict(want)
    assert A.kmer_counts(d.limit(0), [], "s", [2]).count() == 0
    with pytest.raises(ValueError):
        A.kmer_counts(d, [], "s", [13])


def test_shuffles_keep_letters_and_counts_agree(spark):
    from collections import Counter

    rows = [(1, "ACGTACGGTTAACC" * 3), (2, "AC"), (3, ""), (4, None)]
    d = spark.createDataFrame(rows, "id long, s string")
    got = {(r.rep, r.key): r.seq for r in A.shuffled(d, "id", "s", 4, 9).collect()}
    again = {(r.rep, r.key): r.seq for r in A.shuffled(d.repartition(4), "id", "s", 4, 9).collect()}
    assert got == again and all(sorted(got[k, str(i)]) == sorted(s or "") for k in range(4) for i, s in rows)
    assert len({got[k, "1"] for k in range(4)}) == 4
    want = Counter((k, s[i : i + 3]) for (k, _), s in got.items() for i in range(len(s) - 2))
    assert {(r.rep, r.token): r.cnt for r in A.shuffled_counts(d, "id", "s", 3, 4, 9).collect()} == dict(want)


def test_shuffled_kmers_of_short_long_and_odd_rows_follow_the_orders(monkeypatch):
    """The packed counter against the orders themselves: rows below k, at and over the letters taken at once, other letters."""
    r = random.Random(2)
    texts = ["", "AC", "ACG", "ACGNNTACGTRRRACGT", "N" * 9] + ["".join(r.choices("ACGT", k=n)) for n in (4, 63, 64, 65, 700)] + ["".join(r.choices("ACGTN", k=300))]
    monkeypatch.setattr(A, "SHUFFLE_LETTERS", 64 * 3)
    for k in (1, 4, 5):
        got, want = A._Shuffles(k, 7, 3), Counter()
        for key, t in enumerate(texts):
            code = A._CODE[np.frombuffer(t.encode(), np.uint8)]
            got.add(code, str(key))
            for rep, order in enumerate(A._orders(np.array([0, len(t)]), 3, 7, [str(key)])):
                s = "".join(t[i] for i in order)
                want += Counter((rep, s[i : i + k]) for i in range(len(s) - k + 1) if not set(s[i : i + k]) - set("ACGT"))
        rep, token = np.nonzero(got.n)
        assert {(int(x), A._spelled(k)[y]): int(got.n[x, y]) for x, y in zip(rep, token, strict=True)} == dict(want)


def test_normal_p_is_the_exact_one(spark):
    z = [0.0, 0.3, -0.7, 1.96, 5.5, -9.0, 30.0, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(C.normal_p("z")).collect()]
    assert got[:7] == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z[:7]], rel=1e-12) and math.isnan(got[7]) and got[8] is None


# --- sweeps and windows
def test_sweep_arguments():
    assert V.vocab_sizes("2048, 4096,", ("2048", "4096")) == ["2048", "4096"] and V.with_suffix(["a_1", "b_2"], ["2"]) == ["b_2"]
    with pytest.raises(ValueError):
        V.vocab_sizes("2048,1", ("2048",))
    with pytest.raises(ValueError):
        V.with_suffix(["a_1"], ["2"])


def test_eval_windows(spark):
    from seqloom.operators import datasets as D

    d = spark.createDataFrame([("c1", "ACGTNACGTA", [float(i) for i in range(9)]), ("c2", "AC", None)], "chrom string, seq string, scores array<double>")
    assert sorted((r.start, r.end, r.length, r.seq, r.scores) for r in D.eval_windows(d, "chrom", "seq", "scores", 4).collect()) == [(0, 4, 4, "ACGT", [0.0, 1.0, 2.0, 3.0]), (8, 9, 1, "T", [8.0])]


def test_equal_shares_have_no_side(spark):
    c = spark.createDataFrame([("a", "x", 5), ("b", "x", 5), ("a", "y", 1), ("b", "y", 1)], "set string, token string, cnt long")
    assert {r.side for r in A.enrichment(c, "set", "a", "b").collect()} == {"equal"}


# --- tiles
def test_neighbours_across_tiles(spark):
    r = random.Random(3)
    g = spark.createDataFrame([("c", 5, i, None if r.random() < 0.2 else r.random()) for i in range(50)], "chrom string, window long, idx long, mean double")
    rows = lambda n: sorted((x.idx, x.prev) for x in S._with_previous(g, n).collect())
    want = {x.idx: x["mean"] for x in g.collect()}
    assert repr(rows(7)) == repr(rows(1000)) == repr(sorted((i, want.get(i - 1)) for i in range(50)))


@pytest.mark.parametrize("tile", [3, 10, 1000])
def test_imputation_across_tiles(spark, tile):
    r = random.Random(tile)
    rows = [(c, p, None if r.random() < 0.7 else float(p)) for c in "ab" for p in sorted(r.sample(range(200), 60))]
    got = {(x.chrom, x.pos): x.imputed for x in I.nearest_impute(spark.createDataFrame(rows, "chrom string, pos long, value double"), tile=tile).collect()}
    for c, p, v in rows:
        k = [q for d, q, w in rows if d == c and w is not None]
        want = v if v is not None else float(min(k, key=lambda q: (abs(q - p), q))) if k and min(k) <= p <= max(k) else None
        assert got[c, p] == want


def test_semi_and_anti_overlap_split_the_rows(spark):
    a = spark.createDataFrame([("c", 0, 5, 1), ("c", 0, 5, 1), ("c", 9, 10, 2), ("d", 0, 5, 3), (None, 0, 5, 4)], "chrom string, start long, end long, k int")
    b = spark.createDataFrame([("c", 4, 6)], "chrom string, start long, end long")
    assert sorted(x.k for x in I.overlap_join(a, b, "left_semi", 4).collect()) == [1, 1] and sorted(x.k for x in I.overlap_join(a, b, "left_anti", 4).collect()) == [2, 3, 4]


# --- many sequences at once
def _texts(seed, n, letters):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(n)] + ["", "A", letters * 9]


def _tokens(spark, f, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    return [r.t for r in d.select("id", f(F.col("s")).alias("t")).orderBy("id").collect()]


@pytest.mark.parametrize("unk", [-3.0, None])
def test_viterbi_side_by_side(spark, unk):
    scores = {"A": 1.0, "C": 1.0, "G": 0.5, "T": 1.0, "AC": 2.0, "CA": 2.5, "ACG": 3.5, "TTTT": 4.0, "GT": -1.0}
    texts = _texts(1, 300, "ACGT" if unk is None else "ACGTN☃é")
    got = _tokens(spark, T.unigram_decoder(spark, scores, unk), [*texts, None])
    assert got[-1] is None
    for t, x in zip(texts, got, strict=False):
        assert [tuple(y) for y in x] == T.viterbi(t, scores, 4, unk)
    assert _tokens(spark, T.unigram_decoder(spark, scores, unk, offsets=False), texts) == [[y.token for y in x] for x in got[:-1]]


def test_viterbi_refuses_unknown_letters(spark):
    with pytest.raises(Exception, match="unknown letter"):
        _tokens(spark, T.unigram_decoder(spark, {"A": 1.0}), ["AXA"] * 20)


def test_merges_side_by_side(spark):
    sound = [("A", "A"), ("C", "G"), ("AA", "CG"), ("T", "T"), ("TT", "TT"), ("AA", "A"), ("é", "A")]
    tangled = [("B", "C"), ("A", "BC"), ("ABC", "D"), ("A", "B"), ("AB", "C")]
    assert not T.Merges(sound).back.any() and T.Merges(tangled).back.any()
    for merges, letters in ((sound, "ACGTé"), (tangled, "ABCD")):
        ranks = {m: i for i, m in enumerate(merges)}
        texts = _texts(2, 300, letters)
        for t, x in zip(texts, _tokens(spark, T.bpe_encoder(spark, merges), texts), strict=True):
            assert [tuple(y) for y in x] == T.bpe(t, ranks)
    texts = _texts(3, 40, "ACX")
    got = _tokens(spark, T.bpe_encoder(spark, [("A", "C")], {"A", "C", "AC"}), texts)
    assert [[tuple(y) for y in x] for x in got] == [T.bpe(t, {("A", "C"): 0}, {"A", "C", "AC"}) for t in texts]


def test_motifs_side_by_side(spark):
    words, triples = {"ACGT", "ACGTA", "GTAC", "GTACGT", "TTTTT", "CGTTTT"}, {"ACG", "TTT"}
    texts = _texts(4, 300, "ACGTN")
    lot = lambda i, w: int(T.drawn(np.array([i]), *T.word_factors([w], 5))[0])
    for t, x in zip(texts, _tokens(spark, T.motif_tokenizer(spark, words, 5, triples, offsets=False), texts), strict=True):
        assert x == T.motif_tokens(t, words, triples, lambda i, found: min(found, key=lambda w: (lot(i, w), len(w))))


def test_span_moments(spark):
    d = spark.createDataFrame([(1, [1.0, float("nan"), 3.0, None]), (2, []), (3, None), (4, [float("nan")]), (5, [2.0])], "id int, s array<double>")
    got = {r.id: (r.mean_score, r.var_score) for r in A.span_moments(d, "s").collect()}
    assert got == {1: (2.0, 1.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (2.0, 0.0)}


def test_loaded_tokenizers_cover_motifs(spark):
    uni = T.load_tokenizer(T.dump_tokenizer("unigram", [("[UNK]", 0.0), ("A", 1.0), ("C", 1.0), ("AC", 4.0)], unk_id=0))
    bpe = T.load_tokenizer(T.dump_tokenizer("bpe", [("[UNK]", 0.0), ("A", 0.0), ("C", 0.0), ("AC", 0.0)], [("A", "C")]))
    v = spark.createDataFrame([("AC", "m"), ("ACA", "m"), ("AXC", "m")], "variant string, motif string")
    rows = M.coverage_of(v, {"u": T.LoadedTokenizer(spark, uni), "b": T.LoadedTokenizer(spark, bpe)}).collect()
    assert sorted((r.tokenizer, r.variant, r.n_tokens, r.perfect, r.in_vocab) for r in rows) == [
        ("b", "AC", 1, 1, 1), ("b", "ACA", 2, 0, 0), ("b", "AXC", 3, 0, 0), ("u", "AC", 1, 1, 1), ("u", "ACA", 2, 0, 0), ("u", "AXC", 3, 0, 0),
    ]


# --- large vocabularies
def test_learned_merges_of_any_order():
    """Thousands of merges, some of whose tokens earlier merges take, against one merge after the other."""
    rng = random.Random(8)
    tokens, merges = list("ACGTé"), []
    while len(merges) < 1500:
        a, b = rng.choices(tokens[:400], k=2)
        if len(a + b) < 9 and (a, b) not in merges:
            merges.append((a, b))
            tokens.append(a + b)
    shuffled = merges[:]
    rng.shuffle(shuffled)
    for m in (merges, shuffled, merges[:1] * 2 + merges[1:300]):
        ranks = {x: i for i, x in enumerate(m)}
        texts = ["".join(rng.choices("ACGTéX", [9, 9, 9, 9, 3, 1], k=rng.randrange(0, 200))) for _ in range(150)] + ["A" * 333, ""]
        t = T.Letters(texts)
        start = T.bpe_all(t, T.Merges(m))
        want = [int(a) + x for a, text in zip(t.start, texts, strict=True) for _, x, _ in T.bpe(text, ranks)]
        assert start.tolist() == want


def test_automaton_finds_all_words():
    rng = random.Random(9)
    words = list({"".join(rng.choices("ACGT", k=rng.randrange(1, 9))) for _ in range(900)} | {"é☃", "☃"})
    texts = ["".join(rng.choices("ACGT☃éZ", [9, 9, 9, 9, 1, 1, 1], k=rng.choice([0, 3, 50, 2000]))) for _ in range(60)]
    m, t = T.Automaton(words), T.Letters(texts)
    ends = m.ends[m.states(t)]
    for row, text in enumerate(texts):
        for i in range(len(text)):
            got = {words[w] for w in ends[t.start[row] + i] if w >= 0}
            assert got == {w for w in words if text[: i + 1].endswith(w)}
    empty = T.Automaton([])
    assert (empty.ends[empty.states(t)] == -1).all()


def test_motifs_of_long_sequences():
    rng = random.Random(10)
    words = sorted({"".join(rng.choices("ACGT", k=rng.randrange(4, 10))) for _ in range(300)})
    texts = ["".join(rng.choices("ACGT", k=20_000)), "", "ACG", "".join(rng.choices("AC", k=700))]
    t, f = T.Letters(texts), T.word_factors(words, 3)
    start = T.motif_starts(t, T.Automaton(words), T.Automaton(["ACG", "TTT"]), f)
    number = {w: i for i, w in enumerate(words)}
    lot = lambda i, w: (int(T.drawn(np.array([i]), f[0][number[w] : number[w] + 1], f[1][number[w] : number[w] + 1])[0]), len(w))
    want = []
    for a, text in zip(t.start.tolist(), texts, strict=True):
        for w in T.motif_tokens(text, set(words), {"ACG", "TTT"}, lambda i, found: min(found, key=lambda x: lot(i, x))):
            want.append(a)
            a += len(w)
    assert start.tolist() == want


def _greedy(words, size, least):
    """One merge after the other, all pairs counted anew each time."""
    counts = Counter(words)
    vocab = [*B.SPECIALS, *sorted(set("ACGTN") | set("".join(words)))]
    ids, merges = {t: i for i, t in enumerate(vocab)}, []
    rows = [(list(w), c) for w, c in counts.items()]
    while len(vocab) < size:
        pairs = Counter()
        for w, c in rows:
            for p in zip(w, w[1:], strict=False):
                pairs[p] += c
        best = min(pairs.items(), key=lambda x: (-x[1], ids[x[0][0]], ids[x[0][1]]), default=(None, 0))
        if best[1] < least:
            break
        a, b = best[0]
        merges.append((a, b))
        if a + b not in ids:
            ids[a + b] = len(vocab)
            vocab.append(a + b)
        for w, _ in rows:
            i = 0
            while i < len(w) - 1:
                if w[i] == a and w[i + 1] == b:
                    w[i : i + 2] = [a + b]
                i += 1
    return vocab, merges


@pytest.mark.parametrize("letters,length,size", [("ACGT", 12, 150), ("AAAAC", 24, 90), ("ACGTN", 10, 200)])
def test_long_runs_give_the_greedy_merges(spark, monkeypatch, letters, length, size):
    """Ties, runs of one letter, tokens made twice; far fewer rounds than merges."""
    rounds, real = [], B.changes
    monkeypatch.setattr(B, "changes", lambda *a: rounds.append(len(a[2])) or real(*a))
    monkeypatch.setattr(B, "PENDING", 30)
    rng = random.Random(length)
    base = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(40)]
    words = ["".join(rng.choices(base, k=length)) for _ in range(300)]
    words += words[:40]
    got = B.train(spark.createDataFrame([(w,) for w in words], "w string"), "w", size, 20)
    assert got == _greedy(words, size, 20)
    assert len(rounds) < len(got[1]) / 2


def test_encoder_merges_equal_pieces_once(spark):
    """Merges in the order of a trainer: in phases, equal to one sequence after the other; other merges go the old way."""
    rng = random.Random(8)
    merges, made = [], ["A", "C", "G", "\u00e9"]
    while len(merges) < 90:
        a, b = rng.choice(made), rng.choice(made)
        if a + b not in made and len(a + b) < 9:
            merges.append((a, b))
            made.append(a + b)
    texts = ["".join(rng.choices(["A", "C", "G", "T", "\u00e9", "\U0001f600"], [9, 9, 9, 2, 2, 1], k=rng.randrange(0, 300))) for _ in range(60)] + ["", "A" * 41, "T"]
    ranks = {m: i for i, m in enumerate(merges)}
    m, t = T.Merges(merges), T.Letters(texts)
    assert len(m.phases) == 6 and not T.Merges(merges[::-1]).phases and not T.Merges(merges + merges[:1]).phases and not T.Merges(merges + [("A", "AA"), ("AA", "A")]).phases
    known = set(made[5:]) | {"T"}
    for chosen in (None, known):
        for text, got in zip(texts, _tokens(spark, T.bpe_encoder(spark, merges, chosen), texts), strict=True):
            assert [tuple(x) for x in got] == T.bpe(text, ranks, chosen)
    assert len(m.tokens(t)) - len(texts) == len(T.bpe_all(t, m))


@pytest.mark.parametrize("pieces", [1 << 22, 0])
@pytest.mark.parametrize("letters,length,size", [("ACGT", 12, 150), ("AAAAC", 24, 90), ("ACGTN", 10, 200)])
def test_phases_give_the_greedy_merges(spark, monkeypatch, letters, length, size, pieces):
    """Whole words are read twice a phase, pieces train in one task or in rounds; ties, runs of one letter, tokens made twice, copies."""
    reads, real, again = [], B.phase, []
    monkeypatch.setattr(B, "phase", lambda *a: reads.append(len(a[2])) or again.append(a[3]) or real(*a))
    monkeypatch.setattr(B, "PHASED", 0)
    monkeypatch.setattr(B, "PIECES", pieces)
    monkeypatch.setattr(B, "BLOCK", 1000)
    rng = random.Random(length)
    base = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(40)]
    words = ["".join(rng.choices(base, k=length)) for _ in range(300)]
    words += words[:40]
    if pieces:
        monkeypatch.setattr(B, "changes", None)  # no rounds
    got = B.train(spark.createDataFrame([(w,) for w in words], "w string"), "w", size, 20)
    assert got == _greedy(words, size, 20)
    made = [a + b for a, b in got[1]]
    assert sum(again) == len(made) - len(set(made)) or len(got[0]) == size
    assert len(reads) < 10 + sum(again)


def test_merges_of_many_words_at_once():
    rng = random.Random(4)
    for _ in range(100):
        words = [[rng.randint(1, 4) for _ in range(rng.randint(1, 12))] for _ in range(9)]
        pairs = dict.fromkeys((rng.randint(1, 4 + i), rng.randint(1, 4 + i)) for i in range(rng.randint(1, 8)))
        run = [(a, b, 5 + i) for i, (a, b) in enumerate(pairs) if max(a, b) < 5 + i]
        ids, many = B._ranked(np.array([x for w in words for x in w], np.uint16), np.array([len(w) for w in words]), run, 20)
        want = []
        for w in words:
            x = np.array([*w, 0], np.uint16)
            for step in run:
                x = B._merge(x, [step])
            want.append(x[:-1].tolist())
        assert ids.tolist() == [x for w in want for x in w] and many.tolist() == [len(w) for w in want]


def test_many_models_in_one_pass(spark):
    rng = random.Random(11)
    models = {m: {w: float(rng.randrange(1, 30)) for w in ["A", "C", "G"] + ["T"] * (m == "x") + ["".join(rng.choices("ACGT", k=rng.randrange(2, 6))) for _ in range(60)]} for m in "xyz"}
    texts = [("r%d" % (i % 3), "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randrange(0, 90)))) for i in range(200)] + [("r0", None), (None, "ACGT")]
    d = T.sweep_counts(spark.createDataFrame(texts, "region string, seq string").repartition(3), "seq", ["region"], models, -5.0)
    got = {(r["model"], r["region"], r["token"]): r["cnt"] for r in d.collect()}
    want = Counter()
    for m, scores in models.items():
        for region, text in texts:
            for w, _, _ in T.viterbi(text or "", scores, max(map(len, scores)), -5.0):
                want[m, region, w if w in scores else T.UNK] += 1
    assert got == dict(want)
    assert T.sweep_counts(spark.createDataFrame([], "region string, seq string"), "seq", ["region"], models, -5.0).collect() == []
