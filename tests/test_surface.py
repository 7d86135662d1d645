"""Slices of files, table functions, token streams."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from seqloom.functions import tables
from seqloom.operators import motifs as M
from seqloom.operators import tokenizers as T
from seqloom.sources import slices
from seqloom.streaming import token_stream


# --- slices
@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """103 rows in four files of unequal size, one of them empty, in a folder with a blank in its name."""
    at = str(tmp_path_factory.mktemp("a corpus") / "c")
    for lo, hi in ((0, 40), (40, 40), (40, 41), (41, 103)):
        d = spark.range(lo, hi).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
        d.coalesce(1).write.mode("append").parquet(f"{at}/p={lo:03d}{hi:03d}")
    return at


@pytest.mark.parametrize("spec, want", [
    ("train", range(103)), ("train[:]", range(103)), ("train[:5%]", range(5)), ("train[5%:]", range(5, 103)), ("train[39:42]", range(39, 42)),
    ("train[-3:]", range(100, 103)), ("train[:-100]", range(3)), ("train[-10%:]", range(93, 103)), ("train[50:20]", []), ("train[200:]", []),
    ("train[:1000]", range(103)), ("train[:2]+train[-2:]", [0, 1, 101, 102]), ("train[:2]+train[1:3]", [0, 1, 1, 2]),
])
def test_slices(spark, corpus, spec, want):
    d = slices.sliced(spark, corpus, spec)
    assert d.columns == ["id", "text", "p"]
    rows = d.collect()
    assert sorted(r.id for r in rows) == list(want)
    assert all(r.p is not None and r.text == f"t{r.id}" for r in rows)


def test_slices_read_only_the_files_they_touch(spark, corpus):
    assert len(slices.sliced(spark, corpus, "train[:10]").inputFiles()) == 1
    assert len(slices.sliced(spark, corpus, "train[40:41]").inputFiles()) == 1
    plan = slices.sliced(spark, corpus, "train[5%:]")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_slices_by_name(spark, corpus):
    assert slices.sliced(spark, {"train": corpus}, "train[:7]").count() == 7
    with pytest.raises(ValueError, match="no split 'test'"):
        slices.sliced(spark, {"train": corpus}, "test[:7]")
    for bad in ("train[5]", "train[a:b]", "", "train[:5%"):
        with pytest.raises(ValueError, match="no slice"):
            slices.sliced(spark, corpus, bad)


@given(st.lists(st.integers(0, 20), max_size=8), st.integers(0, 100), st.integers(0, 100))
def test_cuts_are_the_rows_between(rows, lo, hi):
    where = [(i, k) for i, n in enumerate(rows) for k in range(n)]
    assert [(i, k) for i, a, b in slices.cuts(rows, lo, hi) for k in range(a, b)] == where[lo:hi]


@given(st.integers(0, 10_000), st.integers(0, 100))
def test_head_and_tail_part_the_rows(n, p):
    assert 0 <= slices.border(f"{p}%", n, 0) <= n
    assert slices.border("0%", n, 0) == 0 and slices.border("100%", n, 0) == n


# --- table functions
def test_motifs_expand_as_the_operator_does(spark):
    tables.register(spark)
    m = spark.createDataFrame([("A*C",), ("***",), ("ACG",), ("*",), ("",), ("A******",), ("N*R*",)], "motif string")
    got = spark.sql("SELECT motif, variant FROM {m}, LATERAL expand_motif(motif, 5)", m=m)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.expand(m).collect()))
    assert spark.sql("SELECT * FROM expand_motif(CAST(NULL AS STRING), 5)").count() == 0


def test_labels_by_policy(spark):
    tables.register(spark)
    p = spark.createDataFrame([(1, "a", 0), (2, "a, b ,,b", 0), (3, "", 0), (4, None, 0), (5, " , ", 0)], "peak_id long, labels string, other int")

    def by(policy):
        a = spark.sql(f"SELECT peak_id, label FROM {{p}}, LATERAL expand_labels(labels, '{policy}')", p=p).collect()
        b = spark.sql(f"SELECT * FROM peak_labels(TABLE({{p}}), '{policy}')", p=p).collect()
        assert sorted(a) == sorted(b)
        return sorted(map(tuple, a))

    assert by("drop") == [(1, "a")]
    assert by("first") == [(1, "a"), (2, "a")]
    assert by("explode") == [(1, "a"), (2, "a"), (2, "b"), (2, "b")]
    with pytest.raises(PythonException, match="unknown policy"):
        by("other")


# --- streams
def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rows = lambda *x: spark.createDataFrame(list(x), "id long, seq string").coalesce(1)
    rows((1, "ACACGT"), (2, None)).write.parquet(src)
    decode = T.unigram_decoder(spark, {"A": 1.0, "C": 1.0, "AC": 4.0, "ACG": 9.0}, unk=-100.0)
    stream = lambda: token_stream.tokenized(token_stream.source(spark, src, 1), "seq", decode)
    assert token_stream.drained(stream(), out, mark).count() == 2
    rows((3, ""), (4, "AAC")).write.mode("append").parquet(src)
    got = token_stream.drained(stream(), out, mark)
    want = token_stream.tokenized(spark.read.parquet(src), "seq", decode)
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
    assert got.columns == ["id", "tokens"] and got.count() == 4
    assert token_stream.drained(stream(), out, mark).count() == 4


# --- packing
def test_packing_cuts_rows_at_block_borders(spark):
    from seqloom.operators import corpus as K

    n = [3, 0, 1, 17, None, 4, 5, 40, 2, 8]
    rows = [(i, None if k is None else [f"{i}.{j}" for j in range(k)]) for i, k in enumerate(n)]
    d = spark.createDataFrame(rows, "rank long, batch array<string>")
    want = []
    for b in range(0, len(rows), 4):
        flat = [x for _, t in rows[b : b + 4] for x in t or []]
        want += [(b // 4, i // 6, flat[i : i + 6]) for i in range(0, len(flat) - 5, 6)]
    assert sorted(map(tuple, K.pack(d, "rank", "batch", 6, 4).collect())) == want
