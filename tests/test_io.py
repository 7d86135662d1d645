"""Readers and writers on small files; the streaming bins."""

import json

import pytest
from pyspark.sql import functions as F

from seqloom.sources import readers as R
from seqloom.sources import writers as W
from seqloom.streaming.signal_stream import replay, stream_bins


def put(p, text):
    p.write_text(text)
    return str(p)


def test_bedgraph(spark, tmp_path):
    f = put(tmp_path / "chr1.bedGraph", "chr1\t0\t1\t0.5\nchr1\t1\t2\t0.25\textra\nchr2\t5\t6\t1.0\n")
    assert R.bedgraph(spark, f).count() == 2 and R.skipped(spark, f) == 1 and R.bedgraph(spark, f, chrom="chr2").count() == 1
    with pytest.raises(Exception):  # noqa: B017, PT011
        R.bedgraph(spark, f, strict=True).collect()


def test_fasta(spark, tmp_path):
    f = put(tmp_path / "a.fa", ">one x\nACgt\nNNA\n\n>two\nTT\n")
    assert sorted((r.header, r.seq) for r in R.fasta(spark, f).collect()) == [("one x", "ACgtNNA"), ("two", "TT")]
    assert sorted(r.seq for r in R.fasta_clean(spark, f).collect()) == ["ACGTA", "TT"]


def test_bed_and_bounds(spark, tmp_path):
    f = put(tmp_path / "a.bed", "#c\nchr1\t0\t5\nchr1\t5\t5\nchrM\t0\t9\nchr2\tx\t9\nchr3\t1\n")
    assert [tuple(r) for r in R.bed(spark, f).collect()] == [("chr1", 0, 5)]
    f = put(tmp_path / "b.tsv", "chrom min max\nchr1 1 5\nbad\nchr1 2 9\n")
    assert [tuple(r) for r in R.bounds(spark, f).collect()] == [("chr1", 2, 9)]


def test_segments_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("chr1", 0, 100, "neutral"), ("chr2", 0, 100, "conserved")], "chrom string, genomic_start long, genomic_end long, category string")
    W.segments(d, str(tmp_path / "s"))
    assert sorted(map(tuple, R.segments(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, d.collect()))
    with pytest.raises(ValueError):
        R.segments(spark, put(tmp_path / "x.csv", "a,b\n1,2\n"))


def test_examples_by_arity(spark, tmp_path):
    assert R.examples(spark, put(tmp_path / "2.csv", "text,label\nAC,1\n")).first().label == 1
    assert R.examples(spark, put(tmp_path / "3.csv", "a,b,label\nAC,GT,0\n")).first().text.text2 == "GT"
    assert R.examples(spark, put(tmp_path / "5.csv", "l,b,c,d,text\n7,x,y,z,AC\n")).first().label == 7
    with pytest.raises(ValueError):
        R.examples(spark, put(tmp_path / "4.csv", "a,b,c,d\n1,2,3,4\n"))


def test_other_readers(spark, tmp_path):
    assert R.manifest(spark, put(tmp_path / "m.csv", "﻿scale,model\ns,m\n"), ["scale", "model"]).count() == 1
    assert [tuple(r) for r in R.words(spark, put(tmp_path / "w.txt", "A\n\nC\n")).collect()] == [(0, "A"), (2, "C")]
    assert R.tokenizer(spark, put(tmp_path / "t.json", json.dumps({"model": {"vocab": {"A": 0}, "merges": []}})))["kind"] == "bpe"
    assert sorted(r.motif for r in R.motifs(spark, put(tmp_path / "mo.txt", "acx name\n\nA*T\nac\n"), 2).collect()) == ["A*T", "AC"]
    assert R.corpus(spark, put(tmp_path / "c.tsv", "a\tb\n1\t2\n")).columns == ["a", "b"]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a,b", "x")], "text string, label string")
    W.csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().text == "a,b"
    W.two_column_tsv(d, str(tmp_path / "t"), "text", "label")
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a,b\tx"
    W.jsonl(d, str(tmp_path / "j"))
    W.once(d, str(tmp_path / "o"))
    W.once(d.limit(0), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1 and W.index(spark, str(tmp_path / "o")).count() > 0
    W.bed(spark.createDataFrame([("chr1", 0, 5, "k")], "chrom string, start long, end long, kind string"), str(tmp_path / "b"), "kind")
    assert R.bed(spark, str(tmp_path / "b" / "kind=k")).count() == 1


def test_unquoted_csv(spark, tmp_path):
    d = spark.createDataFrame([("a,b", 1), (None, 2)], "text string, n int")
    W.unquoted_csv(d, str(tmp_path / "u"), ["text", "n"])
    assert sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "u")).collect()) == [",2", "a,b,1", "text,n"]


def test_json_once(spark, tmp_path):
    d = spark.createDataFrame([("k", 0.5)], "name string, value double")
    W.json_once(d, str(tmp_path / "m"))
    W.json_once(d.limit(0), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().value == 0.5


def test_fasta_once(spark, tmp_path):
    d = spark.createDataFrame([("a 1", "ACG"), ("b", "T")], "header string, seq string")
    W.fasta_once(d, str(tmp_path / "f"))
    W.fasta_once(d.limit(0), str(tmp_path / "f"))
    assert sorted((r.header, r.seq) for r in R.fasta(spark, str(tmp_path / "f")).collect()) == [("a 1", "ACG"), ("b", "T")]


def test_stream_equals_batch(spark, sf, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(src)
    q = stream_bins(replay(spark, src, spark.read.parquet(src)._jdf.schema().toDDL())).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    try:
        q.processAllAvailable()
        got = {(r.chrom, r.genomic_start): round(r.binned_score, 9) for r in spark.table("bins").collect()}
    finally:
        q.stop()
    from seqloom.operators.signal import bins
    from seqloom.plans.bindings import signal

    want = {(r.chrom, r.genomic_start): round(r.binned_score, 9) for r in bins(signal(spark, sf), 3600).collect()}
    assert got == want


def test_bedgraph_keeps_its_malformed_lines(spark, tmp_path):
    (tmp_path / "a.bedgraph").write_text("chr1\t0\t5\t1.5\n\nchr1\tx\t5\t1\nchr2\t5\t9\t-2\textra\nchr2\t5\t9\t-2\n")
    (tmp_path / "b.bedgraph").write_text("chr3\t1\t2\t0.25\n\t1\t2\t3\nshort\n")
    good, bad, n = R.bedgraph_checked(spark, str(tmp_path / "*.bedgraph"))
    assert sorted(map(tuple, good.collect())) == [("chr1", 0, 5, 1.5), ("chr2", 5, 9, -2.0), ("chr3", 1, 2, 0.25)] == sorted(map(tuple, R.bedgraph(spark, str(tmp_path / "*.bedgraph")).collect()))
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in bad.collect()) == [("a.bedgraph", "chr1\tx\t5\t1"), ("a.bedgraph", "chr2\t5\t9\t-2\textra"), ("b.bedgraph", "\t1\t2\t3"), ("b.bedgraph", "short")]
    assert n == {"good": 3, "malformed": 4}


def test_entry_tells_absence_from_faults(monkeypatch):
    import importlib

    import __spark_entry__ as e

    def missing(name):
        def load(_):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

        return load

    monkeypatch.setattr(importlib, "import_module", missing("seqloom.llm"))
    assert e._modules() == []
    monkeypatch.setattr(importlib, "import_module", missing("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        e._modules()
