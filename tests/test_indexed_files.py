"""bigWig files and indexed FASTA: every form of section, pruning by the trees, bytes that are read, errors."""

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.sources import bigwig, fasta_index, readers

ROWS = [("chr1", 0, 10, 1.5), ("chr1", 10, 12, -2.0), ("chr1", 500, 501, 0.25), ("chr2", 7, 9, 3.0), ("chr2", 9, 11, 4.0), ("chr2", 100, 110, 5.0), ("chr2", 120, 130, 6.0)]


def by_hand(order, packed, per_leaf=1):
    """A file with the rows above in sections of all three kinds, two-level trees, written field by field."""
    pack = lambda f, *x: struct.pack(order + f, *x)
    sections = [
        (0, 0, 12, pack("IIIIIBBH", 0, 0, 12, 0, 0, 1, 0, 2) + pack("IIf", 0, 10, 1.5) + pack("IIf", 10, 12, -2.0)),
        (0, 500, 501, pack("IIIIIBBH", 0, 500, 501, 0, 1, 2, 0, 1) + pack("If", 500, 0.25)),
        (1, 7, 11, pack("IIIIIBBH", 1, 7, 11, 2, 2, 3, 0, 2) + pack("ff", 3.0, 4.0)),
        (1, 100, 130, pack("IIIIIBBH", 1, 100, 130, 0, 10, 2, 0, 2) + pack("If", 100, 5.0) + pack("If", 120, 6.0)),
    ]
    out = io.BytesIO()
    out.write(bytes(64))
    leaves = []
    for c, s, e, data in sections:
        data = zlib.compress(data) if packed else data
        leaves.append((c, s, c, e, out.tell(), len(data)))
        out.write(data)
    chroms = out.tell()
    out.write(pack("IIIIQQ", 0x78CA8C91, 1, 5, 8, 2, 0))
    out.write(pack("BBH", 0, 0, 2) + b"chr1\0" + pack("Q", chroms + 32 + 30) + b"chr2\0" + pack("Q", chroms + 32 + 47))
    out.write(pack("BBH", 1, 0, 1) + b"chr1\0" + pack("II", 0, 1000) + pack("BBH", 1, 0, 1) + b"chr2\0" + pack("II", 1, 900))
    index = out.tell()
    out.write(pack("IIQIIIIQII", 0x2468ACE0, 4, 4, 0, 0, 1, 130, index, 1, 0))
    groups = [leaves[i : i + per_leaf] for i in range(0, 4, per_leaf)]
    at = index + 48 + 4 + 24 * len(groups)
    out.write(pack("BBH", 0, 0, len(groups)))
    for g in groups:
        out.write(pack("IIIIQ", g[0][0], g[0][1], g[-1][2], g[-1][3], at))
        at += 4 + 32 * len(g)
    for g in groups:
        out.write(pack("BBH", 1, 0, len(g)) + b"".join(pack("IIIIQQ", *x) for x in g))
    out.seek(0)
    out.write(pack("IHHQQQHHQQIQ", 0x888FFC26, 4, 0, chroms, 64, index, 0, 0, 0, 0, 4096 if packed else 0, 0))
    return out.getvalue()


@pytest.mark.parametrize("order,packed,per_leaf", [("<", True, 1), (">", True, 2), ("<", False, 4), (">", False, 1)])
def test_bigwig_gives_the_rows_of_its_bedgraph(spark, tmp_path, order, packed, per_leaf):
    (tmp_path / "a.bw").write_bytes(by_hand(order, packed, per_leaf))
    (tmp_path / "a.bedgraph").write_text("".join(f"{c}\t{s}\t{e}\t{v}\n" for c, s, e, v in ROWS))
    d = bigwig.scan(spark, str(tmp_path / "a.bw"))
    assert d.columns == ["chrom", "start", "end", "score"]
    assert sorted(d.collect()) == sorted(readers.bedgraph(spark, str(tmp_path / "a.bedgraph")).collect())
    assert sorted(map(tuple, bigwig.scan(spark, str(tmp_path / "a.bw"), "chr2", 8, 101).collect())) == ROWS[3:6]
    assert bigwig.scan(spark, str(tmp_path / "a.bw"), "chr9").collect() == []
    with pytest.raises(ValueError, match="needs a chrom"):
        bigwig.scan(spark, "a.bw", start=5)


def test_a_file_of_another_kind_is_refused(spark, tmp_path):
    (tmp_path / "a.bw").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="no bigWig file"):
        bigwig.scan(spark, str(tmp_path / "a.bw")).collect()


def deep(path, n=5000):
    """A file with an index of several levels: a row a section, three children a node."""
    s = np.arange(n, dtype=np.int64) * 10
    batches = [pa.RecordBatch.from_arrays([pa.array([c] * n), pa.array(s), pa.array(s + 7), pa.array(s / 2.0)], ["chrom", "start", "end", "score"]) for c in ("a", "bb")]
    with open(path, "wb") as f:
        assert bigwig.packed_into(f, iter(batches), items=1, children=3) == 2 * n


def test_only_the_asked_part_of_the_file_is_read(tmp_path, monkeypatch):
    path = str(tmp_path / "deep.bw")
    deep(path)
    read = []
    real = bigwig.File.at
    monkeypatch.setattr(bigwig.File, "at", lambda self, o, n: read.append(n) or real(self, o, n))

    def scan(r, many=8):
        read.clear()
        x = bigwig.Reader(path, r, many)
        parts = x.partitions()
        rows = sum((b.to_pylist() for p in parts for b in x.read(p)), [])
        return parts, [(r["chrom"], r["start"]) for r in rows], sum(read)

    parts, rows, whole = scan(bigwig.Range())
    assert len(rows) == len(set(rows)) == 10_000 and 4 <= len(parts) <= 9 and rows == sorted(rows)
    _, rows, some = scan(bigwig.Range("bb", 20_000, 20_095))
    assert rows == [("bb", x) for x in range(20_000, 20_100, 10)]
    assert some < whole / 50
    _, rows, _ = scan(bigwig.Range("a", 6, 11))
    assert rows == [("a", 0), ("a", 10)]
    assert scan(bigwig.Range("a", 7, 10))[1] == []  # between two rows


def test_filters_of_the_plan_reach_the_tree(spark, tmp_path):
    path = str(tmp_path / "deep.bw")
    deep(path, 300)
    r = bigwig.PushingReader(path, bigwig.Range(), 4)
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

    left = list(r.pushFilters([EqualTo(("chrom",), "bb"), GreaterThan(("end",), 100), LessThan(("start",), 200), IsNotNull(("score",))]))
    assert len(left) == 4 and r.range == bigwig.Range("bb", 100, 200)
    spark.conf.set(bigwig.PUSHDOWN, "true")
    try:
        d = bigwig.scan(spark, path).filter("chrom = 'bb' AND `end` > 100 AND start < 200 AND score > 50")
        want = bigwig.scan(spark, path).collect()
        assert sorted(d.collect()) == sorted(x for x in want if x["chrom"] == "bb" and x["end"] > 100 and x["start"] < 200 and x["score"] > 50)
    finally:
        spark.conf.unset(bigwig.PUSHDOWN)


def test_bigwig_round_trip(spark, tmp_path):
    d = spark.range(20_000).select(F.concat(F.lit("chr"), F.col("id") % 3).alias("chrom"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 1 + F.col("id") % 4).alias("end"), (F.col("id") / 8).alias("score"))
    path = str(tmp_path / "out")
    bigwig.write(d, path, 5)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 5 and all(n.startswith("part-") for n in names)
    assert sorted(bigwig.scan(spark, path).collect()) == sorted(d.collect())
    assert bigwig.scan(spark, path + "/part-0000[01]*.bw").count() < 20_000
    assert bigwig.scan(spark, path, "chr1", 100, 200).count() == d.filter("chrom = 'chr1' AND `end` > 100 AND start < 200").count()


def test_bigwig_of_nothing_and_of_bad_rows(spark, tmp_path):
    none = spark.createDataFrame([], bigwig.SCHEMA)
    bigwig.write(none, str(tmp_path / "none"))
    assert bigwig.scan(spark, str(tmp_path / "none")).collect() == []
    bad = spark.createDataFrame([("a", 0, 10, 1.0), ("a", 5, 12, 1.0)], bigwig.SCHEMA)
    with pytest.raises(Exception, match="overlap"):
        bigwig.write(bad, str(tmp_path / "bad"), 1)
    assert not [p for p in tmp_path.glob("bad/*") if p.name.startswith("part")]


# --- FASTA
TEXT = {"c1": "ACGTacgtNNACGTTTGA", "c2": "G", "c3": "", "long": "ACGT" * 60_000}


def fasta(path, width, ending):
    at, index, out = 0, [], b""
    for name, seq in TEXT.items():
        out += f">{name} about it".encode() + ending
        at = len(out)
        for i in range(0, len(seq), width):
            out += seq[i : i + width].encode() + ending
        index.append(f"{name}\t{len(seq)}\t{at}\t{width}\t{width + len(ending)}\n")
    path.write_bytes(out)
    (path.parent / (path.name + ".fai")).write_text("".join(index))
    return str(path)


@pytest.mark.parametrize("width,ending", [(5, b"\n"), (7, b"\r\n"), (100_000, b"\n")])
def test_intervals_by_arithmetic(spark, tmp_path, width, ending):
    path = fasta(tmp_path / "a.fa", width, ending)
    rows = [("c1", s, e) for s in range(18) for e in range(s + 1, 19)] + [("c2", 0, 1), ("long", 0, 240_000), ("long", 239_990, 240_000), ("c1", 0, 18), ("c1", 0, 18)]
    bad = [("c1", -1, 3), ("c1", 0, 19), ("c1", 4, 4), ("c1", 5, 4), ("c3", 0, 1), ("nope", 0, 1), (None, 0, 1), ("c1", None, 4), ("c1", 1, None)]
    d = spark.createDataFrame([(c, s, e, i, "x") for i, (c, s, e) in enumerate(rows + bad)], "chrom string, start long, end long, at long, File string").repartition(4)
    got = {r["at"]: r for r in fasta_index.fetch(d, fasta_index.read_index(spark, path)).collect()}
    assert len(got) == len(rows) + len(bad)
    for i, (c, s, e) in enumerate(rows):
        assert got[i]["seq"] == TEXT[c][s:e] and got[i]["reason"] is None and got[i]["File"] == "x"
    assert [got[len(rows) + i]["reason"] for i in range(len(bad))] == ["range"] * 5 + ["name", "name", "range", "range"]
    assert all(got[len(rows) + i]["seq"] is None for i in range(len(bad)))


def test_one_based_and_strict(spark, tmp_path):
    index = fasta_index.read_index(spark, fasta(tmp_path / "a.fa", 5, b"\n"))
    one = lambda *r: spark.createDataFrame([r], "chrom string, start long, end long")
    assert fasta_index.fetch(one("c1", 1, 4), index, strict=True, one_based=True).first()["seq"] == "ACGT"
    assert fasta_index.fetch(one("c1", 18, 18), index, one_based=True).first()["seq"] == "A"
    with pytest.raises(Exception, match="no such sequence: zz"):
        fasta_index.fetch(one("zz", 1, 4), index, strict=True).collect()
    with pytest.raises(Exception, match="no such range: c1:0-4"):
        fasta_index.fetch(one("c1", 0, 4), index, strict=True, one_based=True).collect()
    with pytest.raises(Exception, match="(?i)path"):
        fasta_index.read_index(spark, str(tmp_path / "b.fa")).collect()


def test_reads_follow_the_intervals():
    offset, size = np.array([10, 20, 25, 200_000, 200_010, 900_000]), np.array([15, 5, 3, 5, 100, 1])
    got = list(fasta_index.ranges(offset, size))
    assert [(o, n) for o, n, _ in got] == [(10, 18), (200_000, 110), (900_000, 1)]
    assert [list(range(6))[s] for _, _, s in got] == [[0, 1, 2], [3, 4], [5]]
    many = list(fasta_index.ranges(np.arange(0, 1 << 26, 1 << 15), np.full(1 << 11, 1 << 15)))
    assert len(many) == (1 << 26) // fasta_index.READ and max(n for _, n, _ in many) <= fasta_index.READ


def test_written_fasta_is_read_by_its_index(spark, tmp_path):
    d = spark.createDataFrame(list(TEXT.items()), "name string, seq string").repartition(3)
    index = fasta_index.write_indexed(d, str(tmp_path / "out"), 11).persist()
    iv = spark.createDataFrame([("c1", 3, 17), ("long", 100, 150_000), ("c2", 0, 1)], "chrom string, start long, end long")
    got = {r["chrom"]: r["seq"] for r in fasta_index.fetch(iv, index).collect()}
    assert got == {"c1": TEXT["c1"][3:17], "long": TEXT["long"][100:150_000], "c2": "G"}
    parsed = {r["header"]: r["seq"] for r in readers.fasta(spark, str(tmp_path / "out")).collect()}
    assert parsed == TEXT
    index.unpersist()
