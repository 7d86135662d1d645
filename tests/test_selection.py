"""Exact medians, reservoirs, equi-depth overlap joins, ranks: against plain versions, with crowded groups and clashing names."""

import math
import random
from collections import Counter
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import corpus as K
from seqloom.operators import intervals as I
from seqloom.operators import selection as S
from seqloom.operators import stats as A


def test_medians_of_all_sizes(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 5), 1.5, -0.0, 0.0]), rng.random()) for _ in range(4000)]
    rows += [(f"g{rng.randrange(40)}", rng.choice([None, float("nan"), rng.gauss(0, 1), 2.0]), float(rng.randrange(3))) for _ in range(900)]
    rows += [(None, 3.0, 1.0), (None, 5.0, None), ("one", -7.25, None), ("none", None, None), ("inf", math.inf, 1.0), ("inf", 4.0, 2.0)]
    d = spark.createDataFrame(rows, "n string, v double, m double").repartition(6)
    got = {r["n"]: (r["part"], r["s"]) for r in S.medians(d, ["n"], {"part": F.col("v"), "s": F.col("m")}).collect()}
    for key in {r[0] for r in rows} - {"none"}:
        for i in (1, 2):
            x = [r[i] for r in rows if r[0] == key and r[i] is not None and not math.isnan(r[i])]
            want = median(x) if x else None
            assert got[key][i - 1] == want or abs(got[key][i - 1] - want) < 1e-12
    assert "none" not in got  # a group without any value: the caller's left join makes it null
    assert S.medians(d.limit(0), ["n"], {"x": F.col("v")}).collect() == []


def test_a_crowded_group_is_many_ranges(spark):
    d = spark.range(50_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 50_000).alias("x"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        c = d.groupBy("g", "x").count().repartitionByRange("g", "x").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in c.groupBy("p").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 0.5 * 50_000
        assert S.medians(d, ["g"], {"m": F.col("x")}).collect()[0]["m"] == 24_999.5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_reservoir_is_uniform(spark):
    """Chi-square over many seeds of one reservoir, and of several that are merged."""
    import pyarrow as pa

    hits = np.zeros(60)
    for seed in range(3000):
        r = S.Reservoir(6, np.random.default_rng(seed))
        for lo in range(0, 60, 7):
            r.add(pa.RecordBatch.from_pydict({"x": list(range(lo, min(60, lo + 7)))}))
        got = [b.column(0)[0].as_py() for b in r.rows]
        assert len(set(got)) == 6
        hits[got] += 1
    expected = 3000 * 6 / 60
    assert ((hits - expected) ** 2 / expected).sum() < 110  # 59 degrees of freedom: beyond the 0.9999 quantile
    take = np.array([S._drawn(np.array([50, 30, 20]), 10, np.random.default_rng(s)) for s in range(4000)])
    assert (take.sum(1) == 10).all() and np.abs(take.mean(0) - [5, 3, 2]).max() < 0.1


def test_reservoir_sample(spark):
    d = spark.range(1000).select("id", F.lit("x").alias("part"), F.col("id").cast("string").alias("Slot"), (F.col("id") * 2).alias("seen"))
    uneven = d.filter("id < 900").coalesce(1).unionByName(d.filter("id >= 900").repartition(3, "id"))
    seen = Counter()
    for seed in range(12):
        got = S.reservoir_sample(uneven, 100, seed)
        rows = got.collect()
        assert got.columns == d.columns and len(rows) == len({r["id"] for r in rows}) == 100
        assert all(r["seen"] == 2 * r["id"] and r["Slot"] == str(r["id"]) for r in rows)
        seen.update(r["id"] < 900 for r in rows)
    assert 1020 < seen[True] < 1140  # 1,080 expected
    assert sorted(S.reservoir_sample(uneven, 100, 3).collect()) == sorted(S.reservoir_sample(uneven, 100, 3).collect())
    assert S.reservoir_sample(d, 5000).count() == 1000 and S.reservoir_sample(d, 0).count() == 0 and S.reservoir_sample(d.limit(0), 5).count() == 0


def _pairs(a, b):
    return sorted((x[3], y[3], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]))


@pytest.mark.parametrize("slices", [2, 16, 128])
def test_overlaps_with_half_the_intervals_in_one_place(spark, slices):
    rng = random.Random(slices)
    spot = lambda i: ("c1", 5000, 5000 + rng.randrange(0, 9), i)
    wide = lambda i: (rng.choice(["c1", "c2", "c3"]), s := rng.randrange(100_000), s + rng.choice([0, 1, 50, 40_000]), i)
    a = [spot(i) if i % 2 else wide(i) for i in range(800)]
    b = [spot(i) if i % 3 == 0 else wide(i) for i in range(60)]
    schema = "chrom string, start long, end long, slice long"
    da, db = (spark.createDataFrame([*x, ("c1", None, 5, -1), (None, 1, 5, -1), ("c1", 3, None, -1)], schema).repartition(3) for x in (a, b))
    j = I.overlap_join(da, db, slices=slices)
    assert j.columns == ["chrom", "start", "end", "slice", "b_start", "b_end", "b_slice", "o_start", "o_end"]
    assert sorted((r["slice"], r["b_slice"], r["o_start"], r["o_end"]) for r in j.collect()) == _pairs(a, b)
    met = {x[0] for x in _pairs(a, b)}
    assert {r["slice"] for r in I.overlap_join(da, db, "left_semi", slices).collect()} == met
    assert {r["slice"] for r in I.overlap_join(da, db, "left_anti", slices).filter("slice >= 0").collect()} == {x[3] for x in a} - met


def test_ranks_keep_columns_of_any_name(spark):
    d = spark.createDataFrame([(i, i * 7 % 50, f"n{i}", f"o{i}", "t") for i in range(50)], "id long, x long, n string, off string, total string")
    out = K.numbered(d, "x")
    assert set(out.columns) == {*d.columns, "rank"} and all(r["rank"] == r["x"] + 1 and r["off"] == f"o{r['id']}" for r in out.collect())
    p = d.withColumn("p", (F.col("x") + 1) / 51.0)
    q = A.bh_large(p, "p", "id")
    assert q.columns == [*p.columns, "q"]
    want = {r["id"]: r["q"] for r in A.bh(p, "p", "id").collect()}
    assert all(abs(r["q"] - want[r["id"]]) < 1e-12 and r["n"] == f"n{r['id']}" for r in q.collect())
