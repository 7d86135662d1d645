import os

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom.llm import license_rules, licenses, queries, revisits

REC = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>, key string, slice int"


def rec(i, url, ts, kind, etag=None, lm=None, headers=()):
    return (i, url, ts, kind, etag, lm, [tuple(h) for h in headers] if headers is not None else None, "clash", 9)


def resolved(spark, rows):
    return {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, REC)).collect()}


def test_latest_earlier_response(spark):
    u = "http://www.Example.com:80/a/?utm_source=x#t"
    rows = [
        rec(1, "https://example.com/a", 10, "response", '"v1"', None, [("ETag", '"v1"'), ("Content-Type", "text/html"), ("X", "1")]),
        rec(2, "https://example.com/a", 20, "response", 'W/"v2"', "mon"),
        rec(3, "https://example.com/a", 20, "response", '"v2"', "mon"),  # tie: the larger id
        rec(10, u, 15, "revisit", '"v1"', None, [("X", "2"), ("Content-Length", "0"), ("Age", "3")]),
        rec(11, u, 20, "revisit", '"v1"'),  # equal time is not earlier
        rec(12, u, 30, "revisit", 'W/"v2"'),
        rec(13, u, 30, "revisit", '"other"', None, [("A", "b")]),
        rec(14, u, 30, "revisit", None, "mon"),
        rec(15, u, 30, "revisit", None, None, None),
        rec(16, u, 5, "revisit", '"v1"'),
        rec(17, None, 30, "revisit", '"v1"'),
        rec(18, u, None, "revisit", '"v1"'),
        rec(19, u, 30, None, '"v1"'),
    ]
    got = resolved(spark, rows)
    want = {10: (1, "resolved"), 11: (1, "resolved"), 12: (3, "resolved"), 13: (None, "validator-mismatch"), 14: (3, "resolved"), 15: (3, "unvalidated"), 16: (None, "no-earlier-response"), 17: (None, "no-url"), 18: (None, "no-earlier-response")}
    assert {k: (v.refers_to, v.outcome) for k, v in got.items()} == want
    assert [(h["name"], h["value"]) for h in got[10].headers] == [("ETag", '"v1"'), ("Content-Type", "text/html"), ("X", "2"), ("Age", "3")]
    assert [(h["name"], h["value"]) for h in got[13].headers] == [("A", "b")] and got[15].headers == []
    body = spark.createDataFrame([(1, "b1"), (3, "b3")], "record_id long, p string")
    full = revisits.with_payload(revisits.resolve(spark.createDataFrame(rows, REC)), body, "p")
    assert {r.record_id: r.payload for r in full.collect() if r.payload} == {10: "b1", 11: "b1", 12: "b3", 14: "b3", 15: "b3"}


def test_hot_url_over_slices(spark):
    """One key over all partitions: carried from slice to slice."""
    rows = [rec(0, "http://h/x", 0, "response", '"e"')] + [rec(i, "http://h/x", i, "revisit", '"e"') for i in range(1, 400)]
    assert {r.refers_to for r in resolved(spark, rows).values()} == {0}


def test_empty_records(spark):
    assert resolved(spark, []) == {}


def test_canonical_forms(spark):
    urls = ["http://u:p@WWW2.host.org./p//?b=2&a=1&gclid=9", "https://host.org:443/p?a=1&b=2", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(revisits.canonical_url(F.col("u"))).collect()]
    assert got == ["host.org/p?a=1&b=2", "host.org/p?a=1&b=2", None, None]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    p = f"{sf}/pages.parquet"
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    d = queries.op1_resolve_revisits(spark, sf)
    assert sorted(map(tuple, d.select(sorted(d.columns)).collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(sorted(d.columns))} FROM ({queries.OP1_SQL})").fetchall(), key=str)


# --- licences
def labels(text):
    return licenses.scan_text(text.encode(), {k.encode(): v for k, v in licenses.BASE.items()})


@pytest.mark.parametrize(("text", "base", "own"), [
    ("Licensed under the Apache License, Version 2.0.", "", {"apache-2.0"}),
    ("Licensed under CC BY-NC 4.0.", "cc-by", {"cc-by-nc-4.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl", {"gpl-3.0"}),
    ("All rights reserved. Released under the MIT License.", "reserved", {"mit", "all-rights-reserved"}),
    ("GNU Lesser General Public License v2.1 or LGPL-3.0", "gpl", {"lgpl-2.1", "lgpl-3.0"}),
    ("Alle Rechte vorbehalten; tous droits réservés", "", {"all-rights-reserved"}),
    ("nothing here", "", set()),
])
def test_labels(text, base, own):
    r = labels(text)
    assert r[4] == base and own <= set(r[5].split(",")) and (r[6] > 0) == bool(own)


def test_contained_detections_are_suppressed():
    assert {d["label"] for d in labels("gnu general public license version 3")[7]} == {"gpl-3.0"}
    assert licenses.suppress([(0, 5, 50, "a"), (1, 4, 60, "b"), (1, 3, 60, "c"), (0, 5, 50, "a")]) == [(0, 5, 50, "a"), (1, 4, 60, "b")]


def test_places_overlap_and_edges():
    r = labels("cc by cc by, CC-BY ccby")
    assert r[:4] == (7, 3, 0, 4)
    w = b"a b a b a".split()
    assert licenses.places(b" " + b" ".join(w) + b" ", b"a b a") == [0, 2]


def test_gates_are_in_their_matches():
    """A rule's gate occurs in what its regex needs: no rule is dead."""
    lines = license_rules.RULES.strip().splitlines()
    assert len(lines) >= 200 and all(len(x.split(" ; ")) == 4 for x in lines)


def test_scan_of_odd_rows(spark, odd_docs, no_docs):
    r = licenses.scan(odd_docs.withColumn("labels", F.lit(1)), "doc_id", "text").collect()
    assert len(r) == 12 and all(x.n_base == 0 and x.first_word is None and x.labels == "" and x.score == 0 for x in r)
    assert sorted(x.n_words for x in r)[-1] == 20000
    assert licenses.scan(no_docs, "doc_id", "text").count() == 0


def test_scan_against_brute_force(spark, sf):
    import re

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in queries.op7_license_scan(spark, sf).collect()}
    for r in d.collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower())
        p = sorted((i, v) for k, v in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(k.split())] == k.encode().split())
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({v for _, v in p})))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) | {""}


def test_suppression_against_all_pairs():
    import random

    from seqloom.llm import licenses

    r = random.Random(1)
    for _ in range(2000):
        found = [(a, a + r.randrange(1, 9), r.randrange(3), r.choice("xy")) for a in (r.randrange(20) for _ in range(r.randrange(15)))]
        kept = []
        for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert licenses.suppress(found) == sorted(kept)
