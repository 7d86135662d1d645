import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import bytewords, components, line_dedup, near_dedup, queries, vector_dedup


def union(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (7, None)]
    got = {x.id: x.component for x in components.connected(spark.createDataFrame(e, "u long, v long")).collect()}
    want = union(400, [(a, b) for a, b in e if b is not None])
    ends = {x for a, b in e if b is not None and a != b for x in (a, b)}
    assert got == {x: want[x] for x in ends}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_of_buffers():
    texts = ["A b\tb", None, "", " c", "d", "x" * 70_000 + " y", "Ünï\x00 Ü"]
    data, cuts = bytewords.buffer_of(pa.array(texts))
    s, e, h = bytewords.words(data, cuts)
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert [data[a:b].tobytes().lower() for a, b in zip(s, e, strict=True)] == want
    assert len(set(h.tolist())) == len(set(want)) and all(len({x for x, y in zip(h.tolist(), want, strict=True) if y == w}) == 1 for w in want)


# --- line dedup
def brute_lines(rows):
    """Removed line numbers and links per (id, text), as defined."""
    docs = sorted({(i if i is not None else 2**63 - 1, t or "") for i, t in rows})
    first, where = {}, []
    for d in docs:
        for n, line in enumerate(d[1].split("\n")):
            s = frozenset(line.encode().lower().split())
            if s:
                first.setdefault(s, (d, n))
                where.append((d, n, s))
    link = defaultdict(set)
    for a, b in itertools.combinations(first, 2):
        if 5 * len(a & b) >= 4 * len(a | b):
            link[a].add(b)
            link[b].add(a)
    out, links = defaultdict(set), Counter()
    for d, n, s in where:
        links[d] += len(link[s])
        if (d, n) > min([first[s], *(first[x] for x in link[s])]):
            out[d].add(n)
    return out, links


def test_line_dedup_against_brute_force(spark):
    r = random.Random(8)
    voc = [f"w{i}" for i in range(60)]
    lines = []
    for _ in range(250):
        if lines and r.random() < 0.6:
            x = list(r.choice(lines))
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = r.choice(voc)
        else:
            x = [r.choice(voc) for _ in range(r.choice([1, 2, 4, 5, 6, 9, 15, 30, 80]))]
        lines.append(x)
    rows = [(i, "\n".join(" ".join(r.choice(lines)) for _ in range(r.randrange(1, 6)))) for i in range(90)] + [(200, ""), (201, None), (None, " ".join(lines[0])), (202, "\n\n")]
    rows.append(rows[0])
    got = line_dedup.dedup(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_removed int, k1 int").drop("n_removed"), "doc_id", "text").collect()
    out, links = brute_lines(rows)
    assert len(got) == len(rows)
    src = {(r[0], len((r[1] or "").split("\n"))): r[1] for r in rows}
    for g in got:
        t = next(t for i, t in rows if i == g.doc_id)
        d = (g.doc_id if g.doc_id is not None else 2**63 - 1, t or "")
        want = "\n".join(x for n, x in enumerate(d[1].split("\n")) if n not in out[d])
        assert (g.text or "", g.n_removed, g.n_links, g.n_lines) == (want, len(out[d]), links[d], len(d[1].split("\n")))
    assert src


def test_line_dedup_cells_lose_nothing(spark, monkeypatch):
    """Small cells and cut lists give the same."""
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t{i % 7} u{i % 5}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.dedup(d, "doc_id", "text").collect()))
    for k, v in (("CELL_SETS", 5), ("LONG_LEVEL", 2), ("DENSE", 3)):
        monkeypatch.setattr(line_dedup, k, v)
    assert sorted(map(tuple, line_dedup.dedup(d, "doc_id", "text").collect())) == want
    assert want[0][-1] == 34 and all(x[3] == 1 for x in want[1:])


def test_line_dedup_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b\na b", 7, 8, 9)], "doc_id long, text string, n_removed int, removed int, N_LINES int")
    r = line_dedup.dedup(d, "doc_id", "text")
    assert r.columns == ["doc_id", "text", "removed", "n_lines", "n_removed", "n_links"] and tuple(r.first()) == (1, "a b", 8, 2, 1, 0)
    r = line_dedup.dedup(d, "doc_id", "text", counts=False)
    assert r.columns == d.columns and tuple(r.first()) == (1, "a b", 7, 8, 9)


def test_near_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b c", 7, 8, 9), (2, "a b c", 7, 8, 9)], "doc_id long, text string, __k1 int, k1 int, ID int")
    r = near_dedup.keep_one(d, "doc_id", "text")
    assert r.columns == d.columns and [tuple(x) for x in r.collect()] == [(1, "a b c", 7, 8, 9)]


def test_large_edge_tables_take_rounds(spark, monkeypatch):
    """Beyond the local bound the same components come out of star rounds, also for structs."""
    r = random.Random(3)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    d = spark.createDataFrame(e, "u long, v long")
    want = sorted(map(tuple, components.connected(d).collect()))
    s = d.select(F.struct("u", (F.col("u") * 2).alias("w")).alias("u"), F.struct(F.col("v").alias("u"), (F.col("v") * 2).alias("w")).alias("v"))
    local = sorted((x.id.u, x.component.u) for x in components.connected(s).collect())
    monkeypatch.setattr(components, "LOCAL_NUMBERS", 0)
    assert sorted(map(tuple, components.connected(d).collect())) == want == local
    assert sorted((x.id.u, x.component.u) for x in components.connected(s).collect()) == want


def test_words_that_share_the_top_of_their_hash():
    """Sets are told apart by all 64 bits."""
    top = np.uint64(0xABCDEF0123456789)
    h = np.array([top, top ^ np.uint64(1), top, 5, 5], np.uint64)
    line, w, _ = line_dedup.ordered_sets(h, np.array([0, 0, 0, 1, 1]))
    assert line.tolist() == [0, 0, 1] and sorted(w[:2].tolist()) == sorted(h[:2].tolist()) and w[2] == 5


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    r = line_dedup.dedup(odd_docs, "doc_id", "text").collect()
    assert len(r) == 12 and {x.text for x in r if x.doc_id == 6} == {""} and all(x.text is None for x in r if x.doc_id == 2)
    assert line_dedup.dedup(no_docs, "doc_id", "text").count() == 0


# --- near-duplicates
def bag(t):
    w = (t or "").encode().lower().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if w else [])


def brute_groups(texts):
    b = [bag(t) for t in texts]
    e = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = sum((b[i] & b[j]).values())
        if both and both >= 0.8 * (sum(b[i].values()) + sum(b[j].values()) - both) - 1e-9:
            e.append((i, j))
    return union(len(texts), e)


def near_texts(seed, n):
    r = random.Random(seed)
    voc = [f"v{i}" for i in range(400)]
    base = [[r.choice(voc) for _ in range(r.randrange(3, 200))] for _ in range(n // 5)]
    out = []
    for _ in range(n):
        x = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            x[r.randrange(len(x))] = r.choice(voc)
        out.append(" ".join(x))
    return out + ["rep rep rep " * 40, "rep rep rep " * 45, "a b", "A  b"]


def test_near_groups_against_brute_force(spark):
    texts = near_texts(3, 150)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    want = brute_groups(texts)
    got = {r.key: (r.class_id, r.kept) for r in near_dedup.group(d, "doc_id", "text").collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(want)) and all(v[1] == (k == v[0]) for k, v in got.items())
    kept = near_dedup.keep_one(d, "doc_id", "text")
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(want)


def test_near_groups_of_the_table(spark, sf01):
    """Class ids over all documents of the table equal those of comparing every pair that shares a shingle."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    ids = sorted(docs)
    bags = [bag(docs[i]) for i in ids]
    where = defaultdict(list)
    for i, b in enumerate(bags):
        for x, n in b.items():
            where[x].append((i, n))
    both = Counter()
    for own in where.values():
        for (i, a), (j, b) in itertools.combinations(own, 2):
            both[i, j] += min(a, b)
    size = [sum(b.values()) for b in bags]
    links = [(i, j) for (i, j), n in both.items() if n >= 0.8 * (size[i] + size[j] - n) - 1e-9]
    assert len(links) > 50
    got = {r.doc_id: r.class_id for r in queries.op6_bagminhash(spark, sf01).collect()}
    assert [got[i] for i in ids] == [ids[g] for g in union(len(ids), links)]


def test_cells_lose_nothing(spark, monkeypatch):
    """Without leaders every group comes out of the cells; cut small, too."""
    texts = near_texts(5, 80)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 4)
    assert {r.key: r.class_id for r in near_dedup.group(d, "doc_id", "text").collect()} == dict(enumerate(brute_groups(texts)))


def test_signatures_are_unbiased():
    r = random.Random(1)
    for n in (3, 30, 300):
        a = [r.randrange(n) for _ in range(200)]
        b = a[:120] + [r.randrange(n) for _ in range(90)]
        x, y = Counter(a), Counter(b)
        want = sum((x & y).values()) / sum((x | y).values())
        row = np.repeat([0, 1], [len(a), len(b)])
        sh = np.concatenate([np.sort(np.array(v, dtype=np.uint64) * np.uint64(2654435761)) for v in (a, b)])
        s = near_dedup.signatures(2, row, sh, 4096)
        assert np.isfinite(s).all() and (s[0] == s[1]).mean() == pytest.approx(want, abs=0.04)


def test_near_odd_rows(spark, odd_docs, no_docs):
    r = near_dedup.group(odd_docs, "doc_id", "text").collect()
    assert len(r) == 12 and {x.class_id for x in r if x.key == 6} == {1} and all(x.kept and x.class_id == x.key for x in r if x.key in (2, 3, 4))
    kept = near_dedup.keep_one(odd_docs, "doc_id", "text").collect()
    assert Counter(x.doc_id for x in kept) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 2, 7: 1, 8: 2})
    twice = odd_docs.filter("doc_id = 1").unionByName(odd_docs.filter("doc_id = 1"))
    assert near_dedup.keep_one(twice, "doc_id", "text").count() == 1
    assert near_dedup.group(no_docs, "doc_id", "text").count() == 0 and near_dedup.keep_one(no_docs, "doc_id", "text").count() == 0


# --- vectors
def test_vector_links_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 16))
    x = np.concatenate([x, x[:20] + 0.08 * r.normal(size=(20, 16)), x[:10] + 0.05 * r.normal(size=(10, 16)), x[:3], 5 * x[3:5]]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    want = union(len(x), np.argwhere(g).tolist())
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (None, [1.0] * 16), (904, []), (905, [float("inf")] * 16)]
    d = spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(x)] + [(i, v, "l") for i, v in bad], "vec_id long, embedding array<float>, root string")
    got = {q.key: q for q in vector_dedup.link(d, "vec_id", "embedding").collect()}
    assert len(got) == len(x) + len(bad)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(g[i].sum()), want[i], want[i] == i) for i in range(len(x))]
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad if i is not None)
    assert vector_dedup.link(d.limit(0), "vec_id", "embedding").count() == 0


def test_vector_lists_cut_in_chunks(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = (np.ones((60, 8)) + 0.02 * r.normal(size=(60, 8))).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 7)
    assert {(q.n_links, q.component_id) for q in vector_dedup.link(d, "vec_id", "embedding").collect()} == {(59, 0)}


def test_pivot_recall(spark):
    """Pairs at cosine 0.951 in 64 dimensions, among random vectors: at least 0.9 of the links are found."""
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = r.normal(size=x.shape)
    o -= (o * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<float>")
    found = vector_dedup.link(d, "vec_id", "embedding").agg(F.sum("n_links")).first()[0]
    assert found >= 0.9 * 2 * len(x)


def test_doubles_are_compared_as_doubles(spark):
    """A pair at cosine 0.95 but for 1e-9, on either side, in vectors of doubles; several dense groups; a list longer than its bound."""
    t = np.arccos(0.95)
    rows = [(i, [float(np.cos(x)), float(np.sin(x)), 0.0]) for i, x in enumerate((0.0, t - 1e-9, 2 * t, 3 * t + 1e-9))] + [(10, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = {q.key: (q.n_links, q.component_id) for q in vector_dedup.link(d, "id", "v").collect()}
    x = np.array([v for _, v in rows])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    g = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert [got[i][0] for i, _ in rows] == g.sum(1).tolist()


def test_dense_groups(spark, monkeypatch):
    r = np.random.default_rng(9)
    c = r.normal(size=(6, 32))
    x = np.concatenate([m + 0.02 * r.normal(size=(n, 32)) for m, n in zip(c, (40, 30, 25, 3, 2, 1), strict=True)] + [r.normal(size=(40, 32))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = union(len(x), np.argwhere(g).tolist())
    for rows in (4096, 9):
        monkeypatch.setattr(vector_dedup, "LIST_ROWS", rows)
        got = {q.key: (q.n_links, q.component_id) for q in vector_dedup.link(d, "id", "v").collect()}
        assert [got[i] for i in range(len(x))] == [(int(g[i].sum()), want[i]) for i in range(len(x))]


def test_queries_carry_ids(spark, sf):
    assert {"doc_id", "class_id", "kept"} <= set(queries.op6_bagminhash(spark, sf).columns)
