"""Operators 11 to 13: the queries against DuckDB, brute force on odd rows, pruning, rules of every form."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from seqloom.llm import lexical, queries, url_rules, variants

ODD_NAMES = "Rank string, TOKEN string, item string, host string, row string, low string, id long, n string, key string, own string"


def duck(sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in q.description]
    rows = q.fetchall()
    return sorted(map(str, (tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows)))


@pytest.mark.parametrize("name", ["op11_maxscore", "op12_url_rules", "op13_spelling_variants"])
def test_query(spark, sf, name):
    d = queries.queries()[name](spark, sf)
    assert sorted(map(str, map(tuple, d.select(*sorted(d.columns)).collect()))) == duck(sf, name)


# --- ranked search
def scored(docs, item, k=20):
    """All documents, term by term."""
    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    d = [(i, cut(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in d), sum(len(t) for _, t in d)
    out = []
    for i, t in d:
        s = 0
        for term in cut(item):
            if tf := t.count(term):
                df = sum(term in x for _, x in d)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * (75 + 25 * len(t) * n // total)))
        if s:
            out.append((-s, i is None, i))
    return [(r, i, -s) for r, (s, _, i) in enumerate(sorted(out, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]


@pytest.mark.parametrize("small", [False, True])
def test_search_against_all_documents(spark, monkeypatch, small):
    if small:  # many shards, windows and blocks of queries
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 8)
        monkeypatch.setattr(lexical, "STRETCH", 300)
    rng = random.Random(3)
    words = ["the", "Of", "übung", "x1", "naïve", "zeta", "Δ9", "a", "rare", "b"]
    docs = [(i, " ".join(rng.choices(words, [40, 30, 5, 5, 3, 3, 1, 20, 0.2, 9], k=rng.randrange(0, 60))) + rng.choice(["", ".", "\x00-the"])) for i in range(300)]
    docs += [(None, "rare zeta"), (None, None), (301, ""), (302, None), (7, docs[7][1]), (7, docs[7][1]), (303, "zeta " * 20_000), (304, "-- ..")]
    items = [(1, "The zeta, the RARE the"), (2, "nothing here"), (3, ""), (4, None), (5, "of a b"), (5, "Δ9 übung"), (None, "naïve x1"), (6, "rare\nrare")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(d, "doc_id", "text", q, "item_id", "text").collect()
    want = [(k, *r) for k, t in items for r in scored(docs, t)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_search_skips_postings_and_loses_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    n = 30_000
    sizes = [25_000, 20_000, 8_000, 500, 20]
    docs = [np.sort(rng.choice(n, s, replace=False)) for s in sizes]
    tf = [rng.integers(1, 4, s) for s in sizes]
    one = lambda x, kind: x.astype(kind).tobytes()
    lengths = rng.integers(20, 400, n)
    row = {"terms": list(range(5)), "sizes": sizes, "ids": one(np.arange(n), np.int64), "lengths": one(lengths, np.int64), "docs": one(np.concatenate(docs), np.int32), "tf": one(np.concatenate(tf), np.int32)}
    w = np.array([lexical.weight(n, s) for s in sizes], np.int64)
    x = lexical.Lists(row, w, n, int(lengths.sum()))
    query = [(0, 1), (1, 2), (2, 1), (3, 1), (4, 1)]
    total = np.zeros(n, np.int64)
    for t, times in query:
        a, b = x.place[t]
        total[x.docs[a:b]] += x.gain[a:b] * times
    best = lexical.Best(20)
    looked = lexical.maxscore(x, query, best)
    order = np.lexsort((np.arange(n), -total))[:20]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == total[order].tolist()
    assert looked < 0.5 * sum(sizes)


def test_search_odd_tables(spark, odd_docs, no_docs):
    q = spark.createDataFrame([(1, "alpha one lorem")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(no_docs, "doc_id", "text", q, "item_id", "text").collect() == []
    empty = lexical.search(odd_docs, "doc_id", "text", none, "item_id", "text")
    assert empty.collect() == [] and empty.columns == ["query_key", "rank", "key", "score"]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = lexical.search(odd_docs, "doc_id", "text", q, "item_id", "text").collect()
    assert sorted(map(str, ((r["rank"], r["key"], r["score"]) for r in got))) == sorted(map(str, scored(rows, "alpha one lorem")))


# --- url rules
RULES = ["||ads.", "@@||ads.good.org^", "/a^b", "tail.gif|", "|http://exact.com/", "x*y", "-foo-", "^", "(.+)$", "q=1&"]


def one_by_one(url, sites, patterns, default="allow"):
    """Every rule tried on the URL."""
    u = "".join(c.lower() if c.isascii() else c for c in url or "")
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fit = []
    for v, t in sites:
        h, _, p = t.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(t), t, v))
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    verdict = default
    for t in sorted(patterns, key=lambda t: t.startswith("@@")):
        body = t.removeprefix("@@")
        rx = "".join({"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body.strip("|"))
        rx = (r"[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if body.startswith("||") else "" if body.startswith("|") else "(?s:.*)") + rx + (r"\Z" if body.endswith("|") else "")
        if re.match(rx, u):
            verdict = "allow" if t.startswith("@@") else "block"
    return host, path, None, verdict


def test_rules_of_every_form(spark):
    rng = random.Random(9)
    urls = ["http://ads.x.com/", "http://bads.x.com/", "http://my.ads.good.org/1", "http://ads.good.org.uk/", "http://z.com/a?b", "http://z.com/a/b/a%b", "http://z.com/tail.gif", "http://z.com/tail.gif?1", "HTTP://EXACT.com/q", "https://exact.com/",
            "http://z.com/xaby", "http://z.com/-foo-", "http://z.com/-food-", "(.+)$", "http://z.com/?q=1&", "http://z.com/?qq=1&", None, "", "no scheme org/", "http://ORG/x", "http://org", "http://a.org?x/", "http://a.ORG:80/", "ftp://a.org/é\nü#/b",
            "http://s.example.org/es/1", "http://example.org/ES/1", "http://example.org/en/17", "http://notexample.org/es/", "x://y://example.com/de/", "http://example.com/fr/?a", "http://" + "long/" * 5000 + "tail.gif"]
    urls += ["http://" + "".join(rng.choices(["a", "b", ".", "/", "ads.", "x", "y", "foo", "-", "?", "org/", "com/fr/"], k=rng.randrange(1, 14))) for _ in range(300)]
    urls += ["http://ads.x.com/"] * 200
    sites = queries.url_rules.SITES
    d = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(urls)], "Row long, URL string, token string, Rank string").repartition(6)
    out = url_rules.judge(d, "URL", url_rules.rule_table(spark, sites, RULES))
    assert out.columns == ["Row", "URL", "token", "Rank", "host", "path", "rule", "pattern", "verdict"]
    got = {r["Row"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == one_by_one(u, sites, RULES), u


def test_rules_keep_rows_and_columns(spark):
    rules = url_rules.rule_table(spark, [], ["||a."])
    d = spark.createDataFrame([(None, "x", "H", {"k": 1}), (None, "x", "H", {"k": 1}), ("http://a.b/", "y", "H", None)], "url string, own string, HOST string, low map<string,int>")
    out = url_rules.judge(d, "url", rules, "unknown")
    assert out.columns == ["url", "own", "low", "host", "path", "rule", "pattern", "verdict"]
    assert sorted(r["verdict"] for r in out.collect()) == ["block", "unknown", "unknown"]
    assert url_rules.judge(d.limit(0), "url", rules).collect() == []
    none = url_rules.judge(d, "url", url_rules.rule_table(spark, [], []))
    assert [r["verdict"] for r in none.collect()] == ["allow"] * 3


def test_rules_stand_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://www.shop.com/{x}",) for x in ("a", "b", "c", "buy")], "low string")
    d = url_rules.indexed(url_rules.compiled(url_rules.rule_table(spark, [("allow", "shop.com/buy/")], ["||shop.com/buy^", "/www*", "*"])), urls, "low")
    assert {r["text"]: r["token"] for r in d.collect()} == {"shop.com/buy/": "buy", "||shop.com/buy^": "buy", "/www*": "", "*": ""}


def test_rules_run_without_python(spark, sf):
    plan = queries.op12_url_rules(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


# --- spelling variants
def grouped(docs):
    """All pairs of words, tried letter by letter."""
    count = {}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if n >= 2}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [x for x in count if abs(len(x) - len(w)) < 2 and one(w, x)] for w in count}
    form = {w: min(near[w], key=lambda x: (-count[x], x)) for w in count if near[w]}
    form = {w: f for w, f in form.items() if count[f] >= 10 * count[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(near[w]), form.get(w), count.get(form.get(w)), root(w)) for w, n in count.items())


def test_variants_against_all_pairs(spark):
    rng = random.Random(1)
    base = ["wonderful", "aabbccaab", "ünïcödéñ", "aaaaaaaa", "letters", "lettres", "banana" * 2]
    docs = []
    for i in range(400):
        out = []
        for _ in range(12):
            w = rng.choices(base, [60, 20, 9, 9, 5, 5, 2])[0]
            for _ in range(rng.choices([0, 1, 2], [30, 2, 1])[0]):
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abé") + w[p + 1 :], w[:p] + rng.choice("abé") + w[p:]])
            out.append(rng.choice([w, w.upper() if w.isascii() else w]))
        docs.append((i, rng.choice([" ", "-", "1", "\n"]).join(out)))
    long = "ab" * 15_000
    docs += [(None, "letters letters"), (None, None), (500, ""), (1, docs[1][1]), (501, f"{long} {long} {long}x {long}x {long}x"), (502, "wonderfuls × wonder÷ful ×××××××")] + [(600 + i, "wonderful " * 50) for i in range(30)]
    d = spark.createDataFrame([(i, t, "z", "y") for i, t in docs], "doc_id long, text string, Word string, N string").repartition(5)
    got = variants.group(d, "doc_id", "text").select("word", "n", "n_near", "form", "form_n", "root").collect()
    short = [r for r in got if len(r["word"]) < 20_000]
    assert sorted(map(str, map(tuple, short))) == sorted(map(str, grouped([(i, t) for i, t in docs if i != 501])))
    far = {len(r["word"]): r for r in got if len(r["word"]) >= 20_000}
    assert len(far) in (1, 2) and (len(far) == 1 or all(r["n_near"] == 1 for r in far.values()))
    assert any(r["form"] and r["root"] != r["form"] for r in got)


def test_variants_of_nothing(spark, odd_docs, no_docs):
    assert variants.group(no_docs, "doc_id", "text").collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = variants.group(odd_docs, "doc_id", "text").select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, grouped(rows)))
