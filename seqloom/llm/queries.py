"""The dealt queries: op1 to op13, thin digests over the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hmm, lexical, licenses, line_dedup, mixing, near_dedup, quality, revisits, url_rules, variants, vector_dedup, wfst
from .runtime import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one (Jaccard 0.8 of their words); see :mod:`.line_dedup`."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(d, "doc_id", "text")


def op5_mix_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to source weights 3, 1, 2, ... at 150 % of all words; see :mod:`.mixing`."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("size"))
    m = mixing.mix(d, "doc_id", "size", "source", weights=mixing.WEIGHTS)
    return m.select(F.col("key").alias("doc_id"), "size", "source_size", "target", mixing.taken(F.col("spans")).alias("taken"), "source")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of ``pages``: a full response per page, and a later not-modified answer whose validators agree, are stale or absent."""
    p, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))

    def header(name: str, value) -> object:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    stored_tag = F.when(p % 5 == 4, F.lit(None)).when(p % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    response = pages.select(
        (p * 2).alias("record_id"), "url", (p * 10).alias("ts"), F.lit("response").alias("kind"), stored_tag.alias("etag"), p.cast("string").alias("last_modified"),
        F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.length(F.coalesce("html", F.lit("")))), header("Cache-Control", F.lit("max-age=60"))).alias("headers"),
    )
    sent_tag = F.when(p % 7 == 0, F.lit(None)).when(p % 11 == 0, F.lit('"stale"')).otherwise(tag)
    revisit = pages.select(
        (p * 2 + 1).alias("record_id"), "url", (p * 10 + p * 7919 % 50000).alias("ts"), F.lit("revisit").alias("kind"), sent_tag.alias("etag"), F.when(p % 14 != 0, p.cast("string")).alias("last_modified"),
        F.array(header("Cache-Control", F.concat(F.lit("max-age="), (p % 100).cast("string"))), header("Content-Length", F.lit("0")), header("Age", p % 9)).alias("headers"),
    )
    return response.unionByName(revisit)


def op1_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified capture of ``pages`` resolved to the latest earlier response; see :mod:`.revisits`."""
    r = revisits.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    text = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "|")
    return r.select("record_id", "url_key", "ts", "refers_to", "outcome", text.alias("merged_headers"))


_CANON = """
u AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
h AS (SELECT *, regexp_extract(u, '^([^/?]*)', 1) AS raw FROM u),
q AS (SELECT *, substring(u, length(raw) + 1) AS rest FROM h),
k AS (SELECT page_id, html, CASE WHEN u IS NULL THEN NULL ELSE nullif(concat(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '^.*@', ''), ':(80|443)?$', ''), '\\.$', ''), '^www[0-9]*\\.', ''),
    regexp_replace(regexp_replace(regexp_extract(rest, '^([^?]*)', 1), ';jsessionid=[^/]*', '', 'g'), '/+$', ''),
    CASE WHEN len(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|phpsessid|sessionid|sid)(=|$)'))) > 0
      THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|phpsessid|sessionid|sid)(=|$)'))), '&') ELSE '' END), '') END AS ukey
  FROM q)"""

OP1_SQL = f"""WITH {_CANON},
s AS (SELECT page_id * 2 AS rid, ukey, page_id * 10 AS ts, length(coalesce(html, '')) AS n, CAST(page_id AS VARCHAR) AS lm,
    CASE WHEN page_id % 5 = 4 THEN NULL ELSE '"' || md5(coalesce(html, '')) || '"' END AS etag FROM k),
v AS (SELECT page_id, page_id * 2 + 1 AS rid, ukey, page_id * 10 + page_id * 7919 % 50000 AS ts, CASE WHEN page_id % 14 <> 0 THEN CAST(page_id AS VARCHAR) END AS lm,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN '"stale"' ELSE '"' || md5(coalesce(html, '')) || '"' END AS etag FROM k),
m AS (SELECT v.rid, max(s.rid * 1) AS any_rid, arg_max(s.rid, s.ts) AS srid FROM v JOIN s ON v.ukey = s.ukey AND s.ts < v.ts GROUP BY v.rid),
j AS (SELECT v.*, m.srid, s.etag AS setag, s.lm AS slm, s.n AS sn FROM v LEFT JOIN m ON v.rid = m.rid LEFT JOIN s ON s.rid = m.srid),
o AS (SELECT *, CASE WHEN ukey IS NULL THEN 'no-url' WHEN srid IS NULL THEN 'no-earlier-response' WHEN etag IS NULL AND lm IS NULL THEN 'unvalidated'
    WHEN CASE WHEN etag IS NOT NULL THEN coalesce(etag = setag, FALSE) ELSE coalesce(lm = slm, FALSE) END THEN 'resolved' ELSE 'validator-mismatch' END AS outcome FROM j)
SELECT rid AS record_id, ukey AS url_key, ts, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN srid END AS refers_to, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN 'Content-Type: text/html|Content-Length: ' || sn || '|Cache-Control: max-age=' || (page_id % 100) || '|Age: ' || (page_id % 9)
    ELSE 'Cache-Control: max-age=' || (page_id % 100) || '|Content-Length: 0|Age: ' || (page_id % 9) END AS merged_headers
FROM o"""


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents (5-word shingles, multiset similarity 0.8); see :mod:`.near_dedup`."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.group(d, "doc_id", "text").select(F.col("key").alias("doc_id"), "class_id", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and detections of every document; see :mod:`.licenses`."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def op2_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under a hidden Markov model and under its unigram; see :mod:`.hmm`."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold("doc_id", 5) == 1
    model, counts = hmm.train(d, "text", ~held)
    s = hmm.score(d, "doc_id", "text", held, model, counts)
    return s.select(F.col("key").alias("doc_id"), F.col("mark").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model | None:
    """Learned from ``labels.quality`` of the rows whose fold of 5 is not 0."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold("doc_id", 5) != 0)
    return quality.train(docs, "doc_id", "text", lab, "doc_id", "quality")


def op3_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; see :mod:`.quality`."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (fold("doc_id", 5) == 0).alias("held_out")
    s = quality.score(d, "doc_id", "text", quality_model(spark, d, sf_dir), held).withColumnRenamed("quality_score", "score")
    return s.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_ann_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vec_id divisible by 20; see :mod:`.ann`."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(e, "vec_id", "embedding", F.col("key") % 20 == 0).select(F.col("query_key").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


#: A public vocabulary file; read on the driver.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op9_sentencepiece_wfst(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Ids of every document, and whether decoding gives the text again; see :mod:`.wfst`."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = wfst.encode(d, "doc_id", "text", read_model(model_path))
    return e.select(F.col("key").alias("doc_id"), "n_tokens", "ids", "round_trip")


#: Links of all pairs, then the least id that they reach, link by link.
OP10_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), TRUE) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 and their components over all ``embeddings``; see :mod:`.vector_dedup`."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_dedup.link(e, "vec_id", "embedding", 0.95).withColumnRenamed("key", "vec_id")


#: All documents scored for all items.
OP11_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL), s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM t WHERE len(ts) > 0),
p AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM t), f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM d, s),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // total)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score FROM x WHERE score > 0 QUALIFY "rank" <= 20"""


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best ``documents`` of every ``benchmark`` item; see :mod:`.lexical`."""
    d, q = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.search(d, "doc_id", "text", q, "item_id", "text").select(F.col("query_key").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def _rules_sql() -> str:
    """SQL: every rule as (rank, site, text, verdict, regex), written for an engine that tries them all."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for p in url_rules.PATTERNS:
        body, verdict = (p[2:], "allow") if p.startswith("@@") else (p, "block")
        head = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?" if body.startswith("||") else ""
        end = r"\z" if body.endswith("|") else ""
        out = "".join({"*": ".*", "^": r"([^a-z0-9_.%-]|\z)"}.get(c, re.escape(c)) for c in body.strip("|"))
        rows.append(((verdict == "allow", 0), p, verdict, False, f"(?s){head}{out}{end}"))
    for verdict, text in url_rules.SITES:
        rows.append(((2, len(text)), text, verdict, True, r"(?s)^([^/]*\.)?" + re.escape(text)))
    rows.sort(key=lambda r: (r[0], [-ord(c) for c in r[1]] + [1]))
    return ", ".join(f"({i}, {site}, {quote(t)}, '{v}', {quote(x)})" for i, (_, t, v, site, x) in enumerate(rows, 1))


OP12_SQL = f"""WITH r(k, site, txt, verdict, regex) AS (VALUES {_rules_sql()}),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT n, page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT n, max(k) AS k FROM p JOIN r ON regexp_matches(CASE WHEN site THEN host || path ELSE low END, regex) GROUP BY n)
SELECT page_id, host, path, CASE WHEN site THEN txt END AS rule, CASE WHEN NOT site THEN txt END AS pattern, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (n) LEFT JOIN r ON r.k = b.k"""


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and verdict of every url of ``pages``; see :mod:`.url_rules`."""
    d = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(d, "url", url_rules.rule_table(spark, url_rules.SITES, url_rules.PATTERNS)).drop("url")


#: crc32 by its table, made by rule; then words joined on (deletion, its place) or on a deletion that is the word.
OP13_SQL = r"""WITH RECURSIVE g0 AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM g0 WHERE k < 8),
tb AS (SELECT list(c ORDER BY i) AS tab FROM g0 WHERE k = 8),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
u AS (SELECT d, run, count(*) AS m FROM o WHERE length(run) >= 7 GROUP BY ALL),
y AS (SELECT d, run, m, flatten(list_transform(string_split(d || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS bs FROM u),
h AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c // 256, tab[CAST(xor(c % 256, b) + 1 AS INTEGER)]))) AS h FROM y, tb),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, m FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
k AS MATERIALIZED (SELECT word, n, i, substring(word, 1, CAST(i - 1 AS BIGINT)) || substring(word, CAST(i + 1 AS BIGINT)) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pr AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM k a JOIN k b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
 UNION SELECT k.word, k.n, w.word, w.n FROM k JOIN w ON k.s = w.word UNION SELECT w.word, w.n, k.word, k.n FROM k JOIN w ON k.s = w.word),
nr AS (SELECT a, count(*) AS n_near, max(bn) AS top FROM pr GROUP BY a), fm AS (SELECT pr.a, any_value(n_near) AS n_near, min(b) AS b, any_value(bn) AS bn, any_value(an) AS an FROM pr JOIN nr ON pr.a = nr.a AND bn = top GROUP BY pr.a),
fo AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * an THEN b END AS form, CASE WHEN bn >= 10 * an THEN bn END AS form_n FROM w LEFT JOIN fm ON w.word = fm.a),
rt AS (SELECT word, word AS at, 0 AS k FROM fo UNION ALL SELECT rt.word, fo.form, k + 1 FROM rt JOIN fo ON rt.at = fo.word WHERE fo.form IS NOT NULL)
SELECT fo.word, fo.n, fo.n_near, fo.form, fo.form_n, (SELECT arg_max(rt.at, rt.k) FROM rt WHERE rt.word = fo.word) AS root FROM fo"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of ``documents``; see :mod:`.variants`."""
    return variants.group(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


_QUERIES: dict[str, Query] = {
    "op1_resolve_revisits": op1_resolve_revisits,
    "op2_hmm_lm": op2_hmm_lm,
    "op3_nb_svm": op3_nb_svm,
    "op4_line_dedup": op4_line_dedup,
    "op5_mix_sainte_lague": op5_mix_sainte_lague,
    "op6_bagminhash": op6_bagminhash,
    "op7_license_scan": op7_license_scan,
    "op8_ann_projections": op8_ann_projections,
    "op9_sentencepiece_wfst": op9_sentencepiece_wfst,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_maxscore": op11_maxscore,
    "op12_url_rules": op12_url_rules,
    "op13_spelling_variants": op13_spelling_variants,
}
_ORACLES: dict[str, str] = {"op1_resolve_revisits": OP1_SQL, "op10_vector_dedup": OP10_SQL, "op11_maxscore": OP11_SQL, "op12_url_rules": OP12_SQL, "op13_spelling_variants": OP13_SQL}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
