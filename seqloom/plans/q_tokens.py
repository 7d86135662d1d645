"""Queries over tokens, vocabularies and their statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import bpe_train as B
from ..operators import stats as S
from ..operators import tokenizers as T
from ..operators import vocab as V
from .bindings import POOLS, SEQS, SEQS_N, TOKENS, VOCABS, pool_counts, read, seqs, seqs_n, token_counts, vocab
from .registry import query


def _r(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def _counts(spark, sf_dir):
    return token_counts(spark, sf_dir, "lang")


@query("kmer_tokens", f"WITH {SEQS} SELECT doc_id, CASE WHEN length(seq) >= 5 THEN array_to_string([substring(seq, CAST(i AS BIGINT), 5) FOR i IN range(1, length(seq) - 3)], ' ') ELSE '' END AS kmers FROM seqs")
def kmer_tokens(spark, sf_dir):
    """The overlapping 5-mers of each sequence, joined by blanks."""
    return seqs(spark, sf_dir).select("doc_id", F.array_join(C.kmers("seq", 5), " ").alias("kmers"))


@query("kmer_counts", f"WITH {SEQS}, {TOKENS} SELECT lang, token, cnt FROM tc")
def kmer_counts(spark, sf_dir):
    """Token counts of each set."""
    return _counts(spark, sf_dir)


@query("kmer_top200", f"WITH {SEQS}, {TOKENS}, t AS (SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM tc GROUP BY token) SELECT token, cnt, round(cnt * 1.0 / sum(cnt) OVER (), 10) AS freq FROM t ORDER BY cnt DESC, token LIMIT 200")
def kmer_top200(spark, sf_dir):
    """The 200 commonest tokens (ties by token) and their share."""
    t = token_counts(spark, sf_dir)
    total = t.agg(F.sum("cnt").alias("n"))
    return t.crossJoin(F.broadcast(total)).select("token", "cnt", F.round(F.col("cnt") / F.col("n"), 10).alias("freq")).orderBy(F.desc("cnt"), "token").limit(200)  # one row of totals


@query("sequence_filters", f"""WITH {SEQS_N} SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(upper(seq), '^[ACGT]+$')) AS only_acgt, count(*) FILTER (NOT contains(seq, 'N')) AS lacks_n, count(*) FILTER (length(seq) >= 100) AS long,
CAST(sum(length(replace(seq, 'N', ''))) AS BIGINT) AS bases, CAST(sum(length(seq)) AS BIGINT) AS letters FROM seqs_n GROUP BY lang""")
def sequence_filters(spark, sf_dir):
    """What each predicate leaves, by language."""
    n = lambda c: F.sum(c.cast("long"))
    return seqs_n(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), n(C.only_acgt("seq")).alias("only_acgt"), n(C.lacks_n("seq")).alias("lacks_n"), n(F.length("seq") >= 100).alias("long"), F.sum(F.length(C.strip_n("seq"))).alias("bases"), F.sum(F.length("seq")).alias("letters"))


@query("gc_profile", f"WITH {SEQS} SELECT lang, count(*) AS n, round(avg(CASE WHEN length(seq) > 0 THEN CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS DOUBLE) / length(seq) ELSE 0 END), 6) AS mean_gc, round(median(CASE WHEN length(seq) > 0 THEN CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS DOUBLE) / length(seq) ELSE 0 END), 6) AS median_gc FROM seqs GROUP BY lang")
def gc_profile(spark, sf_dir):
    """GC share of whole sequences."""
    g = seqs(spark, sf_dir).withColumn("gc", C.gc_fraction("seq"))
    return _r(g.groupBy("lang").agg(F.count("*").alias("n"), F.avg("gc").alias("mean_gc"), F.median("gc").alias("median_gc")), "mean_gc", "median_gc")


@query("token_length_profile", f"""WITH {SEQS}, {VOCABS}, o AS (SELECT pool, length(token) AS len, CAST(length(regexp_replace(token, '[^GC]', '', 'g')) AS DOUBLE) / length(token) AS gc, unnest(range(cnt)) AS i FROM vc)
SELECT pool, count(*) AS total_tokens, (SELECT count(*) FROM vc v WHERE v.pool = o.pool) AS unique_tokens, round(avg(len), 6) AS mean_len, round(median(len), 6) AS median_len, round(avg(gc), 6) AS mean_gc, round(median(gc), 6) AS median_gc FROM o GROUP BY pool""")
def token_length_profile(spark, sf_dir):
    """Lengths and GC of tokens over their occurrences."""
    return _r(S.token_profile(pool_counts(spark, sf_dir), ["pool"]), "mean_len", "median_len", "mean_gc", "median_gc")


LB = f"""{SEQS}, {VOCABS}, lb AS (SELECT pool, sum(cnt) AS t, 100.0 * sum(CASE WHEN length(token) <= 2 THEN cnt ELSE 0 END) / sum(cnt) AS a, 100.0 * sum(CASE WHEN length(token) BETWEEN 3 AND 5 THEN cnt ELSE 0 END) / sum(cnt) AS b,
 100.0 * sum(CASE WHEN length(token) BETWEEN 6 AND 8 THEN cnt ELSE 0 END) / sum(cnt) AS c, 100.0 * sum(CASE WHEN length(token) >= 9 THEN cnt ELSE 0 END) / sum(cnt) AS d FROM vc GROUP BY pool)"""


def _bins(spark, sf_dir):
    return S.length_bins(pool_counts(spark, sf_dir), ["pool"])


PCT = ["pct_len1_2", "pct_len3_5", "pct_len6_8", "pct_len9plus"]


@query("length_bins", f"WITH {LB} SELECT pool, round(a, 6) AS pct_len1_2, round(b, 6) AS pct_len3_5, round(c, 6) AS pct_len6_8, round(d, 6) AS pct_len9plus FROM lb")
def length_bins(spark, sf_dir):
    """Shares of token lengths."""
    return _r(_bins(spark, sf_dir), *PCT)


def _js(x, y):
    t = lambda p, m: f"CASE WHEN {p} > 0 THEN 0.5 * {p} * log2({p} / {m}) ELSE 0 END"
    return " + ".join(t(f"(x.{k} / 100)", f"((x.{k} + y.{k}) / 200)") + " + " + t(f"(y.{k} / 100)", f"((x.{k} + y.{k}) / 200)") for k in "abcd")


@query("js_distance", f"WITH {LB} SELECT x.pool AS pool_a, y.pool AS pool_b, round({_js('x', 'y')}, 6) AS divergence, round(sqrt(greatest(0, {_js('x', 'y')})), 6) AS distance, round(sqrt(round({_js('x', 'y')}, 4)), 6) AS published FROM lb x JOIN lb y ON x.pool < y.pool")
def js_distance(spark, sf_dir):
    """Jensen-Shannon distance of the pools' length shares, in both roundings."""
    b = _bins(spark, sf_dir)
    x = b.select(F.col("pool").alias("pool_a"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(PCT)))
    y = b.select(F.col("pool").alias("pool_b"), *(F.col(c).alias(f"y{i}") for i, c in enumerate(PCT)))
    j = x.join(y, F.col("pool_a") < F.col("pool_b"))  # a row a pool
    p, q = [F.col(f"x{i}") / 100 for i in range(4)], [F.col(f"y{i}") / 100 for i in range(4)]
    return _r(j.select("pool_a", "pool_b", S.js_divergence(p, q).alias("divergence"), S.js_distance(p, q).alias("distance"), S.js_distance(p, q, True).alias("published")), "divergence", "distance", "published").orderBy("pool_a", "pool_b")


@query("fold_change", f"WITH {LB}, u AS (UNPIVOT lb ON a, b, c, d INTO NAME bin VALUE pct) SELECT v.pool, v.bin, round(v.pct, 6) AS pct, round(CASE WHEN n.pct <> 0 THEN v.pct / n.pct END, 6) AS fold FROM u v JOIN u n ON n.pool = 'n' AND v.bin = n.bin WHERE v.pool <> 'n'")
def fold_change(spark, sf_dir):
    """Each pool's shares over those of the neutral pool."""
    b = _bins(spark, sf_dir).unpivot("pool", PCT, "bin", "pct").withColumn("bin", F.translate(F.substring("bin", 8, 1), "1369", "abcd"))
    base = b.filter("pool = 'n'").select("bin", F.col("pct").alias("base"))
    return _r(b.filter("pool <> 'n'").join(base, "bin").select("pool", "bin", "pct", F.try_divide("pct", "base").alias("fold")), "pct", "fold")


@query("entropy_compression", f"""WITH {SEQS}, {TOKENS}, b AS (SELECT lang, sum(length(seq)) AS bases FROM seqs GROUP BY lang), t AS (SELECT lang, sum(cnt) AS n, count(*) AS v, sum(cnt * log2(cnt)) AS s FROM tc GROUP BY lang)
SELECT t.lang, CAST(n AS BIGINT) AS total_tokens, v AS vocab_size_used, round(bases / n, 6) AS bp_per_token, round(n * 1000.0 / bases, 6) AS tokens_per_kb, round(log2(n) - s / n, 6) AS shannon_h_bits, round(CASE WHEN v > 1 THEN (log2(n) - s / n) / log2(v) ELSE 1 END, 6) AS h_normalized FROM t JOIN b USING (lang)""")
def entropy_compression(spark, sf_dir):
    """Compression and entropy of each set."""
    bases = seqs(spark, sf_dir).groupBy("lang").agg(F.sum(F.length("seq")).alias("bases"))
    return _r(S.entropy(_counts(spark, sf_dir), ["lang"], bases), "bp_per_token", "tokens_per_kb", "shannon_h_bits", "h_normalized")


@query("vocab_jaccard", f"""WITH {SEQS}, {VOCABS}, n AS (SELECT pool, count(*) AS n FROM vc GROUP BY pool), m AS (SELECT a.pool AS pa, b.pool AS pb, count(*) AS m FROM vc a JOIN vc b ON a.token = b.token AND a.pool < b.pool GROUP BY ALL)
SELECT x.pool AS pool_a, y.pool AS pool_b, coalesce(m, 0) AS intersection, x.n + y.n - coalesce(m, 0) AS "union", round(coalesce(m, 0) / CAST(x.n + y.n - coalesce(m, 0) AS DOUBLE), 4) AS jaccard FROM n x JOIN n y ON x.pool < y.pool LEFT JOIN m ON pa = x.pool AND pb = y.pool""")
def vocab_jaccard(spark, sf_dir):
    """Overlap of the pools' vocabularies."""
    return V.jaccard_pairs(pool_counts(spark, sf_dir))


PARTS = f"""{SEQS}, {POOLS}, parts AS (SELECT token, CAST(sum(CASE pool WHEN 'c' THEN 1 WHEN 'n' THEN 2 ELSE 4 END) AS INTEGER) AS mask, min(id) FILTER (pool = 'n') AS neutral_id FROM vocab GROUP BY token)"""
RANKED = f"""{PARTS}, tr AS (SELECT *, CASE mask WHEN 7 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 END AS tier FROM parts),
ranked AS (SELECT token, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier = 4 THEN neutral_id ELSE 0 END, token) - 1 AS "rank" FROM tr WHERE tier IS NOT NULL QUALIFY "rank" < 300)"""
CAP = 300


@query("vocab_partition", f"WITH {PARTS} SELECT token, mask, neutral_id FROM parts")
def vocab_partition(spark, sf_dir):
    """Which pools have each token."""
    return V.partition(vocab(spark, sf_dir))


@query("vocab_priority_merge", f"WITH {RANKED} SELECT token, CAST(tier AS INTEGER) AS tier, \"rank\" FROM ranked")
def vocab_priority_merge(spark, sf_dir):
    """Tokens by priority, cut at the capacity."""
    return V.priority_merge(V.partition(vocab(spark, sf_dir)), CAP)


def _essentials(ranked, cap):
    """SQL: the essentials that ``ranked`` (token, rank) lacks, behind it, within the capacity, as (token, id)."""
    names = "['[UNK]', '[CLS]', '[SEP]', '[PAD]', '[MASK]', 'A', 'T', 'C', 'G', 'N']"
    return f"""(SELECT token, row_number() OVER (ORDER BY g, o) - 1 AS id FROM (SELECT token, 0 AS g, "rank" AS o FROM {ranked}
UNION ALL SELECT t, 1, i FROM (SELECT unnest({names}) AS t, generate_subscripts({names}, 1) AS i) WHERE t NOT IN (SELECT token FROM {ranked})) QUALIFY id < {cap})"""


@query("vocab_essentials", f"WITH {RANKED} SELECT token, id FROM {_essentials('ranked', CAP + 5)}")
def vocab_essentials(spark, sf_dir):
    """U8: specials and bases behind the merged tokens, within the capacity."""
    return V.with_essentials(V.priority_merge(V.partition(vocab(spark, sf_dir)), CAP), CAP + 5)


_LEN2 = "CAST(length(token) * length(token) AS DOUBLE) AS score"


@query("vocab_scores", f"""WITH {RANKED}, rnd AS (SELECT token, row_number() OVER (ORDER BY md5('42:' || token), token) - 1 AS "rank" FROM parts QUALIFY "rank" < 300), base AS (SELECT token, id AS "rank" FROM vocab WHERE pool = 'n')
SELECT 'merge' AS model, token, id, {_LEN2} FROM {_essentials('ranked', CAP + 5)} UNION ALL SELECT 'no_length', token, id, CAST(length(token) AS DOUBLE) FROM {_essentials('ranked', CAP + 5)}
UNION ALL SELECT 'no_priority', token, id, {_LEN2} FROM {_essentials('rnd', CAP + 5)} UNION ALL SELECT 'no_partition', token, id, {_LEN2} FROM {_essentials('base', CAP + 205)}""")
def vocab_scores(spark, sf_dir):
    """The merged vocabulary and its three ablations, essentials included, with their scores."""
    v = vocab(spark, sf_dir)
    p = V.partition(v)
    m, r, n = V.priority_merge(p, CAP), V.random_merge(p, CAP), v.filter("pool = 'n'").select("token", F.col("id").alias("rank"))
    part = lambda d, name, kind, cap=CAP + 5: V.with_essentials(d, cap).select(F.lit(name).alias("model"), "token", "id", V.score(kind).alias("score"))
    return part(m, "merge", "len2").unionByName(part(m, "no_length", "length")).unionByName(part(r, "no_priority", "len2")).unionByName(part(n, "no_partition", "len2", CAP + 205))


#: Merges whose encoding SQL can follow, one pass a merge.
MERGES = [("A", "C"), ("G", "T"), ("AC", "GT"), ("T", "A"), ("C", "A"), ("G", "A"), ("TA", "C"), ("CA", "GT")]


#: Letters of a piece that is decoded alone.
PIECE = 500
PIECES = f"""{SEQS}, pc AS (SELECT doc_id * 100000 + i AS id, doc_id, CAST(i AS INTEGER) AS piece, substring(seq, CAST(i * {PIECE} + 1 AS BIGINT), {PIECE}) AS p FROM (SELECT doc_id, seq, unnest(range((length(seq) + {PIECE - 1}) // {PIECE})) AS i FROM seqs))"""


def _pieces(spark, sf_dir, tokenize):
    d = T.in_chunks(seqs(spark, sf_dir), "seq", PIECE, tokenize, ["doc_id"])
    return d.select("doc_id", "piece", F.array_join("tokens", " ").alias("tokens"))


#: Words of the decoding queries, the smallest of the reference's sizes, and their letters at most.
WORDS, LONGEST = 2048, 6


def learned(spark, sf_dir, size: int = WORDS) -> list[str]:
    """The commonest 1- to 6-mers of all sequences."""
    c = S.kmer_counts(seqs(spark, sf_dir), [], "seq", list(range(1, LONGEST + 1)))
    return [r[0] for r in c.orderBy(F.desc("cnt"), "token").limit(size).collect()]  # the vocabulary


LEARNED = f"""km AS (SELECT unnest(flatten([[substring(seq, CAST(i AS BIGINT), k) FOR i IN range(1, length(seq) - k + 2)] FOR k IN range(1, {LONGEST + 1})])) AS token FROM seqs),
wd AS MATERIALIZED (SELECT token, length(token) AS k, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM km WHERE token <> '' GROUP BY token QUALIFY id <= {WORDS})"""


def _decoded(masks: str, score: str) -> str:
    """SQL: pieces (id, p) decoded by the words of ``masks`` (id, ms: for each place the lengths of the words that end there, as bits), as g (id, i, bs)."""
    arms = [(k, f"CASE WHEN (ms[i + 1] >> {k - 1}) & 1 = 1 THEN s{k - 1} + {score.format(k=k)} ELSE -1e9 END") for k in range(1, LONGEST + 1)]
    best = f"greatest({', '.join(e for _, e in arms)})"
    back = "CASE " + " ".join(f"WHEN {e} >= {best} THEN {k}" for k, e in reversed(arms)) + " END"
    old = range(1, LONGEST)
    return f"""f AS (SELECT id, 0 AS i, CAST(0 AS DOUBLE) AS s0, {', '.join(f'CAST(-1e9 AS DOUBLE) AS s{k}' for k in old)}, 0 AS b FROM {masks}
  UNION ALL SELECT f.id, i + 1, CAST({best} AS DOUBLE), {', '.join(f's{k - 1}' for k in old)}, CAST({back} AS INTEGER) FROM f JOIN {masks} m ON f.id = m.id WHERE i < len(ms)),
l AS (SELECT id, list(b ORDER BY i) AS bs FROM f WHERE i > 0 GROUP BY id),
g AS (SELECT id, len(ms) AS i FROM {masks} UNION ALL SELECT g.id, i - bs[i] FROM g JOIN l ON g.id = l.id WHERE i > 0)"""


@query("unigram_decode", f"""WITH RECURSIVE {PIECES}, {LEARNED},
hit AS (SELECT id, i, k, substring(p, CAST(i - k + 1 AS BIGINT), k) AS w FROM (SELECT id, p, unnest(range(1, length(p) + 1)) AS i FROM pc), (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i >= k),
ms AS MATERIALIZED (SELECT id, list(m ORDER BY i) AS ms FROM (SELECT hit.id, i, CAST(sum(1 << (hit.k - 1)) AS INTEGER) AS m FROM hit JOIN wd ON hit.w = wd.token GROUP BY hit.id, i) GROUP BY id),
{_decoded("ms", "{k} * {k}")}
SELECT doc_id, piece, string_agg(substring(p, i - bs[i] + 1, bs[i]), ' ' ORDER BY i) AS tokens FROM g JOIN l ON g.id = l.id JOIN pc ON pc.id = g.id WHERE i > 0 GROUP BY doc_id, piece""")
def unigram_decode(spark, sf_dir):
    """Additive-score decoding of whole sequences, piece by piece, with 2,048 words learned from them."""
    return _pieces(spark, sf_dir, T.unigram_decoder(spark, {t: float(len(t) ** 2) for t in learned(spark, sf_dir)}, unk=-100.0, offsets=False))


def _merged(expr):
    """SQL: letters of ``expr`` as tokens in brackets, merged in the order of rank; a merge's own pairs come later in it, so each rank is one pass."""
    out = f"regexp_replace({expr}, '(.)', '<\\1>', 'g')"
    for a, b in MERGES:
        out = f"replace({out}, '<{a}><{b}>', '<{a}{b}>')"
    return out


@query("bpe_encode", f"WITH {SEQS} SELECT doc_id, replace(trim({_merged('seq')}, '<>'), '><', ' ') AS tokens FROM seqs")
def bpe_encode(spark, sf_dir):
    """Rank merging of whole sequences."""
    f = T.bpe_encoder(spark, MERGES, offsets=False)
    return seqs(spark, sf_dir).select("doc_id", F.array_join(f(F.col("seq")), " ").alias("tokens"))


@query("bpe_train_pairs", f"WITH {SEQS}, p AS (SELECT unnest([substring(seq, CAST(i AS BIGINT), 2) FOR i IN range(1, length(seq))]) AS p FROM seqs WHERE length(seq) > 1) SELECT p[1] AS l, p[2] AS r, count(*) AS n FROM p GROUP BY ALL")
def bpe_train_pairs(spark, sf_dir):
    """Pair counts of the first step."""
    return B.pair_counts(B.as_words(seqs(spark, sf_dir), "seq"))


#: The smallest of the reference's vocabulary sizes.
BPE_SIZE = 2048


@query("bpe_train")
def bpe_train(spark, sf_dir):
    """A vocabulary learned from 1,000-letter pieces of all sequences (no oracle: iterative)."""
    d = seqs(spark, sf_dir).select(F.explode(C.chunks("seq", 1000)).alias("seq"))
    v, m = B.train(d, "seq", BPE_SIZE, 100)
    ids = {t: i for i, t in enumerate(v)}
    made = {l + r for l, r in m}
    rows = [(i, t, None, None) for i, t in enumerate(v) if t not in made] + [(ids[l + r], l + r, l, r) for l, r in m]
    return spark.createDataFrame(rows, "id int, token string, l string, r string")


@query("bpe_encode_learned")
def bpe_encode_learned(spark, sf_dir):
    """All sequences encoded by the merges that the trainer learned from them, and whether [UNK] is met (no oracle: iterative)."""
    v, m = B.train(seqs(spark, sf_dir).select(F.explode(C.chunks("seq", 1000)).alias("seq")), "seq", BPE_SIZE, 100)
    d = seqs(spark, sf_dir).select("doc_id", T.bpe_encoder(spark, m, set(v), offsets=False)(F.col("seq")).alias("tokens"))
    return d.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens"), F.array_contains("tokens", T.UNK).alias("unknown"))


#: Lengths of the dictionary words of the motif tokenizer, and how many of each.
MOTIF_LENGTHS, MOTIF_EACH = [4, 5, 6, 8], 100
#: Known 3-mers; other places fall to one letter.
TRIPLES = ["ACG", "CAT", "GGA", "TTC", "AAT", "TGA"]


def motif_dictionary(spark, sf_dir) -> list[str]:
    """The commonest k-mers of some lengths, of all sequences."""
    c = S.kmer_counts(seqs(spark, sf_dir), [], "seq", MOTIF_LENGTHS).withColumn("k", F.length("token"))
    w = Window.partitionBy("k").orderBy(F.desc("cnt"), "token")  # counted k-mers: 4**8 at most
    return [r[0] for r in c.withColumn("id", F.row_number().over(w)).filter(F.col("id") <= MOTIF_EACH).select("token").collect()]


#: (w, a, b): the words and the two numbers of each by which it draws its lot at a place.
MOTIF_DICTIONARY = f"""mk AS (SELECT unnest(flatten([[substring(seq, CAST(i AS BIGINT), k) FOR i IN range(1, length(seq) - k + 2)] FOR k IN {MOTIF_LENGTHS}])) AS w FROM seqs),
mw AS MATERIALIZED (SELECT w, CAST('0x' || substring(md5('7:' || w), 1, 7) AS BIGINT) AS a, CAST('0x' || substring(md5('7:' || w), 8, 7) AS BIGINT) + 1 AS b FROM (SELECT w, row_number() OVER (PARTITION BY length(w) ORDER BY count(*) DESC, w) AS id FROM mk WHERE w <> '' GROUP BY w) WHERE id <= {MOTIF_EACH})"""
_LOT = f"((i + a) % {T.PRIME}) * ((i + a) % {T.PRIME}) % {T.PRIME} * ((i + a) % {T.PRIME}) % {T.PRIME} * b % {T.PRIME}"


def _reached(steps, rounds):
    """SQL: places that the steps (id, i, nxt) reach from place 0, as the last of some CTEs, ``r<rounds>``: of each round twice as many steps are added."""
    out = [f"j0 AS MATERIALIZED (SELECT id, i, nxt FROM {steps})", "r0 AS MATERIALIZED (SELECT id, 0 AS i FROM pc)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT id, i FROM r{k} UNION SELECT r.id, j.nxt FROM r{k} r JOIN j{k} j ON r.id = j.id AND r.i = j.i)")
        out.append(f"j{k + 1} AS MATERIALIZED (SELECT x.id, x.i, y.nxt FROM j{k} x JOIN j{k} y ON x.id = y.id AND x.nxt = y.i)")
    return ",\n".join(out)


@query("motif_tokenizer", f"""WITH {PIECES}, {MOTIF_DICTIONARY}, ix AS (SELECT id, p, unnest(range(length(p))) AS i FROM pc),
hit AS (SELECT id, i, CAST(arg_min(length(w), ({_LOT}, length(w))) AS INTEGER) AS n FROM (SELECT id, i, substring(p, CAST(i + 1 AS BIGINT), k) AS w FROM ix, (SELECT unnest({MOTIF_LENGTHS}) AS k) WHERE i + k <= length(p)) JOIN mw USING (w) GROUP BY id, i),
pick AS (SELECT ix.id, ix.i, coalesce(n, CASE WHEN substring(p, CAST(ix.i + 1 AS BIGINT), 3) IN ({', '.join(map(repr, TRIPLES))}) THEN 3 ELSE 1 END) AS n FROM ix LEFT JOIN hit ON ix.id = hit.id AND ix.i = hit.i),
three AS (SELECT id, i, n, coalesce(lead(n, 1) OVER w, 0) AS n1, coalesce(lead(n, 2) OVER w, 0) AS n2 FROM pick WINDOW w AS (PARTITION BY id ORDER BY i)),
st AS MATERIALIZED (SELECT id, i, skip, CASE skip WHEN 0 THEN n WHEN 1 THEN n1 ELSE n2 END AS n, i + skip + CASE skip WHEN 0 THEN n WHEN 1 THEN n1 ELSE n2 END AS nxt FROM (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n2 > greatest(n, n1) THEN 2 WHEN n1 > n THEN 1 ELSE 0 END AS skip FROM three)),
{_reached("st", 9)}
SELECT doc_id, piece, string_agg(concat(CASE WHEN skip > 0 THEN substring(p, CAST(i + 1 AS BIGINT), 1) || ' ' ELSE '' END, CASE WHEN skip > 1 THEN substring(p, CAST(i + 2 AS BIGINT), 1) || ' ' ELSE '' END, substring(p, CAST(i + skip + 1 AS BIGINT), n)), ' ' ORDER BY i) AS tokens
FROM r9 JOIN st USING (id, i) JOIN pc USING (id) GROUP BY doc_id, piece""")
def motif_tokenizer(spark, sf_dir):
    """400 dictionary words learned from the sequences, with look-ahead; of several at a place the one that draws the least seeded lot."""
    return _pieces(spark, sf_dir, T.motif_tokenizer(spark, set(motif_dictionary(spark, sf_dir)), 7, set(TRIPLES), offsets=False))


ENR = f"""{SEQS}, {TOKENS}, en AS (SELECT token, coalesce(sum(cnt) FILTER (lang = 'en'), 0) AS na, coalesce(sum(cnt) FILTER (lang = 'de'), 0) AS nb FROM tc WHERE lang IN ('en', 'de') GROUP BY token),
tt AS (SELECT sum(na) AS ta, sum(nb) AS tb FROM en), ez AS (SELECT token, na, nb, na / ta AS fa, nb / tb AS fb, log2((na / ta + 0.5 / ta) / (nb / tb + 0.5 / tb)) AS lfc,
 (na / ta - nb / tb) / sqrt((na + nb) / (ta + tb) * (1 - (na + nb) / (ta + tb)) * (1 / ta + 1 / tb)) AS z FROM en, tt)"""


def _horner(c, x):
    out = repr(c[-1])
    for v in c[-2::-1]:
        out = f"({out} * {x} + {v!r})"
    return out


def _erfc(x):
    """SQL: the complementary error function of a number from 0 up, by the approximations of :mod:`..functions.columns`."""
    q = lambda p, v: f"({_horner(p[0], v)} / {_horner(p[1], v)})"
    w = f"({x} * {x})"
    return f"""CASE WHEN {x} <= 0.46875 THEN 1 - {x} * {q(C.ERF_LOW, w)} WHEN {x} <= 4 THEN exp(-{w}) * {q(C.ERFC_MID, x)} ELSE exp(-{w}) / {x} * ({1 / math.sqrt(math.pi)!r} - {q(C.ERFC_HIGH, f"(1.0 / {w})")} / {w}) END"""


FDR = f"""{ENR}, ep AS (SELECT *, {_erfc("v")} AS p FROM (SELECT *, CAST(abs(z) / {math.sqrt(2)!r} AS DOUBLE) AS v FROM ez)), ek AS (SELECT *, row_number() OVER (ORDER BY p, token) AS k, count(*) OVER () AS m FROM ep),
eq AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q, CASE WHEN lfc > 0 THEN 'en' WHEN lfc < 0 THEN 'de' ELSE 'equal' END AS side FROM ek)"""


@query("token_enrichment", f"WITH {FDR} SELECT token, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, round(fa, 6) AS freq_a, round(fb, 6) AS freq_b, round(lfc, 6) AS log2fc, round(z, 6) AS z, round(p, 9) AS p_value, round(q, 9) AS fdr_bh, side FROM eq ORDER BY q, token")
def token_enrichment(spark, sf_dir):
    """Two sets of tokens compared, with p and false-discovery rate, by it and the token."""
    return _r(_r9(S.enriched(_counts(spark, sf_dir), "lang", "en", "de")), "freq_a", "freq_b", "log2fc", "z")


def _r9(df):
    return df.withColumn("p_value", F.round("p_value", 9)).withColumn("fdr_bh", F.round("fdr_bh", 9))


def _fdr_of(counts):
    """SQL: the same comparison over other counts (lang, token, cnt)."""
    return FDR.replace(TOKENS, "").replace(f"{SEQS}, ,", f"{SEQS}, {counts},")


BPE_COUNTS = f"bt AS (SELECT lang, unnest(string_split(replace(trim({_merged('seq')}, '<>'), '><', ' '), ' ')) AS token FROM seqs WHERE seq <> ''), tc AS (SELECT lang, token, count(*) AS cnt FROM bt GROUP BY ALL)"


@query("encoded_enrichment", f"WITH {_fdr_of(BPE_COUNTS)} SELECT token, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, round(lfc, 6) AS log2fc, round(z, 5) AS z, round(p, 9) AS p_value, round(q, 9) AS fdr_bh, side FROM eq ORDER BY q, token")
def encoded_enrichment(spark, sf_dir):
    """The tokens of a merge tokenizer, counted in two sets and compared."""
    f = T.bpe_encoder(spark, MERGES, offsets=False)
    d = seqs(spark, sf_dir).filter("seq <> ''").select("lang", F.explode(f(F.col("seq"))).alias("token"))
    e = _r9(S.enriched(S.token_counts(d, ["lang"]), "lang", "en", "de")).withColumn("z", F.round("z", 5))
    return _r(e.select("token", "na", "nb", "log2fc", "z", "p_value", "fdr_bh", "side"), "log2fc")


VOLCANO = "token, round(lfc, 6) AS log2fc, round(z, 6) AS z, round(p, 9) AS p_value, round(q, 9) AS fdr_bh, round(-log10(greatest(q, 1e-300)), 6) AS neglog10_fdr"


def _volcano(df):
    return _r(_r9(df.select("token", "log2fc", "z", "p_value", "fdr_bh", "neglog10_fdr")), "log2fc", "z", "neglog10_fdr")


@query("token_volcano", f"WITH {FDR} SELECT {VOLCANO} FROM eq ORDER BY q, -abs(lfc), token")
def token_volcano(spark, sf_dir):
    """The volcano rows by false-discovery rate, larger effects first."""
    return _volcano(S.volcano(_counts(spark, sf_dir), "lang", "en", "de"))


@query("volcano_top_labels", f"WITH {FDR} SELECT {VOLCANO} FROM eq WHERE q <= 0.05 ORDER BY q, -abs(lfc), token LIMIT 15")
def volcano_top_labels(spark, sf_dir):
    """The first 15 significant tokens."""
    return _volcano(S.top_labels(S.volcano(_counts(spark, sf_dir), "lang", "en", "de")))


@query("bh_fdr", "WITH p AS (SELECT o_orderkey, o_totalprice / max(o_totalprice) OVER () AS p FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS k, count(*) OVER () AS n FROM p) SELECT o_orderkey, round(p, 9) AS p, round(least(1.0, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def bh_fdr(spark, sf_dir):
    """Step-up false-discovery control over all orders, ranked by range partitions."""
    o = read(spark, sf_dir, "orders")
    top = o.agg(F.max("o_totalprice").alias("m"))
    d = o.crossJoin(F.broadcast(top)).select("o_orderkey", (F.col("o_totalprice") / F.col("m")).alias("p"))  # one row
    return S.bh_large(d, "p", "o_orderkey").select("o_orderkey", F.round("p", 9).alias("p"), F.round("q", 6).alias("q"))


@query("mean_log2fc_matrix", f"""WITH {SEQS}, {TOKENS}, cc AS (SELECT CASE WHEN hash_ IN ('0', '1', '2', '3', '4') THEN 'left' ELSE 'right' END AS side, lang, token, count(*) AS cnt FROM (SELECT substring(md5(source), 1, 1) AS hash_, lang, token FROM tok) GROUP BY ALL),
bg AS (SELECT token, cnt FROM cc WHERE side = 'left' AND lang = 'de'), tot AS (SELECT side, lang, sum(cnt) AS n FROM cc GROUP BY ALL), bt AS (SELECT sum(cnt) AS n FROM bg),
u AS (SELECT t.side, t.lang, k.token FROM tot t, LATERAL (SELECT token FROM cc c WHERE c.side = t.side AND c.lang = t.lang UNION SELECT token FROM bg) k),
j AS (SELECT u.side, u.lang, coalesce(c.cnt, 0) AS c, coalesce(b.cnt, 0) AS b, t.n, bt.n AS bn, count(*) OVER (PARTITION BY u.side, u.lang) AS v FROM u JOIN tot t ON t.side = u.side AND t.lang = u.lang LEFT JOIN cc c ON c.side = u.side AND c.lang = u.lang AND c.token = u.token LEFT JOIN bg b ON b.token = u.token, bt),
g AS (SELECT side, lang, avg(log2(((c + 0.5) / (n + 0.5 * v)) / ((b + 0.5) / (bn + 0.5 * v)))) AS m FROM j GROUP BY ALL)
SELECT side, round(max(m) FILTER (lang = 'de'), 6) AS de, round(max(m) FILTER (lang = 'en'), 6) AS en, round(max(m) FILTER (lang = 'es'), 6) AS es, round(max(m) FILTER (lang = 'fr'), 6) AS fr FROM g GROUP BY side""")
def mean_log2fc_matrix(spark, sf_dir):
    """Mean log2 ratio of each cell to a background cell, as a matrix."""
    side = F.when(F.substring(F.md5("source"), 1, 1).isin("0", "1", "2", "3", "4"), "left").otherwise("right")
    c = S.kmer_counts(seqs(spark, sf_dir).select(side.alias("side"), "lang", "seq"), ["side", "lang"], "seq", [4])
    m = S.mean_log2fc(c, c.filter("side = 'left' AND lang = 'de'").select("token", "cnt"), ["side", "lang"])
    return _r(m.groupBy("side").pivot("lang", ["de", "en", "es", "fr"]).agg(F.first("mean_log2fc")), "de", "en", "es", "fr")


#: Shuffled replicates of each sequence.
SHUFFLES = 59


@query("shuffle_importance", f"""WITH {SEQS}, {TOKENS}, rs AS (SELECT rep, CAST('0x' || substring(h, 1, 7) AS BIGINT) AS a, CAST('0x' || substring(h, 8, 7) AS BIGINT) + 1 AS b, ch FROM (SELECT doc_id, list_transform(string_split(seq, ''), lambda c: strpos('ACGT', c) - 1) AS ch, rep, md5(concat('1:', rep, ':', doc_id)) AS h FROM seqs, (SELECT unnest(range({SHUFFLES})) AS rep) WHERE length(seq) >= 4)),
sl AS (SELECT rep, ch, list_sort(list_transform(list_transform(range(len(ch)), lambda i: (i + a) % {S.PRIME}), lambda x, j: (x * x % {S.PRIME} * x % {S.PRIME} * b % {S.PRIME}) * 2147483648 + j - 1)) AS o FROM rs),
sx AS (SELECT rep, list_transform(o, lambda v: ch[v % 2147483648 + 1]) AS l FROM sl),
sw AS (SELECT rep, unnest(list_transform(range(1, len(l) - 2), lambda i: 64 * l[i] + 16 * l[i + 1] + 4 * l[i + 2] + l[i + 3])) AS t FROM sx),
rt AS (SELECT rep, concat('ACGT'[t // 64 + 1], 'ACGT'[t // 16 % 4 + 1], 'ACGT'[t // 4 % 4 + 1], 'ACGT'[t % 4 + 1]) AS token, cnt FROM (SELECT rep, t, count(*) AS cnt FROM sw GROUP BY ALL)),
ob AS (SELECT token, sum(cnt) AS n FROM tc GROUP BY token), tt AS (SELECT sum(n) AS t FROM ob), tr AS (SELECT rep, sum(cnt) AS tr FROM rt GROUP BY rep), tb AS (SELECT sum(tr) / {SHUFFLES}.0 AS tb FROM tr),
every AS (SELECT token FROM ob UNION SELECT token FROM rt), al AS (SELECT e.token, coalesce(n, 0) AS n, coalesce(n, 0) / t AS f, tr.rep, coalesce(cnt, 0) AS c, coalesce(cnt, 0) / tr.tr AS fr FROM every e LEFT JOIN ob ON ob.token = e.token, tt, tr LEFT JOIN rt ON rt.rep = tr.rep AND rt.token = e.token),
st AS (SELECT token, max(n) AS n, max(f) AS f, avg(c) AS cm, coalesce(stddev_samp(c), 0) AS cs, avg(fr) AS fm, coalesce(stddev_samp(fr), 0) AS fs, count(*) FILTER (fr >= f) AS ge FROM al GROUP BY token),
sp AS (SELECT *, log2((f + 0.5 / t) / (fm + 0.5 / greatest(1.0, tb))) AS lfc, (ge + 1) / {SHUFFLES + 1}.0 AS p FROM st, tt, tb), sk AS (SELECT *, row_number() OVER (ORDER BY p, token) AS k, count(*) OVER () AS m FROM sp),
sq AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM sk)
SELECT token, CAST(n AS BIGINT) AS count_observed, round(cm, 6) AS count_bg_mean, round(cs, 4) AS count_bg_sd, round(f, 9) AS freq_observed, round(fm, 9) AS freq_bg_mean, round(lfc, 6) AS log2_enrichment, round(p, 6) AS p_ge, round(q, 6) AS fdr_bh,
CASE WHEN lfc > 0 AND q <= 0.05 THEN 1 ELSE 0 END AS important FROM sq ORDER BY q, -lfc, token""")
def shuffle_importance(spark, sf_dir):
    """Tokens against 59 shuffled replicates (q <= 0.05 needs 19 at least), by false-discovery rate."""
    rep = S.shuffled_counts(seqs(spark, sf_dir), "doc_id", "seq", 4, SHUFFLES, 1)
    d = S.importance(token_counts(spark, sf_dir), rep, SHUFFLES).orderBy("fdr_bh", F.desc("log2_enrichment"), "token")
    r = lambda c, n: F.round(c, n).alias(c)
    return d.select("token", F.col("count_observed").cast("long"), r("count_bg_mean", 6), r("count_bg_sd", 4), r("freq_observed", 9), r("freq_bg_mean", 9), r("log2_enrichment", 6), r("p_ge", 6), r("fdr_bh", 6), "important")


@query("best_tokens", f"""WITH {FDR} SELECT side, count(*) FILTER (q <= 0.05) AS n_significant, arg_min(token, (round(q, 9), -abs(round(lfc, 6)), token)) AS best_token FROM eq GROUP BY side""")
def best_tokens(spark, sf_dir):
    """Significant tokens and the best of each side, by false-discovery rate, effect and token."""
    e = S.enriched(_counts(spark, sf_dir), "lang", "en", "de").withColumn("q", F.round("fdr_bh", 9)).withColumn("log2fc", F.round("log2fc", 6))
    return S.best_tokens(e, ["side"])


#: Vocabulary sizes that a sweep may ask for (fixed values).
VOCAB_SIZES = ("2048", "3072", "4096", "5120")


@query("vocab_sweep", f"""WITH {SEQS}, {VOCABS}, rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY cnt DESC, token) - 1 AS id FROM vc), cfg AS (SELECT pool AS model, v AS vocab FROM (SELECT DISTINCT pool FROM vc), (SELECT unnest([2048, 3072, 4096]) AS v)),
t AS (SELECT pool AS region, sum(cnt) AS total FROM vc GROUP BY pool)
SELECT model || '_' || vocab AS config, region, count(r.token) AS n_tokens, CAST(coalesce(sum(r.cnt), 0) AS BIGINT) AS n_met, round(coalesce(sum(r.cnt), 0) / max(total), 6) AS share, arg_max(r.token, (r.cnt, r.token)) AS top_token
FROM cfg JOIN rk ON rk.pool = model AND rk.id < vocab JOIN vc r ON r.token = rk.token JOIN t ON t.region = r.pool WHERE config LIKE '%2048' OR config LIKE '%4096' GROUP BY model, vocab, region""")
def vocab_sweep(spark, sf_dir):
    """Every (model, vocabulary size, region) of a sweep in one plan: the region's occurrences that the vocabulary has."""
    c = pool_counts(spark, sf_dir)
    names = [f"{m}_{v}" for m in ("a", "c", "n") for v in V.vocab_sizes("2048, 3072,4096", VOCAB_SIZES)]
    config = V.configurations(spark, V.with_suffix(names, ["2048", "4096"]))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("cnt"), "token")) - 1
    ranked = c.withColumn("id", rank).select(F.col("pool").alias("model"), "token", "id")
    return V.sweep(config, ranked, c.withColumnRenamed("pool", "region")).withColumn("share", F.round("share", 6))


#: Pools whose vocabulary of ``WORDS`` words decodes all regions.
SWEPT = ["c", "n"]


@query("tokenizer_sweep", f"""WITH RECURSIVE {PIECES}, {VOCABS}, wd AS MATERIALIZED (SELECT pool, token, row_number() OVER (PARTITION BY pool ORDER BY cnt DESC, token) AS r FROM vc WHERE pool IN ({', '.join(map(repr, SWEPT))}) QUALIFY r <= {WORDS}),
hit AS (SELECT id, i, k, substring(p, CAST(i - k + 1 AS BIGINT), k) AS w FROM (SELECT id, p, unnest(range(1, length(p) + 1)) AS i FROM pc), (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE i >= k),
ms AS MATERIALIZED (SELECT id, list(m ORDER BY i) AS ms FROM (SELECT pool || ':' || hit.id AS id, i, CAST(sum(1 << (k - 1)) AS INTEGER) AS m FROM hit JOIN wd ON hit.w = wd.token GROUP BY pool, hit.id, i) GROUP BY id),
{_decoded("ms", "{k} * {k}")},
tk AS (SELECT split_part(g.id, ':', 1) AS model, pc.doc_id, substring(p, i - bs[i] + 1, bs[i]) AS token FROM g JOIN l ON g.id = l.id JOIN pc ON pc.id = CAST(split_part(g.id, ':', 2) AS BIGINT) WHERE i > 0),
ct AS (SELECT model, lang AS region, token, count(*) AS cnt FROM tk JOIN seqs USING (doc_id) GROUP BY ALL)
SELECT model, region, CAST(sum(cnt) AS BIGINT) AS n_tokens, count(*) AS n_distinct, round(sum(cnt * length(token)) / sum(cnt), 6) AS mean_length, arg_max(token, (cnt, token)) AS top_token FROM ct GROUP BY model, region""")
def tokenizer_sweep(spark, sf_dir):
    """All regions tokenised by several vocabularies of 2,048 words in one pass, summed up per (model, region)."""
    v = vocab(spark, sf_dir, WORDS).filter(F.col("pool").isin(*SWEPT)).select("pool", "token").collect()  # the vocabularies
    models = {m: {r.token: float(len(r.token) ** 2) for r in v if r.pool == m} for m in SWEPT}
    d = seqs(spark, sf_dir).select(F.col("lang").alias("region"), F.explode(C.chunks("seq", PIECE)).alias("seq"))
    c = T.sweep_counts(d, "seq", ["region"], models, -100.0)
    g = c.groupBy("model", "region").agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_distinct"), F.round(F.sum(F.col("cnt") * F.length("token")) / F.sum("cnt"), 6).alias("mean_length"), F.max_by("token", F.struct("cnt", "token")).alias("top_token"))
    return g


def _occurrences(spark, sf_dir):
    """Pieces of four letters of sequences of 100 or more, with mean and variance of the scores under them."""
    d = seqs(spark, sf_dir).filter(F.length("seq") >= 100).select("doc_id", "lang", F.posexplode(C.chunks("seq", 4)).alias("i", "token"))
    span = F.slice(F.array(*((((F.col("i") * 4 + j) * 7 + F.col("doc_id")) % 11 - 5) / F.lit(5.0) for j in range(4))), 1, F.length("token"))
    return S.span_moments(d.withColumn("span", span), "span").select("lang", "token", "mean_score", "var_score")


OCC = f"""{SEQS}, po AS (SELECT doc_id, lang, seq, unnest(range(length(seq))) AS i FROM seqs WHERE length(seq) >= 100),
oc AS (SELECT doc_id, lang, i // 4 AS k, substring(seq, CAST(i // 4 * 4 + 1 AS BIGINT), 4) AS token, avg(((i * 7 + doc_id) % 11 - 5) / 5.0) AS m, var_pop(((i * 7 + doc_id) % 11 - 5) / 5.0) AS v FROM po GROUP BY doc_id, lang, i // 4, substring(seq, CAST(i // 4 * 4 + 1 AS BIGINT), 4)),
pr AS (SELECT lang, token, avg(m) AS mean_mean, avg(v) AS mean_var, median(round(m, 9)) AS median_mean, median(round(v, 9)) AS median_var, count(*) AS "count" FROM oc GROUP BY ALL)"""


@query("token_score_profile", f"WITH {OCC} SELECT lang, token, round(mean_mean, 10) AS mean_mean, round(mean_var, 10) AS mean_var, round(median_mean, 10) AS median_mean, round(median_var, 10) AS median_var, \"count\" FROM pr")
def token_score_profile(spark, sf_dir):
    """Scores under each token's occurrences."""
    o = _occurrences(spark, sf_dir).withColumn("mean_score", F.round("mean_score", 9)).withColumn("var_score", F.round("var_score", 9))
    p = S.score_profile(o, ["lang"])
    for n in ("mean_mean", "mean_var", "median_mean", "median_var"):
        p = p.withColumn(n, F.round(n, 10))
    return p


@query("tokenizer_summary", f"""WITH {OCC} SELECT lang, count(*) AS num_tokens, round(avg(mean_mean), 5) AS mean_of_mean, round(median(mean_mean), 5) AS median_of_mean, round(avg(mean_var), 5) AS mean_of_var, round(median(mean_var), 5) AS median_of_var,
round(100.0 * count(*) FILTER (round(mean_mean, 9) > 0) / count(*), 5) AS pct_mean_pos, round(100.0 * count(*) FILTER (round(mean_var, 9) < 0.1) / count(*), 5) AS pct_var_low, round(avg("count"), 5) AS mean_count, round(median("count"), 5) AS median_count FROM pr GROUP BY lang""")
def tokenizer_summary(spark, sf_dir):
    """The token table summed up per language."""
    p = S.score_profile(_occurrences(spark, sf_dir), ["lang"]).withColumn("mean_mean", F.round("mean_mean", 9)).withColumn("mean_var", F.round("mean_var", 9))
    d = S.tokenizer_summary(p, ["lang"])
    for n in d.columns:
        if n not in ("lang", "num_tokens"):
            d = d.withColumn(n, F.round(n, 5))
    return d
