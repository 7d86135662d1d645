"""Queries over motifs, FASTA records, corpora, labelled datasets and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import corpus as K
from ..operators import datasets as D
from ..operators import motifs as M
from ..operators import stats as S
from ..operators import tokenizers as T
from ..sources import readers as R
from .bindings import PEAKS, SEQS, SEQS_N, read, peaks, seqs, seqs_n
from .registry import query

MOT = """mr AS (SELECT DISTINCT regexp_replace(upper(regexp_split_to_array(trim(regexp_replace(p_type, 'E', '*', 'g') || ' ' || p_name), '\\s+')[1]), '[^ACGTNRYWSMKBDHV*]', '', 'g') AS motif FROM part),
mo AS (SELECT motif, length(motif) - length(replace(motif, '*', '')) AS k FROM mr WHERE length(motif) >= 2),
ex AS (SELECT motif, k, unnest(range(CAST(pow(4, k) AS BIGINT))) AS code FROM mo WHERE k <= 5),
va AS (SELECT motif, string_split(motif, '*')[1] || array_to_string([substring('ACGT', CAST(code // CAST(pow(4, k - 1 - i) AS BIGINT) % 4 + 1 AS BIGINT), 1) || string_split(motif, '*')[i + 2] FOR i IN range(k)], '') AS variant FROM ex)"""


def _motifs(spark, sf_dir):
    line = F.concat(F.regexp_replace("p_type", "E", "*"), F.lit(" "), "p_name")
    return M.expand(M.clean(read(spark, sf_dir, "part").select(line.alias("line")), "line", 2))


@query("motif_expand", f"WITH {MOT} SELECT variant, max(motif) AS motif FROM va GROUP BY variant")
def motif_expand(spark, sf_dir):
    """Cleaned motifs, their variants, and the last motif of each variant."""
    return M.sources(_motifs(spark, sf_dir))


def _coverage(spark, sf_dir):
    letters = sorted(set(M.ALLOWED) - {"*"})
    f = {"letters": T.unigram_decoder(spark, {t: 1.0 for t in letters}, -1.0), "pairs": T.unigram_decoder(spark, {t: 1.0 for t in letters} | {a + b: 4.0 for a in "ACGTNRS" for b in "ACGTNRS"}, -1.0)}
    v = {"letters": set(letters), "pairs": {a + b for a in "ACGTNRS" for b in "ACGTNRS"}}
    return M.coverage(M.sources(_motifs(spark, sf_dir)), f, v)


# of 'pairs' the best sum has the most pairs: in each run of their letters every two from the left
COV = f"""{MOT}, mv AS (SELECT variant, max(motif) AS motif FROM va GROUP BY variant), ct AS (SELECT 'letters' AS tokenizer, motif, variant, CAST(length(variant) AS INTEGER) AS n_tokens FROM mv
UNION ALL SELECT 'pairs', motif, variant, CAST(length(regexp_replace(variant, '[ACGTNRS][ACGTNRS]', 'x', 'g')) AS INTEGER) FROM mv),
cov AS (SELECT *, CAST(n_tokens = 1 AS INTEGER) AS perfect, CAST(CASE tokenizer WHEN 'letters' THEN length(variant) = 1 ELSE regexp_full_match(variant, '[ACGTNRS][ACGTNRS]') END AS INTEGER) AS in_vocab, CAST(1.0 / n_tokens AS DOUBLE) AS mean_token_share FROM ct)"""


@query("motif_coverage", f"WITH {COV} SELECT tokenizer, motif, variant, n_tokens, perfect, in_vocab, round(mean_token_share, 9) AS mean_token_share FROM cov")
def motif_coverage(spark, sf_dir):
    """Tokens, perfect cover and membership of each variant."""
    return _coverage(spark, sf_dir).withColumn("mean_token_share", F.round("mean_token_share", 9))


@query("motif_summary", f"WITH {COV} SELECT tokenizer, count(*) AS n, round(avg(n_tokens), 6) AS mean_tokens, round(median(n_tokens), 6) AS median_tokens, round(100 * avg(perfect), 6) AS pct_perfect, round(100 * avg(in_vocab), 6) AS pct_in_vocab FROM cov GROUP BY tokenizer ORDER BY mean_tokens, pct_in_vocab DESC")
def motif_summary(spark, sf_dir):
    """Coverage summed up per tokenizer."""
    d = M.summary(_coverage(spark, sf_dir))
    return d.select("tokenizer", "n", *(F.round(c, 6).alias(c) for c in ("mean_tokens", "median_tokens", "pct_perfect", "pct_in_vocab")))


@query("motif_consistency", f"WITH {COV} SELECT tokenizer, motif, count(*) AS n, round(coalesce(stddev_samp(n_tokens), 0), 6) AS sd_tokens FROM cov GROUP BY tokenizer, motif")
def motif_consistency(spark, sf_dir):
    """Spread of the token counts within a motif."""
    return M.consistency(_coverage(spark, sf_dir)).withColumn("sd_tokens", F.round("sd_tokens", 6))


@query("fasta_parse", """WITH f AS (SELECT doc_id, unnest(list_filter(string_split('>d' || doc_id || chr(10) || replace(replace(text, 'ß', 'ss'), '.', chr(10) || '>s' || chr(10)), '>'), lambda x: x <> '')) AS rec FROM documents)
SELECT doc_id, split_part(rec, chr(10), 1) AS header, replace(upper(regexp_replace(CASE WHEN contains(rec, chr(10)) THEN substring(rec, strpos(rec, chr(10)) + 1) ELSE '' END, '[ \\n\\t\\r]', '', 'g')), 'N', '') AS seq FROM f""")
def fasta_parse(spark, sf_dir):
    """Records of FASTA text held in a column, upper-cased and without N."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit("\n"), F.replace("text", F.lit("."), F.lit("\n>s\n"))).alias("fa"))
    return R.parse_fasta(d, "fa", ["doc_id"]).withColumn("seq", C.strip_n(F.upper("seq")))


@query("label_encode", "SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label_id FROM customer")
def label_encode(spark, sf_dir):
    """Label ids by sorted label."""
    return K.label_ids(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("split_80_10_10", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_80_10_10(spark, sf_dir):
    """Exact proportional split in a salted order."""
    return K.split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8, 0.1)


@query("head_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= count(*) OVER () * 5 // 100 THEN 'validation' ELSE 'train' END AS split FROM orders")
def head_split(spark, sf_dir):
    """Validation from the head of the training rows."""
    return K.head_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("balanced_sample", """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS k FROM customer), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment))
SELECT c_custkey, c_mktsegment FROM r, m WHERE k <= m.n""")
def balanced_sample(spark, sf_dir):
    """Classes cut to the smallest."""
    return K.balanced(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("hash_sample_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample_k(spark, sf_dir):
    """A sample of 500 rows."""
    return K.sample_k(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, "7")


PK = f"""{PEAKS}, pk AS (SELECT peak_id, split_part(coord, '-', 1) AS chrom, CAST(split_part(coord, '-', 2) AS BIGINT) - 1 AS s, CAST(split_part(coord, '-', 3) AS BIGINT) AS e, list_filter(list_transform(string_split(labels, ','), lambda x: trim(x)), lambda x: x <> '') AS labels FROM peaks)"""


@query("peak_labels", f"""WITH {PK} SELECT 'drop' AS policy, peak_id, chrom, s AS "start", e AS "end", labels[1] AS label FROM pk WHERE len(labels) = 1 UNION ALL SELECT 'first', peak_id, chrom, s, e, labels[1] FROM pk UNION ALL SELECT 'explode', peak_id, chrom, s, e, unnest(labels) FROM pk""")
def peak_labels(spark, sf_dir):
    """Peaks under the three label policies."""
    p = D.peak_rows(peaks(spark, sf_dir))
    out = [D.expand_labels(p, x).withColumn("policy", F.lit(x)) for x in ("drop", "first", "explode")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("shared_labels", f"""WITH {PK}, x AS (SELECT peak_id, chrom, unnest(labels) AS label FROM pk), s AS (SELECT label FROM x WHERE chrom <= 'chr15' INTERSECT SELECT label FROM x WHERE chrom > 'chr15') SELECT label, count(*) AS n FROM x WHERE label IN (SELECT label FROM s) GROUP BY label""")
def shared_labels(spark, sf_dir):
    """Rows of the labels that two halves share."""
    x = D.expand_labels(D.peak_rows(peaks(spark, sf_dir)))
    s = D.shared_labels(x.filter("chrom <= 'chr15'"), x.filter("chrom > 'chr15'"))
    return D.allow(x, s).groupBy("label").agg(F.count("*").alias("n"))


def _toks(df):
    return df.withColumn("tokens", C.chunks("seq", 3))


@query("count_windows_512", f"WITH {SEQS}, t AS (SELECT doc_id, seq, (length(seq) + 2) // 3 AS n FROM seqs), w AS (SELECT doc_id, seq, unnest(range(n // 512)) AS i FROM t) SELECT doc_id, CAST(i AS INTEGER) AS win, regexp_replace(substring(seq, CAST(i * 1536 + 1 AS BIGINT), 1536), '(...)(.)', '\\1\\2', 'g') AS letters FROM w")
def count_windows_512(spark, sf_dir):
    """Full windows of 512 tokens (of three letters)."""
    t = _toks(seqs(spark, sf_dir))
    return t.select("doc_id", F.posexplode(K.count_windows(F.col("tokens"), 512)).alias("win", "w")).select("doc_id", "win", F.array_join("w", "").alias("letters"))


@query("n_window_filter", f"""WITH {SEQS_N}, t AS (SELECT doc_id, regexp_extract_all(seq, '.{{1,3}}') AS a FROM seqs_n), w AS (SELECT doc_id, a, unnest(range(len(a) // 64)) AS i FROM t), c AS (SELECT doc_id, i, len(list_filter(a[i * 64 + 1 : i * 64 + 64], lambda x: contains(x, 'N'))) AS n FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS win, round(n / 64.0, 6) AS n_share FROM c WHERE n / 64.0 < 0.5""")
def n_window_filter(spark, sf_dir):
    """windows of 64 tokens of which fewer than half hold an N."""
    t = _toks(seqs_n(spark, sf_dir)).select("doc_id", F.posexplode(K.count_windows(F.col("tokens"), 64)).alias("win", "w"))
    return t.withColumn("n_share", F.round(K.n_share(F.col("w")), 6)).filter("n_share < 0.5").drop("w")


@query("pack_tokens", f"""WITH {SEQS}, d AS (SELECT doc_id, regexp_extract_all(seq, '.{{1,3}}') AS a, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch FROM seqs),
o AS (SELECT batch, a, doc_id, sum(len(a)) OVER (PARTITION BY batch ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(a) AS off FROM d), e AS (SELECT batch, off + i - 1 AS p, a[i] AS token FROM (SELECT batch, off, a, unnest(range(1, len(a) + 1)) AS i FROM o)),
b AS (SELECT batch, p // 256 AS block, count(*) AS n, md5(string_agg(token, ' ' ORDER BY p)) AS digest FROM e GROUP BY ALL) SELECT batch, CAST(block AS BIGINT) AS block, digest FROM b WHERE n = 256""")
def pack_tokens(spark, sf_dir):
    """Tokens of runs of 1,000 rows packed into blocks of 256."""
    p = K.pack(_toks(seqs(spark, sf_dir)), "doc_id", "tokens", 256)
    return p.select("batch", "block", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("pad_truncate", f"""WITH {SEQS}, t AS (SELECT doc_id, list_transform(regexp_extract_all(seq, '.{{1,3}}'), lambda x: length(x) + ascii(x)) AS a FROM seqs)
SELECT doc_id, array_to_string(list_concat(a[1:128], list_transform(range(greatest(0, 128 - len(a))), lambda x: 0)), ' ') AS ids, least(len(a), 128) AS attended FROM t""")
def pad_truncate(spark, sf_dir):
    """Ids cut or padded to 128, and their attention."""
    t = _toks(seqs(spark, sf_dir)).withColumn("a", F.transform("tokens", lambda x: F.length(x) + F.ascii(x)))
    p = t.select("doc_id", K.pad(F.col("a"), 128, 0).alias("p"))
    return p.select("doc_id", F.array_join("p", " ").alias("ids"), F.aggregate(K.attention(F.col("p"), 0), F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


@query("mlm_mask", f"""WITH {SEQS}, t AS (SELECT doc_id, list_transform(regexp_extract_all(seq, '.{{1,3}}'), lambda x: length(x) + ascii(x)) AS a FROM seqs), e AS (SELECT doc_id, a[i + 1] AS x, i, md5(concat('42:', doc_id, ':', i)) AS h FROM (SELECT doc_id, a, unnest(range(len(a))) AS i FROM t)),
u AS (SELECT doc_id, x, i, CAST('0x' || substring(h, 1, 7) AS BIGINT) < {int(0.15 * (1 << 28))} AND x NOT IN (0, 1, 2, 3, 4) AS hit, CAST('0x' || substring(h, 8, 7) AS BIGINT) AS v, CAST('0x' || substring(h, 15, 7) AS BIGINT) % 5120 AS r FROM e),
m AS (SELECT doc_id, string_agg(CASE WHEN NOT hit THEN x WHEN v < {int(0.8 * (1 << 28))} THEN 4 WHEN v < {int(0.9 * (1 << 28))} THEN r ELSE x END, ' ' ORDER BY i) AS ids, string_agg(CASE WHEN hit THEN x ELSE -100 END, ' ' ORDER BY i) AS labels FROM u GROUP BY doc_id)
SELECT t.doc_id, coalesce(ids, '') AS ids, coalesce(labels, '') AS labels FROM t LEFT JOIN m ON t.doc_id = m.doc_id""")
def mlm_mask(spark, sf_dir):
    """Masked ids and labels, seeded by row and position."""
    t = _toks(seqs(spark, sf_dir)).withColumn("ids", F.transform("tokens", lambda x: F.length(x) + F.ascii(x)))
    m = t.select("doc_id", K.mask(F.col("ids"), F.col("doc_id"), 4, 5120, [0, 1, 2, 3, 4]).alias("m"))
    return m.select("doc_id", F.array_join(F.transform("m", lambda s: s["id"]), " ").alias("ids"), F.array_join(F.transform("m", lambda s: s["label"]), " ").alias("labels"))


@query("eval_windows", f"""WITH {SEQS_N}, l AS (SELECT doc_id, seq, least(length(seq), length(seq) - doc_id % 3) AS n FROM seqs_n), w AS (SELECT doc_id, substring(seq, 1, CAST(n AS BIGINT)) AS seq, n, unnest(range(CAST(n + 3 AS BIGINT) // 4)) * 4 AS s FROM l WHERE n > 0),
x AS (SELECT doc_id, s, substring(seq, CAST(s + 1 AS BIGINT), 4) AS seq FROM w) SELECT doc_id, s AS "start", s + length(seq) AS "end", CAST(length(seq) AS BIGINT) AS length, seq, round(list_avg([((i * 7 + doc_id) % 11 - 5) / 5.0 FOR i IN range(s, s + length(seq))]), 6) AS mean_score FROM x WHERE NOT contains(seq, 'N')""")
def eval_windows(spark, sf_dir):
    """Windows with their place and the scores under them; windows with N go, the longer of sequence and scores is cut."""
    d = seqs_n(spark, sf_dir)
    n = F.length("seq") - F.col("doc_id") % 3
    scores = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: ((i * 7 + F.col("doc_id")) % 11 - 5) / F.lit(5.0)))
    w = D.eval_windows(d.withColumn("scores", scores), "doc_id", "seq", "scores", 4)
    return w.withColumn("mean_score", F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.col("length"), 6)).drop("scores")


@query("chat_messages", """SELECT item_id, '{"messages":[{"role":"system","content":"Classify."},{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '},{"role":"assistant","content":"' || (item_id % 2) || '"}]}' AS json FROM benchmark""")
def chat_messages(spark, sf_dir):
    """Examples as three-message records."""
    d = read(spark, sf_dir, "benchmark").withColumn("answer", (F.col("item_id") % 2).cast("string"))
    return D.chat(d, "Classify.", "text", "answer").select("item_id", "json")


@query("conversation_records", "SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def conversation_records(spark, sf_dir):
    """Conversations gathered in turn order (a conversation is a bounded record)."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.size("m").cast("long").alias("turns"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("m", lambda x: x["text"]), "\n")).alias("digest"))


@query("classification_metrics", """WITH p AS (SELECT quality AS y, toxic AS h FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS t, (SELECT count(*) FROM p WHERE h = c) AS q, (SELECT count(*) FROM p WHERE y = c AND h = c) AS hit FROM (SELECT y AS c FROM p UNION SELECT h FROM p)),
a AS (SELECT sum(t) AS s, sum(hit) AS c, sum(t * q) AS tp, sum(t * t) AS tt, sum(q * q) AS pp, avg(CASE WHEN q > 0 THEN hit / q ELSE 0 END) AS pr, avg(CASE WHEN t > 0 THEN hit / t ELSE 0 END) AS re, avg(CASE WHEN t + q > 0 THEN 2 * hit / (t + q) ELSE 0 END) AS f1 FROM k)
SELECT round(c / s, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END, 6) AS mcc FROM a""")
def classification_metrics(spark, sf_dir):
    """Accuracy, macro scores and correlation of two label columns."""
    m = S.classification(read(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query("masked_accuracy", "WITH p AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN -100 ELSE l_linenumber END AS y, CASE WHEN l_quantity > 20 THEN l_linenumber ELSE 0 END AS h, l_discount AS loss FROM lineitem) SELECT round(avg(CASE WHEN y = h THEN 1.0 ELSE 0 END), 6) AS accuracy, round(exp(avg(loss)), 6) AS perplexity, count(*) AS n FROM p WHERE y <> -100")
def masked_accuracy(spark, sf_dir):
    """Accuracy over unmasked labels and perplexity."""
    n = F.col("l_linenumber")
    p = read(spark, sf_dir, "lineitem").select(F.when(n % 3 == 0, -100).otherwise(n).alias("y"), F.when(F.col("l_quantity") > 20, n).otherwise(0).alias("h"), F.col("l_discount").alias("loss"))
    m = S.masked_accuracy(p, "y", "h", "loss")
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("perplexity", 6).alias("perplexity"), "n")


@query("complement", f"WITH {SEQS} SELECT doc_id, translate(seq, 'ACGT', 'TGCA') AS complement FROM seqs")
def complement(spark, sf_dir):
    """Complement, not reversed."""
    return seqs(spark, sf_dir).select("doc_id", C.complement("seq").alias("complement"))


@query("reverse_complement", f"WITH {SEQS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM seqs")
def reverse_complement(spark, sf_dir):
    """True reverse complement."""
    return seqs(spark, sf_dir).select("doc_id", C.reverse_complement("seq").alias("rc"))


@query("manifest_lookup", "SELECT s_suppkey, s_name FROM supplier WHERE lower(trim(s_name)) = lower(trim((SELECT min(s_name) FROM supplier)))")
def manifest_lookup(spark, sf_dir):
    """The one row that matches, in any case and trimmed."""
    m = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return D.manifest_row(m, s_name=f"  {m.agg(F.min('s_name')).first()[0].upper()} ")


@query("run_tag", "SELECT n_nationkey, replace(n_name || '/' || n_regionkey, '/', '_') || '_' || n_regionkey AS tag, lower(trim(CASE n_regionkey WHEN 0 THEN ' TRUE' WHEN 1 THEN 'Yes' WHEN 2 THEN '1' ELSE 'no' END)) IN ('true', '1', 'yes') AS flag FROM nation")
def run_tag(spark, sf_dir):
    """Folder tags and truth values."""
    r = F.col("n_regionkey")
    n = read(spark, sf_dir, "nation").withColumn("m", F.concat("n_name", F.lit("/"), r.cast("string"))).withColumn("f", F.when(r == 0, " TRUE").when(r == 1, "Yes").when(r == 2, "1").otherwise("no"))
    return n.select("n_nationkey", D.run_tag("m", "n_regionkey").alias("tag"), C.truthy("f").alias("flag"))
