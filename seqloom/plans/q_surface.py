"""Queries over slices of files, table functions in SQL, and a stream of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import motifs as M
from ..operators import tokenizers as T
from ..sources import slices
from ..streaming import token_stream
from .bindings import BASES, LETTERS, SEQS, SEQS_N, peaks, read, seqs_n
from .q_corpus import MOT, PK
from .q_tokens import MERGES, _merged
from .registry import query


@query("split_slices", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT CASE WHEN k < round_even(n * 0.05, 0) THEN 'validation' ELSE 'train' END AS split, o_orderkey FROM r UNION ALL SELECT 'ends', o_orderkey FROM r WHERE k < 10 OR k >= n - 10""")
def split_slices(spark, sf_dir):
    """The slices [:5%], [5%:] and [:10]+[-10:] of the orders as they are stored (in order of their keys), by the footers of their files."""
    at = f"{sf_dir}/orders.parquet"
    parts = {"validation": "orders[:5%]", "train": "orders[5%:]", "ends": "orders[:10]+orders[-10:]"}
    out = [slices.sliced(spark, {"orders": at}, s).select(F.lit(name).alias("split"), "o_orderkey") for name, s in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("sql_expand_motif", f"WITH {MOT} SELECT motif, variant FROM va")
def sql_expand_motif(spark, sf_dir):
    """2.12 X15: variants of the cleaned motifs by the table function ``expand_motif``, called for each row in SQL."""
    tables.register(spark)
    line = F.concat(F.regexp_replace("p_type", "E", "*"), F.lit(" "), "p_name")
    m = M.clean(read(spark, sf_dir, "part").select(line.alias("line")), "line", 2)
    return spark.sql("SELECT motif, variant FROM {m}, LATERAL expand_motif(motif, 5)", m=m)


@query("sql_expand_labels", f"""WITH {PK} SELECT 'drop' AS policy, peak_id, labels[1] AS label FROM pk WHERE len(labels) = 1 UNION ALL SELECT 'first', peak_id, labels[1] FROM pk WHERE len(labels) > 0
UNION ALL SELECT 'explode', peak_id, unnest(labels) FROM pk""")
def sql_expand_labels(spark, sf_dir):
    """2.12 F13: labels of the peaks by ``expand_labels`` for each row, and by ``peak_labels`` over a table argument."""
    tables.register(spark)
    return spark.sql(
        """SELECT policy, peak_id, label FROM {p}, LATERAL (SELECT explode(array('drop', 'first')) AS policy), LATERAL expand_labels(labels, policy)
        UNION ALL SELECT 'explode', peak_id, label FROM peak_labels(TABLE(SELECT peak_id, labels FROM {p}), 'explode')""",
        p=peaks(spark, sf_dir),
    )


@query("stream_tokens", f"WITH {SEQS} SELECT doc_id, replace(trim({_merged('seq')}, '<>'), '><', ' ') AS tokens FROM seqs")
def stream_tokens(spark, sf_dir):
    """2.11 T2: the sequences of all documents read, encoded and appended as a stream."""
    s = F.regexp_replace(F.translate(F.lower("text"), LETTERS, BASES), "[^ACGT]", "")
    rows = token_stream.source(spark, f"{sf_dir}/documents.parquet").select("doc_id", s.alias("seq"))
    encode = T.bpe_encoder(spark, MERGES, offsets=False)
    return token_stream.once(token_stream.tokenized(rows, "seq", lambda c: F.array_join(encode(c), " ")))


@query("unknown_check", f"WITH {SEQS_N} SELECT lang, count(*) AS n, count(*) FILTER (contains(seq, 'N')) AS unknown, CASE WHEN count(*) FILTER (contains(seq, 'N')) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM seqs_n GROUP BY lang")
def unknown_check(spark, sf_dir):
    """By language, how many sequences hold [UNK] once they are encoded with a vocabulary that lacks N."""
    encode = T.bpe_encoder(spark, MERGES, set("ACGT") | {a + b for a, b in MERGES})
    d = seqs_n(spark, sf_dir).select("lang", T.has_unknown(encode(F.col("seq"))).cast("long").alias("u"))
    g = d.groupBy("lang").agg(F.count("*").alias("n"), F.coalesce(F.sum("u"), F.lit(0)).alias("unknown"))
    return g.withColumn("verdict", F.when(F.col("unknown") > 0, "FAIL").otherwise("PASS"))
