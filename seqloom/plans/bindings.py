"""The domain's inputs bound onto the driver's tables: DataFrames here, the same views as DuckDB CTEs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3600
#: Bytes of a file for each core from which its own splits keep all cores busy.
FULL_SPLIT = 32 << 20


def spread(df: DataFrame, path: str) -> DataFrame:
    """Rows of a table that is small for the cluster, dealt out to all cores: its files may be a single row group, that is one task.

    A table of more than ``FULL_SPLIT`` bytes a core is left as it is read.
    """
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if size < cores * FULL_SPLIT else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- signal(chrom, start, end, score)
SIGNAL = """signal AS (SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 1 AS e, value AS score, event_id, user_id FROM events)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 1).alias("end"), F.col("value").alias("score"), "event_id", "user_id")


# --- regions(chrom, start, end, kind): half-hour intervals at high events
KINDS = ["promoter", "enhancer", "exon", "intron"]
REGION_MIN = 60.0
REGIONS = f"""regions AS (SELECT chrom, s, s + 1800 AS e, CASE user_id % 4 WHEN 0 THEN 'promoter' WHEN 1 THEN 'enhancer' WHEN 2 THEN 'exon' ELSE 'intron' END AS kind, event_id FROM signal WHERE score > {REGION_MIN})"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("user_id") % 4).cast("int") + 1)
    return signal(spark, sf_dir).filter(F.col("score") > REGION_MIN).select("chrom", "start", (F.col("start") + 1800).alias("end"), kind.alias("kind"), "event_id")


# --- seqs(doc_id, seq, lang, source): documents as nucleotides
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
SEQS = f"""seqs AS (SELECT doc_id, regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq, lang, source FROM documents)"""
SEQS_N = f"""seqs_n AS (SELECT doc_id, regexp_replace(regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[ \\n]', 'N', 'g'), '[^ACGTN]', '', 'g') AS seq, lang, source FROM documents)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), f"{sf_dir}/documents.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.regexp_replace(F.translate(F.lower("text"), LETTERS, BASES), "[^ACGT]", "")
    return _texts(spark, sf_dir).select("doc_id", s.alias("seq"), "lang", "source")


def seqs_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.regexp_replace(F.regexp_replace(F.translate(F.lower("text"), LETTERS, BASES), "[ \n]", "N"), "[^ACGTN]", "")
    return _texts(spark, sf_dir).select("doc_id", s.alias("seq"), "lang", "source")


# --- peaks(coord, labels)
PEAKS = """peaks AS (SELECT o_orderkey AS peak_id, concat('chr', 1 + o_custkey % 22, '-', 1 + o_orderkey % 1000, '-', 51 + o_orderkey % 1000 + o_custkey % 100) AS coord,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE concat(o_orderstatus, ', ', o_orderpriority) END AS labels FROM orders)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    coord = F.concat(F.lit("chr"), 1 + c % 22, F.lit("-"), 1 + k % 1000, F.lit("-"), 51 + k % 1000 + c % 100)
    labels = F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(F.concat("o_orderstatus", F.lit(", "), "o_orderpriority"))
    return read(spark, sf_dir, "orders").select(k.alias("peak_id"), coord.alias("coord"), labels.alias("labels"))


# --- tokens: 4-mers of the sequences, counted in sets
TOKENS = """tok AS (SELECT doc_id, lang, source, unnest([substring(seq, CAST(i AS BIGINT), 4) FOR i IN range(1, length(seq) - 2)]) AS token FROM seqs WHERE length(seq) >= 4),
tc AS (SELECT lang, token, count(*) AS cnt FROM tok GROUP BY ALL)"""


def token_counts(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(by..., token, cnt) of all 4-mers."""
    from ..operators.stats import kmer_counts

    return kmer_counts(seqs(spark, sf_dir), list(by), "seq", [4])


# --- vocabularies: k-mers of three groups of languages, the commonest first
VOCABS = """km AS (SELECT lang, unnest(flatten([[substring(h, CAST(i AS BIGINT), k) FOR i IN range(1, length(h) - k + 2)] FOR k IN range(1, 7)])) AS token FROM (SELECT lang, seq AS h FROM seqs)),
vc AS (SELECT CASE lang WHEN 'de' THEN 'c' WHEN 'en' THEN 'n' ELSE 'a' END AS pool, token, count(*) AS cnt FROM km WHERE token <> '' GROUP BY ALL)"""
POOLS = f"""{VOCABS},
vocab AS (SELECT pool, token, cnt, row_number() OVER (PARTITION BY pool ORDER BY cnt DESC, token) - 1 AS id FROM vc QUALIFY row_number() OVER (PARTITION BY pool ORDER BY cnt DESC, token) <= 500)"""
#: Capacity of a pool's vocabulary in the queries that build vocabularies.
POOL_SIZE = 500


def pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pool, token, cnt): every 1- to 6-mer of the pool's sequences and its occurrences."""
    from ..operators.stats import kmer_counts

    pool = F.when(F.col("lang") == "de", "c").when(F.col("lang") == "en", "n").otherwise("a")
    return kmer_counts(seqs(spark, sf_dir).select(pool.alias("pool"), "seq"), ["pool"], "seq", list(range(1, 7)))


def vocab(spark: SparkSession, sf_dir: str, size: int = POOL_SIZE) -> DataFrame:
    """(pool, token, cnt, id): the vocabulary of each pool, its ``size`` commonest k-mers by count and token."""
    rank = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("cnt"), "token"))  # counted k-mers: 5,460 a pool at most
    return pool_counts(spark, sf_dir).withColumn("id", (rank - 1).cast("long")).filter(F.col("id") < size)
