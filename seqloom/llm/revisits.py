"""Not-modified revisit records resolved to the response they stand for.

Records are keyed by canonical URL. A revisit (a 304 answer stored without a body) refers to the latest full
response of its key with a strictly earlier time, the larger record id among equal times. Its validators are
checked against that response (weak comparison of entity tags; the modification date where there is no tag),
and on agreement the revisit's permitted headers update the stored ones.

Plan: records are dealt by range of (key, time), so that a URL with a third of all captures is cut into
slices like any other run of rows; the slices are windowed on their own and the last response before each
slice, one row for a key and slice, is carried over. No slice, key or host is ever gathered whole.

Defined results: null or blank URL: outcome ``no-url``; null time or no earlier response: ``no-earlier-response``;
no validator on the revisit: ``unvalidated`` (resolved, nothing to check); disagreement: ``validator-mismatch``,
with ``refers_to`` null and the revisit's own headers; repeated revisit rows each give a row; an empty table
gives an empty result; null headers count as none. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import written

#: Fields that a 304 must not change in a stored response (fixed values): framing of the stored body and hop-by-hop fields.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = r"^(utm_[^=]*|gclid|fbclid|phpsessid|sessionid|sid)(=|$)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, www, fragment, tracking parameters, trailing slash; parameters sorted."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    raw = F.regexp_extract(u, r"^([^/?]*)", 1)
    host, rest = F.lower(raw), F.substring(u, F.length(raw) + 1, F.length(u))
    for pattern in (r"^.*@", r":(80|443)?$", r"\.$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, pattern, "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r";jsessionid=[^/]*", ""), r"/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))), "&")
    return F.nullif(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored fields that the permitted update doesn't name, then the permitted update; order kept."""
    none = F.array().cast(HEADERS)
    ok = F.filter(F.coalesce(update, none), lambda h: ~F.lower(h["name"]).isin(*NOT_UPDATED))
    names = F.transform(ok, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(F.coalesce(stored, none), lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), ok)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts, kind 'response' or 'revisit', etag, last_modified, headers).

    Returns record_id, url_key, ts, refers_to, outcome, headers.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = records.select(
        "record_id", canonical_url(F.col("url")).alias("ukey"), "ts", (F.col("kind") == "response").cast("int").alias("full"), "etag", "last_modified", F.col("headers").cast(HEADERS).alias("headers")
    ).filter(F.col("full").isNotNull())
    keyed = F.col("ukey").isNotNull() & F.col("ts").isNotNull()
    # at equal times a revisit sorts before the responses: they are not earlier
    e = e.filter(keyed | (F.col("full") == 0)).repartitionByRange(n, "ukey", "ts", "full", "record_id").withColumn("slice", F.spark_partition_id())
    e = written(e, "revisits")
    kept = F.when((F.col("full") == 1) & keyed, F.struct("record_id", "etag", "last_modified", "headers"))
    by_slice = e.filter(keyed).groupBy("ukey", "slice").agg(F.max_by(kept, F.when(F.col("full") == 1, F.struct("ts", "record_id"))).alias("latest"))
    spread = e.filter(keyed).groupBy("ukey").agg(F.min("slice").alias("a"), F.max("slice").alias("b")).filter("a < b").select("ukey")
    carried = by_slice.join(spread, "ukey", "left_semi").withColumn("carried", F.last("latest", ignorenulls=True).over(Window.partitionBy("ukey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).drop("latest")
    run = Window.partitionBy("ukey", "slice").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    r = e.withColumn("own", F.last(kept, ignorenulls=True).over(run)).filter(F.col("full") == 0)
    r = r.join(carried, ["ukey", "slice"], "left").withColumn("stored", F.when(keyed, F.coalesce("own", "carried")))
    s = F.col("stored")
    by_tag, by_date = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    agrees = F.when(by_tag, F.coalesce(weak_tag(F.col("etag")) == weak_tag(s["etag"]), F.lit(False))).when(by_date, F.coalesce(F.col("last_modified") == s["last_modified"], F.lit(False)))
    outcome = F.when(F.col("ukey").isNull(), "no-url").when(s.isNull(), "no-earlier-response").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("validator-mismatch")
    found = outcome.isin("resolved", "unvalidated")
    return r.select(
        "record_id", F.col("ukey").alias("url_key"), "ts", F.when(found, s["record_id"]).alias("refers_to"), outcome.alias("outcome"),
        F.when(found, merge_headers(s["headers"], F.col("headers"))).otherwise(F.coalesce(F.col("headers"), F.array().cast(HEADERS))).alias("headers"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame, payload: str) -> DataFrame:
    """Adds the body of the response that each revisit refers to (null where unresolved)."""
    body = responses.select(F.col("record_id").alias("refers_to"), F.col(payload).alias("payload"))
    return resolved.join(body, "refers_to", "left")
