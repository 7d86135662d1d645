"""URL filters: pattern rules indexed by their rarest literal token; a URL's tokens fetch the few rules whose regular expressions run.

Two kinds of rules, one text each:

* sites, ``host/path``: the host and all its subdomains, where the path starts with the rule's;
* patterns over the lower-cased URL: ``||`` starts at a label of the host, ``|`` at the URL's start or end, ``*`` is any
  text, ``^`` a separator or the end, all else is literal; ``@@`` before it makes an exception (allow) of it.

A rule's literal tokens are the runs of a-z and 0-9 in it that must be whole runs in every URL that it fits. The one that
the fewest URLs of the table hold is its key; a rule without such a token is a candidate of every URL. A site beats a
pattern, the longest site wins, an exception beats a block, and no rule at all gives the default.

Everything is column functions: one pass over the URLs counts the rules' tokens, one explodes each URL's tokens, joins them
to the keys and runs the candidates' expressions; a row a URL and task is shuffled. Rows are grouped by their own number,
so a URL that holds a third of all rows is spread. Rules within ``BROADCAST_BYTES`` are broadcast, more are joined by shuffle.

Odd rows: a null or empty URL, or one without ``://``, has an empty host and path and gets the default verdict unless a
pattern fits its text; repeated rows stay apart; columns of any name are kept; an empty table gives none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import BROADCAST_BYTES, ascii_lower, fresh, written

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RUN = "[a-z0-9]+"
_WHOLE = "(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
_SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"

#: Site rules of the query (fixed values).
SITES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Patterns of the query: what a text corpus does without, and exceptions from that.
PATTERNS = [
    # shops and games that live on search spam
    "cheap-pills", "online-casino", "payday-loan", "replica-watches", "essay-writing-service", "free-robux", "||poker.", "||casino.", "||viagra.", "/buy-*-online^",
    "-without-prescription", "||xxx.", "||porn.", "||sex.", "||escort.", ".xxx^", ".porn^", ".adult^", ".casino^", ".bet^",
    # advertisements and counters
    "||ads.", "||ad.", "||adserver.", "||banner.", "||track.", "||tracker.", "||pixel.", "||click.", "/adserver/", "/doubleclick/",
    "/pagead/", "/banners/*.gif", "/ads/*.js", "/beacon.gif", "/pixel.gif|", "&adurl=", "?adurl=", "&clickid=", "?clickid=", "/redirect?*url=",
    # pages that are no text
    "/login^", "/signin^", "/signup^", "/register^", "/logout^", "/cart^", "/checkout^", "/basket^", "/wp-login.php", "/wp-admin/",
    "/cgi-bin/", "/xmlrpc.php", "/captcha^", "/password^*reset", "/.git/", "/.env|", "/server-status|", "/phpmyadmin/", "?sessionid=", "&sessionid=",
    "?phpsessid=", "&phpsessid=", ";jsessionid=", "?replytocom=", "&replytocom=", "?share=", "&share=", "/print/*?", "?print=1", "&print=1",
    # traps of endless pages
    "/calendar/*/*/*/*", "?month=*&year=", "&sort=*&sort=", "?sort=*&order=*&page=", "/page/*/page/", "/tag/*/tag/*/tag/", "&filter=*&filter=*&filter=",
    # files
    ".exe|", ".zip|", ".rar|", ".7z|", ".iso|", ".dmg|", ".apk|", ".mp3|", ".mp4|", ".avi|", ".jpg|", ".png|", ".gif|", ".css|", ".js|",
    # exceptions
    "@@||wikipedia.org^", "@@||gutenberg.org^", "@@||archive.org^", "@@/docs/login^", "@@/documentation/", "@@/calendar/reform^", "@@||ads.*/policy^", "@@/wiki/*.js|",
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, _URL, 1)), F.regexp_extract(u, _URL, 2)


def rule_table(spark: SparkSession, sites: list[tuple[str, str]], patterns: list[str]) -> DataFrame:
    """(site boolean, text, verdict) of rules in a Python list; a file of patterns may as well be read by Spark."""
    rows = [{"site": True, "text": t, "verdict": v} for v, t in sites] + [{"site": False, "text": t, "verdict": "allow" if t.startswith("@@") else "block"} for t in patterns]
    kind = "array<struct<site:boolean,text:string,verdict:string>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def compiled(rules: DataFrame) -> DataFrame:
    """(rank, site, text, verdict, regex, tokens) of rules (site, text, verdict): the greatest rank of those that fit decides."""
    body = F.regexp_replace(F.when(F.col("site"), F.col("text")).otherwise(ascii_lower(F.regexp_replace("text", "^@@", ""))), r"^\|\|?|\|$", "")
    raw = F.regexp_replace("text", "^@@", "")
    head = F.when(F.col("site"), r"^(?:[^/]*\.)?").when(raw.startswith("||"), _HOST).when(raw.startswith("|"), "^").otherwise("")
    tail = F.when(~F.col("site") & raw.endswith("|"), r"\z").otherwise("")
    plain = F.when(F.col("site"), F.col("text")).otherwise(body)
    literal = F.regexp_replace(plain, r"([\\.+?(){}\[\]$|])", r"\\$1")
    site_literal = F.regexp_replace(plain, r"([\\.+?(){}\[\]$|^*])", r"\\$1")
    glob = F.replace(F.replace(literal, F.lit("^"), F.lit(_SEPARATOR)), F.lit("*"), F.lit(".*"))
    marked = F.concat(F.when((head != ""), "|").otherwise("*"), ascii_lower(F.when(F.col("site"), F.replace(plain, F.lit("*"), F.lit("|"))).otherwise(plain)), F.when(tail != "", "|").otherwise("*"))
    d = rules.select(
        "site", "text", "verdict", F.concat(F.lit("(?s)"), head, F.when(F.col("site"), site_literal).otherwise(glob), tail).alias("regex"),
        F.array_distinct(F.regexp_extract_all(marked, F.lit(_WHOLE), 0)).alias("tokens"), F.when(F.col("site"), 3).when(F.col("verdict") == "allow", 2).otherwise(1).alias("tier"),
    )
    w = Window.orderBy("tier", F.when(F.col("site"), F.length("text")).otherwise(0), F.desc("text"))  # as many rows as rules
    return d.withColumn("rank", F.row_number().over(w).cast("long")).drop("tier")


def tokens(low: Column) -> Column:
    """The distinct tokens of a lower-cased URL, and the empty one, under which rules without a token stand."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(low, F.lit(_RUN), 0)))


def indexed(rules: DataFrame, lows: DataFrame, low: str) -> DataFrame:
    """The compiled rules with their key ``token``: of each rule's tokens the one in the fewest rows of ``lows``, then the longest."""
    keys = rules.select("rank", F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    held = lows.select(F.explode(tokens(F.col(low))).alias("token")).join(_sized(keys.select("token").distinct(), "token"), "token")
    n = held.groupBy("token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("rank").orderBy(F.coalesce("n", F.lit(0)), F.desc(F.length("token")), "token")
    key = keys.join(n, "token", "left").withColumn("at", F.row_number().over(w)).filter("at = 1").select("rank", "token")
    return rules.drop("tokens").join(key, "rank")


def _sized(d: DataFrame, *texts: str) -> DataFrame:
    """``d`` to be broadcast where its texts, and 100 bytes a row, are within ``BROADCAST_BYTES``."""
    size = d.agg(F.sum(sum((F.length(t) * 3 for t in texts), F.lit(100)))).first()[0] or 0
    return F.broadcast(d) if size <= BROADCAST_BYTES else d


def judge(df: DataFrame, url: str, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``df`` with ``host``, ``path``, ``rule`` (the site that decides, else null), ``pattern`` (or the pattern), ``verdict``.

    Columns of ``df`` with one of these names are replaced.
    """
    made = ["host", "path", "rule", "pattern", "verdict"]
    kept = [c for c in df.columns if c.lower() not in made]
    row, low, h, p = fresh([*df.columns, *made, "token", "rank", "site", "regex", "text"], "row", "low", "h", "p")
    host, path = parts(F.col(url))
    own = F.struct(*(F.col(c) for c in kept)) if kept else F.lit(None)
    u = df.select(F.monotonically_increasing_id().alias(row), own.alias("own"), host.alias(h), path.alias(p), ascii_lower(F.coalesce(F.col(url), F.lit(""))).alias(low))
    ready = compiled(rules)
    index = written(indexed(ready, u, low), "url-rules")
    always = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(False).alias("site"), F.lit(None).cast("string").alias("text"), F.lit(default).alias("verdict"), F.lit("").alias("regex"), F.lit("").alias("token"))
    index = index.select(*always.columns).unionByName(always)
    c = u.withColumn("token", F.explode(tokens(F.col(low)))).join(_sized(index.select("token", "rank", "site", "regex"), "token", "regex"), "token")
    c = c.filter(F.rlike(F.when(F.col("site"), F.concat(h, p)).otherwise(F.col(low)), F.col("regex")))
    best = c.groupBy(row).agg(F.max("rank").alias("rank"), F.first(F.struct(*(["own"] if kept else []), h, p)).alias("o"))
    out = best.join(_sized(index.select("rank", "site", "text", "verdict"), "text"), "rank")
    return out.select(
        *(F.col("o.own")[c].alias(c) for c in kept), F.col(f"o.{h}").alias("host"), F.col(f"o.{p}").alias("path"), F.when(F.col("site"), F.col("text")).alias("rule"), F.when(~F.col("site"), F.col("text")).alias("pattern"), "verdict",
    )
