"""Not-modified revisits of web captures: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismflow.llm import common

#: Ranges of time into which captures of a URL are dealt, so that no URL is one task's alone.
RANGES = 64
#: Header fields of a stored response that a 304 response doesn't replace: they describe the stored body (fixed values).
BODY_FIELDS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade", "warc-payload-digest")
#: Query parameters that name where a visitor comes from (fixed values).
VISITOR_FIELDS = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def canonical(url: F.Column) -> F.Column:
    """Host in lower case without www. or a default port, path without a slash at its end, and the sorted query without
    visitor fields. The scheme and fragment don't count. What isn't such a URL is its own canonical form."""
    part = lambda k: F.regexp_extract(url, URL, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r":(80|443)?$", ""), r"^www\.", "")
    query = F.array_sort(F.filter(F.split(F.regexp_replace(part(4), r"^\?", ""), "&"), lambda x: (x != "") & ~x.rlike(VISITOR_FIELDS)))
    own = F.concat(host, F.regexp_replace(part(3), "/+$", ""), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(url.rlike(URL), own).otherwise(url)


def lowered(headers: F.Column) -> F.Column:
    """Headers with names in lower case; of equal names the last one's value."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda out, e: F.concat(F.filter(out, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def latest_earlier(captures: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``captures`` (record_id, url_key, at, full and more) with before: the record_id of the last full one of the URL that is earlier.

    Order is by time, then record_id. Captures of a URL are dealt by ranges of time that hold about as many of all captures each; what a range passes on is one row.
    A URL with a large part of all captures so has as many ranges as its part, however close in time they are.
    """
    bounds = captures.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)], F.lit(100 * ranges))).first()[0]
    bounds = sorted(set(bounds or []))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("at"))) if bounds else F.lit(0)
    dealt = captures.withColumn("range", place)
    last = dealt.where("full").groupBy("url_key", "range").agg(F.max(F.struct("at", "record_id")).alias("last"))
    # One row for each range that has captures: the last full one of the ranges before.
    order = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    passed = dealt.select("url_key", "range").distinct().join(last, ["url_key", "range"], "left").select("url_key", "range", F.last("last", ignorenulls=True).over(order).alias("passed"))
    inside = Window.partitionBy("url_key", "range").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.last(F.when(F.col("full"), F.struct("at", "record_id")), ignorenulls=True).over(inside))
    return own.join(passed, ["url_key", "range"], "left").withColumn("before", F.coalesce("own", "passed")["record_id"]).drop("range", "own", "passed")


def resolve(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Revisits of ``records`` (record_id, url, at, kind, headers map, payload), each with what it stands for.

    Returns record_id, url_key, before (record_id of the latest earlier response of the canonical URL), outcome, headers, payload.
    Outcome is ``resolved``; ``no response`` if there is none earlier; ``changed`` if a validator that both have differs, or they share none:
    ETags are compared weakly, and decide alone if both have one, else Last-Modified does.
    Resolved ones get the response's payload and its headers, with those of the revisit put over them but for the fields that describe the body.
    Revisits that aren't resolved keep their own headers and have no payload. Each revisit row gives one row, repeated ones too; of responses with one record id
    the payload of any counts once. Records with a null id, time or URL are left out, and null headers are empty. Other columns are ignored; an empty table gives an empty result.
    """
    records = records.where("record_id IS NOT NULL AND at IS NOT NULL AND url IS NOT NULL").select("record_id", canonical(F.col("url")).alias("url_key"), F.col("at").cast("bigint").alias("at"), F.col("kind").eqNullSafe("response").alias("full"), F.col("kind").eqNullSafe("revisit").alias("again"), lowered(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers"), "payload")
    mine = F.when(F.col("again"), F.col("headers")).alias("mine")
    asked = latest_earlier(records.select("record_id", "url_key", "at", "full", "again", mine), ranges).where("again").select("record_id", "url_key", "before", "mine")
    theirs = records.where("full").select(F.col("record_id").alias("before"), F.col("headers").alias("theirs"), "payload").dropDuplicates(["before"])
    # Revisits without a response have nothing to meet, and their null would be one task's.
    both = asked.where("before IS NOT NULL").join(theirs, "before", "left").unionByName(asked.where("before IS NULL"), allowMissingColumns=True)
    tag = lambda h: F.regexp_replace(F.element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.element_at(h, F.lit("last-modified"))
    same = F.coalesce(tag(F.col("mine")) == tag(F.col("theirs")), date(F.col("mine")) == date(F.col("theirs")), F.lit(False))
    outcome = F.when(F.col("before").isNull(), "no response").when(same, "resolved").otherwise("changed")
    over = F.map_filter("mine", lambda k, v: ~k.isin(*BODY_FIELDS))
    kept = F.map_filter("theirs", lambda k, v: ~F.array_contains(F.map_keys(over), k))
    both = both.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return both.select("record_id", "url_key", "before", "outcome", F.when(resolved, F.map_concat(kept, over)).otherwise(F.col("mine")).alias("headers"), F.when(resolved, F.col("payload")).alias("payload"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures made of ``pages`` (page_id, url, html), as the tables have no archive records: each page is fetched in full at
    the time of its number; 40 later it isn't modified, asked for by another form of its URL. One in five has another ETag by then, and
    one in seven only has a date."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    full = pages.select((2 * F.col("page_id")).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit("response").alias("kind"), F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), F.concat(F.lit("day "), F.col("page_id").cast("string")), F.lit("Content-Length"), F.octet_length("html").cast("string")).alias("headers"), F.col("html").alias("payload"))
    later = F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("Last-Modified"), F.concat(F.lit("day "), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0"))).when(F.col("page_id") % 5 == 0, F.create_map(F.lit("etag"), F.lit('"new"'), F.lit("Date"), F.lit("later"))).otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Date"), F.lit("later"), F.lit("Content-Length"), F.lit("0")))
    again = pages.select((2 * F.col("page_id") + 1).alias("record_id"), F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.coalesce(F.concat(F.lit("?utm_medium=x&"), F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(""))), F.lit(""))).alias("url"), (F.col("page_id") + 40).alias("at"), F.lit("revisit").alias("kind"), later.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(common.documents(spark, sf_dir, "pages")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "url_key", "before", "outcome", fields.alias("fields"), F.octet_length("payload").cast("bigint").alias("n_bytes"), F.sha2("payload", 256).alias("payload_sha256"))


OP4_SQL = r"""
WITH c AS (
  SELECT 2 * page_id AS record_id, url, page_id AS moment, TRUE AS "full", '"' || md5(html) || '"' AS etag, 'day ' || page_id AS modified, html FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '[?#].*$', '') || coalesce('?utm_medium=x&' || nullif(regexp_extract(url, '\?([^#]*)', 1), ''), ''), page_id + 40, FALSE,
         CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"new"' ELSE '"' || md5(html) || '"' END, CASE WHEN page_id % 7 = 0 THEN 'day ' || page_id END, NULL FROM pages
), p AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS place,
         list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS query FROM c
), k AS (
  SELECT *, place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS url_key FROM p
), w AS (
  SELECT *, last_value(CASE WHEN "full" THEN record_id END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY moment, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "before" FROM k
), r AS (
  SELECT w.record_id, w.url_key, w."before", w.etag AS e, w.modified AS m, k.etag AS e2, k.modified AS m2, k.html AS html,
         CASE WHEN w."before" IS NULL THEN 'no response' WHEN coalesce(w.etag = k.etag, w.modified = k.modified, FALSE) THEN 'resolved' ELSE 'changed' END AS outcome
  FROM w LEFT JOIN k ON k.record_id = w."before" WHERE NOT w."full"
)
SELECT record_id, url_key, "before", outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-length=' || strlen(html) || CASE WHEN e IS NULL THEN ';etag=' || e2 || ';last-modified=' || m ELSE ';date=later;etag=W/' || e || ';last-modified=' || m2 END
       WHEN e IS NULL THEN 'content-length=0;last-modified=' || m WHEN e = '"new"' THEN 'date=later;etag="new"' ELSE 'content-length=0;date=later;etag=W/' || e END AS fields,
  CASE WHEN outcome = 'resolved' THEN strlen(html) END AS n_bytes, CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256
FROM r
"""
