"""Resolution of WARC revisit records of the server-not-modified kind.

A revisit (a 304 answer, without content) stands for the latest full response of its URL before it. Captures are
matched by canonical URL in an as-of join: each revisit takes the last response before it in (ts, record_id) order.
Then the validators are checked, entity tags by weak comparison, or else the dates of last modification, and the
headers merged: the response's, replaced by those that a 304 is permitted to update.

The as-of join deals records by ranges of (URL, ts, record_id), so that one URL's records, however many, lie in several
parts. Within a part a window carries the last response forward; the last response of each URL and part, a row
each, is carried over the parts after it. No URL's records meet in one task.

Outcomes: ``resolved`` (a validator agrees), ``mismatch`` (it doesn't), ``unvalidated`` (none on both sides),
``no-earlier`` (no full response before it). Defined results: records with a null URL or time neither match nor are
matched (a revisit: ``no-earlier``); null headers are none; of repeated rows each revisit gets a row, and equal
responses are one; an empty table gives no rows; other columns of the input aren't returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecspark.llm.common import parts_for, stored

#: Headers of a 304 answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change the page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without ``/`` at its end, other parameters sorted."""
    found = F.locate("://", url)
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_replace(F.regexp_extract(after, "^[^?#]*", 0), "/+$", "")
    query = F.regexp_extract(after, "^[^?#]*\\?([^#]*)", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(host), "^www\\.", ""), ":(80|443)$", ""), path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that are then equal, the last holds. Null: none."""
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(names, lambda e, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def last_response(captures: DataFrame) -> DataFrame:
    """Revisits of ``captures`` (record_id, key, ts, full, payload) with ``last``: the payload of the last response before."""
    dealt = captures.repartitionByRange(parts_for(captures), "key", "ts", "record_id").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "captures")
    inside = W.partitionBy("part", "key").orderBy("ts", "record_id").rangeBetween(W.unboundedPreceding, W.currentRow)
    # rows of one (ts, record_id) are repeated rows of one record, which is a response or a revisit
    seen = dealt.withColumn("here", F.last(F.when(F.col("full"), F.col("payload")), ignorenulls=True).over(inside)).where(~F.col("full"))
    ends = dealt.groupBy("key", "part").agg(F.max_by("payload", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("end"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("key").alias("_key"), F.col("part").alias("_part"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    joined = seen.join(carried, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    return joined.withColumn("last", F.coalesce("here", "carried")).drop("_key", "_part", "here", "carried", "part")


def resolve(captures: DataFrame) -> DataFrame:
    """record_id, key, outcome, response_id and merged headers (as lines, sorted) of every revisit.

    ``captures``: record_id bigint, url string, ts bigint, kind ("response" or "revisit"), headers map<string,string>.
    """
    rows = captures.select("record_id", canonical(F.col("url")).alias("key"), "ts", (F.col("kind") == "response").alias("full"), lowered(F.col("headers")).alias("headers"))
    rows = rows.where("full IS NOT NULL").select("record_id", "key", "ts", "full", F.struct("record_id", "headers").alias("payload"))
    whole = "key IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL"
    met = last_response(rows.where(whole)).select("record_id", "key", "payload", "last")
    rest = rows.where(f"NOT ({whole}) AND NOT full").select("record_id", "key", "payload", F.lit(None).cast(met.schema["last"].dataType).alias("last"))
    own, old = F.col("payload.headers"), F.col("last.headers")
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    agrees = F.coalesce(tag(own) == tag(old), own["last-modified"] == old["last-modified"])
    outcome = F.when(F.col("last").isNull(), "no-earlier").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    new = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.when(outcome == "resolved", F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return met.union(rest).select("record_id", "key", outcome.alias("outcome"), F.col("last.record_id").alias("response_id"), lines.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its response, a minute after the page before, and a revisit thirty days later."""
    tag = F.when(F.col("html").isNotNull(), F.concat(F.lit('"'), F.md5("html"), F.lit('"')))
    day = lambda ts: F.concat(F.lit("t"), ts.cast("string"))
    ts = F.col("page_id") * 60
    response = F.struct((F.col("page_id") * 2).alias("record_id"), ts.alias("ts"), F.lit("response").alias("kind"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), day(ts)).alias("headers"))
    late = ts + 30 * 86_400
    revisit = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), late.alias("ts"), F.lit("revisit").alias("kind"), F.create_map(F.lit("Content-Type"), F.lit("none"), F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), day(late), F.lit("Cache-Control"), F.lit("no-cache")).alias("headers"))
    return pages.select("url", F.explode(F.array(response, revisit)).alias("c")).select("c.record_id", "url", "c.ts", "c.kind", "c.headers")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))


SQL = {
    "op6_warc_revisits": rf"""
    WITH p AS (SELECT page_id, html, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END AS rest FROM pages),
    q AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM p),
    r AS (SELECT *, substr(rest, length(host) + 1) AS after FROM q),
    s AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(after, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS params FROM r),
    u AS (SELECT page_id, md5(html) AS tag, regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(after, '^[^?#]*'), '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS key FROM s),
    m AS (SELECT v.page_id, v.key, v.tag, max(w.page_id) AS response FROM u v LEFT JOIN u w ON w.key = v.key AND w.page_id * 60 < v.page_id * 60 + 30 * 86400 GROUP BY ALL)
    SELECT 2 * m.page_id + 1 AS record_id, m.key,
      CASE WHEN response IS NULL THEN 'no-earlier' WHEN m.tag IS NULL OR u.tag IS NULL THEN 'unvalidated' WHEN m.tag = u.tag THEN 'resolved' ELSE 'mismatch' END AS outcome, 2 * response AS response_id,
      CASE WHEN m.tag = u.tag THEN 'cache-control: no-cache' || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || (m.page_id * 60 + 30 * 86400) || chr(10) || 'etag: W/"' || m.tag || '"' END AS headers
    FROM m LEFT JOIN u ON u.page_id = m.response
    """
}
