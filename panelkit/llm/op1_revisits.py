"""Not-modified revisit resolution of crawl records.

Each revisit (304) is joined as of its time to the latest earlier full response
of the same canonical URL, its validators are checked against that response, and
where they agree the response's headers are freshened with those of the revisit
that a 304 may replace.

The as-of join holds for a URL of any size: records are dealt by sampled
splitters on (URL, time, id), so a frequent URL takes several ranges; within a
range the last response is carried down by a window, and across ranges by a
window over one row per URL and range.  Only ids and validators take part in
that; headers are joined by record id afterwards.

Records: record_id long (unique), url string, ts timestamp, type string
("response" or "revisit", others are ignored), headers map<string,string>.
Earlier means less by (ts, record_id); records without a time or without a URL
with a host meet nothing.  Header names are compared in lower case, and of two
equal names the later entry holds.  NULL headers are none.  Other columns of the
input are ignored; empty tables give no rows; repeated record ids give a row
for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

# Fields of a 304 that never replace the stored ones: about the connection or
# about the body that a 304 does not have.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = r"^(utm_[a-z0-9_]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host[:port]/path[?query]: no scheme, fragment, user, `www.`, default port,
    trailing slash or tracking parameter; host in lower case, parameters sorted.
    NULL where there is no host."""
    rest = F.regexp_extract(F.trim(url), r"^(?i:https?)://(?:[^/?#@]*@)?([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path),
                                       F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def plain_headers(headers: Column) -> Column:
    """Lower-case names; the last of equal names holds."""
    low = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                      lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.filter(last, lambda e: e["value"].isNotNull()))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, replaced and joined by those a 304 may carry."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, response_id, status, validator, headers) per revisit.

    status: `resolved`; `mismatch`, where the validators differ; `no_response`.
    validator: what was compared, `etag` (weak comparison), `last-modified`, or
    `none` where the two have none in common: then the revisit is resolved on
    the URL alone.  headers: merged where resolved, else the revisit's own."""
    spark = records.sparkSession
    h = plain_headers(F.col("headers"))
    base = stage_table(records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "type", h.alias("headers")), "op1-records")
    etag = F.regexp_replace(F.element_at("headers", "etag"), r"^W/", "")
    line = base.select("record_id", "url_key", "ts", "type", etag.alias("etag"),
                       F.element_at("headers", "last-modified").alias("modified"))
    placed = line.filter("url_key is not null and ts is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage_table(placed.repartitionByRange(parts, "url_key", "ts", "record_id")
                        .withColumn("range", F.spark_partition_id()), "op1-ranges")
    response = F.when(F.col("type") == "response", F.struct(
        F.col("record_id").alias("id"), "etag", "modified"))
    before = Window.partitionBy("url_key", "range").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn("found", F.last(response, ignorenulls=True).over(before))
    # the last response of each range, carried to the later ranges of its URL
    ends = (dealt.filter("type = 'response'").groupBy("url_key", "range")
            .agg(F.max(F.struct("ts", F.col("record_id").alias("id"), "etag", "modified")).alias("end")))
    spans = dealt.select("url_key", "range").distinct().join(ends, ["url_key", "range"], "left")
    earlier = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("url_key", "range", F.last("end", ignorenulls=True).over(earlier).alias("end")).filter("end is not null")
    asof = (here.filter("type = 'revisit'").join(carried, ["url_key", "range"], "left")
            .select("record_id", F.coalesce("found", F.expr("named_struct('id', end.id, 'etag', end.etag, 'modified', end.modified)")).alias("r"),
                    "etag", "modified"))
    by_etag = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    by_time = F.col("modified").isNotNull() & F.col("r.modified").isNotNull()
    asof = asof.filter("r.id is not null").select(
        "record_id", F.col("r.id").alias("response_id"),
        F.when(by_etag, "etag").when(by_time, "last-modified").otherwise("none").alias("validator"),
        F.when(by_etag, F.col("etag") == F.col("r.etag")).when(by_time, F.col("modified") == F.col("r.modified"))
        .otherwise(True).alias("agrees"))
    revisits = base.filter("type = 'revisit'").select("record_id", "url_key", "headers")
    stored = base.filter("type = 'response'").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    j = revisits.join(asof.dropDuplicates(["record_id"]), "record_id", "left").join(stored.dropDuplicates(["response_id"]), "response_id", "left")
    status = F.when(F.col("response_id").isNull(), "no_response").when(F.col("agrees"), "resolved").otherwise("mismatch")
    return j.select("record_id", "url_key", "response_id", status.alias("status"), "validator",
                    F.when(F.col("agrees"), merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def header_text(headers: Column) -> Column:
    """`name: value` lines in order of name."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl records of a table of pages: each page is fetched once in full and
    once again later, when the server answers 304 with what it knows of that
    page.  A page of the same canonical URL fetched in between makes the two
    differ.  By page_id the server names an ETag and a time, a weak ETag, a time
    alone, or nothing."""
    kind = F.pmod(F.col("page_id"), F.lit(4))
    first = F.lit(1_600_000_000) + F.col("page_id") * 60
    again = first + 1 + F.pmod(F.col("page_id") * 7919, F.lit(500_000)) * 60
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    etag = F.when(kind == 0, F.concat(F.lit('"'), digest, F.lit('"'))).when(kind == 1, F.concat(F.lit('W/"'), digest, F.lit('"')))
    modified = F.when(kind.isin(0, 2), (first - 3600).cast("string"))

    def stamp(at: Column) -> Column:
        return F.concat(F.lit("t"), at.cast("string"))

    def record(id_: Column, type_: str, at: Column, headers: Column) -> Column:
        return F.struct(id_.alias("record_id"), F.col("url"), F.timestamp_seconds(at).alias("ts"), F.lit(type_).alias("type"),
                        headers.alias("headers"))

    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"),
                        F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Date"), stamp(first),
                        F.lit("Server"), F.lit("origin"), F.lit("ETag"), etag, F.lit("Last-Modified"), modified,
                        F.lit("X-Digest"), digest)
    short = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), stamp(again), F.lit("Connection"), F.lit("close"),
                         F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), etag, F.lit("Last-Modified"), modified)
    return pages.select(F.explode(F.array(
        record(F.col("page_id") * 2, "response", first, full),
        record(F.col("page_id") * 2 + 1, "revisit", again, short))).alias("x")).select("x.*")
