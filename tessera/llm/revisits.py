"""Operator 5: resolving not-modified revisits in web archives.

A revisit record says that a url had not changed: it has headers and no payload. It is resolved by an as-of join: of all
full responses (status 200, with a payload) with its canonical url, the latest that is earlier (by capture time, then
record id). Its validators must agree: its ETag with the response's (weakly compared), or, without an ETag, its
Last-Modified. A resolved revisit gets the response's payload and headers, with those headers of its own in their place
that a not-modified answer may carry.

The as-of join does without a window over a whole url, which may have a third of all records: records are range
partitioned by url and time, each (partition, url) is scanned by itself, and what a url carries from one partition into
the next is one row a partition. Payloads join only at the end, by record id.

Verdicts of revisits: "resolved", "mismatch" (a validator differs), "no_validator" (none to compare), "no_response" (no
earlier full response). Other records have a null verdict and keep their payload and headers. Null urls resolve nothing.
Records with a null capture time come before all others. Repeated record ids are refused nowhere: each row is judged, and
a response id with several rows gives its least payload. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut

PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without a last slash, query without tracking parameters and sorted;
    no scheme, no fragment. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), ":(80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def _lowered(headers: Column) -> Column:
    """Headers with names in lower case; of equal names the last of the sorted values stays."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def as_of(records: DataFrame) -> DataFrame:
    """record_id, canonical_url, captured_at, kind, verdict, response_id of every row of `records` (record_id, url,
    captured_at, kind, status, headers, payload); with the headers and payload of revisits."""
    headers, again = _lowered(F.col("headers")), F.col("kind") == "revisit"
    slim = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "kind",
        ((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull()).alias("full"),
        F.regexp_replace(headers["etag"], "^W/", "").alias("etag"), headers["last-modified"].alias("modified"),
        F.when(again, headers).alias("headers"), F.when(again, F.col("payload")).alias("payload"),
    )
    slim = cut(slim.repartitionByRange("canonical_url", "captured_at", "record_id").withColumn("part", F.spark_partition_id()))
    response = F.struct("record_id", "etag", "modified")
    order = F.struct("captured_at", "record_id")
    here = W.partitionBy("part", "canonical_url").orderBy("captured_at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    seen = slim.withColumn("inside", F.last(F.when(F.col("full"), response), ignorenulls=True).over(here))
    ends = slim.groupBy("part", "canonical_url").agg(F.max_by(F.when(F.col("full"), response), F.when(F.col("full"), order)).alias("last"))
    before = W.partitionBy("canonical_url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("part", "canonical_url", F.last("last", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    met = seen.join(carried, ["part", "canonical_url"], "left").withColumn("r", F.coalesce("inside", "carried"))
    same = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), F.col("etag") == F.col("r.etag")).when(F.col("etag").isNull() & F.col("modified").isNotNull() & F.col("r.modified").isNotNull(), F.col("modified") == F.col("r.modified"))
    verdict = F.when(again, F.when(F.col("r").isNull() | F.col("canonical_url").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("no_validator"))
    met = met.select("record_id", "canonical_url", "captured_at", "kind", verdict.alias("verdict"), F.col("r.record_id").alias("r_id"), "headers", "payload")
    return met.withColumn("response_id", F.when(F.col("verdict") == "resolved", F.col("r_id"))).drop("r_id")


def resolve(records: DataFrame) -> DataFrame:
    """Every record with verdict, response_id, merged headers and payload. Only revisits are joined with anything; of the
    responses, only those that resolve one lend their payload."""
    out = ["record_id", "canonical_url", "kind", "verdict", "response_id", "headers", "payload"]
    found = cut(as_of(records).where("kind = 'revisit'").select(*out))
    others = records.where(~F.col("kind").eqNullSafe("revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "kind", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"), _lowered(F.col("headers")).alias("headers"), "payload")
    hits = found.where("verdict = 'resolved'")
    full = records.where("kind = 'response' and status = 200 and payload is not null").select(F.col("record_id").alias("response_id"), _lowered(F.col("headers")).alias("headers"), "payload")
    base = full.join(hits.select("response_id").distinct(), "response_id", "left_semi").groupBy("response_id").agg(F.min_by(F.struct("headers", "payload"), "payload").alias("base"))
    allowed = F.map_filter(F.col("headers"), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("base.headers"), lambda k, v: ~F.map_contains_key(allowed, k))
    filled = hits.drop("payload").join(base, "response_id").withColumns({"headers": F.map_concat(kept, allowed), "payload": F.col("base.payload")}).select(*out)
    return others.unionByName(filled).unionByName(found.where("verdict <> 'resolved'"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as archive records in the order of their ids: each is a full response; a third of them (by hash) are asked for
    again 10,000 places later, by another spelling of the url, and answered "not modified". The answers' ETags are those of
    the page's text, of an older version, or missing, by hash."""
    hashed = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 6), 16, 10).cast("int")
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(F.col("page_id") / 1000).cast("string"))

    def headers(**values: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()))
        return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))

    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured_at"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        headers(ETag=etag, Last_Modified=day, Date=day, Content_Length=F.length("html").cast("string")).alias("headers"), F.col("html").alias("payload"),
    )
    again = pages.where(hashed % 3 == 0).select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), (F.col("page_id") + 10_000).alias("captured_at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        headers(
            ETag=F.when(hashed % 5 == 0, F.lit('"older"')).when(hashed % 5 < 3, F.concat(F.lit("W/"), etag)),
            Last_Modified=F.when(hashed % 5 == 3, day),
            Date=F.concat(day, F.lit(" and later")),
            Cache_Control=F.lit("max-age=60"),
            Set_Cookie=F.lit("not permitted"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)
