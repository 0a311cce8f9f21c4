"""WARC revisit records of "304 Not Modified": find the response each one stands for, and complete it.

An as-of join by canonical URL takes the latest earlier full response. The revisit's validators must agree
with that response's. A completed record has the response's payload and headers, with those headers of the
revisit that a 304 response may update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cartulary.llm.common import materialize

#: Headers that a 304 response may update (RFC 9110, section 15.4.5), and Last-Modified.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical(url: Column) -> Column:
    """host/path?query: without scheme, user, www., default port, fragment and tracking parameters; parameters sorted."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^:/?]+://([^/?]*)", 1)), "^([^@]*@)?(www[.])?", "")
    host = F.regexp_replace(host, ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^:/?]+://[^/?]*([^?]*)", 1)
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _opaque(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def as_of(revisits: DataFrame, responses: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """revisits with `found`: all columns of the response of equal key with the latest `at` before theirs.

    Of responses at one time the one with the greatest `order` counts. Rows are dealt by ranges of (key, at), so
    a key of any number of rows is spread: each range carries its last response on to the key's later ranges.
    """
    spark = revisits.sparkSession
    kept = F.struct(*[F.col(c) for c in (at, order, *[c for c in responses.columns if c not in (key, at, order)])])
    asked = F.struct(*[F.col(c) for c in revisits.columns])
    none_found, none_asked = [F.lit(None).cast(d.select(s.alias("s")).schema["s"].dataType) for d, s in ((responses, kept), (revisits, asked))]
    rows = responses.select(key, at, F.lit(1).alias("full"), kept.alias("response"), none_asked.alias("revisit")).union(
        revisits.select(key, at, F.lit(0).alias("full"), none_found.alias("response"), asked.alias("revisit"))
    )
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, F.col(key), F.col(at), F.col("full"), F.xxhash64("response", "revisit"))
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "captures-by-time")
    lasts = ranged.where("full = 1").groupBy(key, "part").agg(F.max("response").alias("last"))
    parts_met = ranged.select(key, "part").distinct().join(lasts, [key, "part"], "left")
    before = W.Window.partitionBy(key).orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    carried = parts_met.select(key, "part", F.max("last").over(before).alias("carried"))
    # at one time revisits sort first: a response is found if it is earlier
    within = W.Window.partitionBy(key, "part").orderBy(at, "full").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    local = ranged.withColumn("local", F.max("response").over(within)).where("full = 0")
    return local.join(carried, [key, "part"]).select("revisit.*", F.coalesce("local", "carried").alias("found"))


def resolve(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, url, captured, verdict, refers_to, payload_digest, headers.

    records: record_id, url, captured (seconds), kind ('response' or 'revisit'), status, etag, last_modified,
    payload_digest, headers (map with lower-case names). Full responses are those of status 200.
    verdict: resolved; validator_mismatch, if the entity tags (weak comparison) or, without one in the revisit,
    the modification dates differ; unvalidated, if the revisit has neither; no_response, if nothing is earlier.
    Only resolved rows have refers_to, payload_digest and headers. Rows without url or time are no_response as
    revisits and are ignored as responses. Repeated rows stay. An empty table gives no rows.
    """
    rows = records.withColumn("key", F.coalesce(canonical(F.col("url")), F.lit("")))
    asked = rows.where(F.col("kind") == "revisit").select("key", "record_id", "url", "captured", "etag", "last_modified", "headers")
    full = rows.where((F.col("kind") == "response") & (F.col("status") == 200) & (F.col("key") != "") & F.col("captured").isNotNull())
    # maps don't compare, so they travel as sorted entries
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    full = full.select("key", "captured", "record_id", "etag", "last_modified", "payload_digest", entries.alias("entries"))
    asked = asked.withColumn("entries", entries).drop("headers")
    joined = as_of(asked, full, "key", "captured", "record_id")
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(_opaque(F.col("etag")) == _opaque(F.col("found.etag")), F.lit(False))).when(
        F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False))
    )
    verdict = F.when(F.col("found").isNull(), "no_response").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("validator_mismatch")
    updates = F.filter("entries", lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(updates, lambda e: e["key"])
    merged = F.map_from_entries(F.array_sort(F.concat(F.filter(F.col("found.entries"), lambda e: ~F.array_contains(names, e["key"])), updates)))
    ok = F.col("verdict") == "resolved"
    return joined.withColumn("verdict", verdict).select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "captured",
        "verdict",
        F.when(ok, F.col("found.record_id")).alias("refers_to"),
        F.when(ok, F.col("found.payload_digest")).alias("payload_digest"),
        F.when(ok, merged).alias("headers"),
    )


def completed(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits as full WARC response records (text), with the payload of (record_id, payload)."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\r\n")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), lines, F.lit("\r\n\r\n"), F.col("payload"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <"), F.col("record_id"), F.lit(">\r\nWARC-Refers-To: <"), F.col("refers_to"), F.lit(">\r\nContent-Length: "))
    joined = resolved.where(F.col("verdict") == "resolved").join(payloads.select(F.col("record_id").alias("refers_to"), "payload"), "refers_to")
    return joined.select("record_id", F.concat(head, F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).alias("warc"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log made from a table of pages by fixed rules: each page as a response, and a later revisit of it.

    The revisit's validators depend on page_id % 4: the page's entity tag, the same as a weak one, only the
    modification date, or a tag that is out of date.
    """
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    later = at + (F.col("page_id") * 7919) % 10007 * 60 + 30
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    date = at.cast("string")
    case = F.col("page_id") % 4
    sent = F.when(case == 0, tag).when(case == 1, F.concat(F.lit("W/"), tag)).when(case == 3, F.lit('"old"'))
    full = F.create_map(
        *[F.lit(x) if isinstance(x, str) else x for x in ("content-type", "text/html", "content-length", F.octet_length("html").cast("string"), "etag", tag, "last-modified", date, "date", date, "cache-control", "max-age=60")]
    )
    brief = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in ("content-length", "0", "date", later.cast("string"), "cache-control", "max-age=120", "x-cache", "hit")])
    common = lambda kind, ident, when, status, etag, modified, digest, headers: pages.select(
        F.concat(F.lit(ident), F.col("page_id").cast("string")).alias("record_id"),
        "url",
        when.alias("captured"),
        F.lit(kind).alias("kind"),
        F.lit(status).alias("status"),
        etag.alias("etag"),
        modified.alias("last_modified"),
        digest.alias("payload_digest"),
        headers.alias("headers"),
    )
    none = F.lit(None).cast("string")
    return common("response", "p", at, 200, tag, date, F.sha1(F.col("html").cast("binary")), full).union(
        common("revisit", "r", later, 304, sent, F.when(case == 2, date), none, brief)
    )
