"""Resolving not-modified revisit records of web archives.

A revisit of the profile server-not-modified has no body.  It is given that of the latest
full response (status 200) to the same canonical URL with an earlier date, if the validators
agree: an ETag by weak comparison, else Last-Modified; a revisit that sends neither is
taken as it is and said to be unchecked.  The stored headers are then updated by those of
the revisit, except for the fields that a 304 must not change.

The as-of join never gathers one URL in one task: URLs and dates are range-partitioned
together, each partition finds the last response before each revisit, and only the last
response of each URL and partition is carried on to later partitions.

A record without URL or date matches nothing.  Of responses with the same URL and date the
greatest record id counts as the latest.  Null headers are no headers.  Repeated rows come
out as often as they go in, as long as they agree.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billrate.session import stage

NOT_MODIFIED = "server-not-modified"
# Fields a 304 does not change (hop-by-hop, or bound to the stored body).
KEPT = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """URL without scheme, user, ``www``, default port, fragment and final slash; host in
    lower case, query fields sorted.  What names no host stays as it is, but for the fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)", 1)
    host = F.regexp_replace(F.lower(host), r":(?:80|443)?$|^www\d*\.", "")
    host = F.regexp_replace(host, r":(?:80|443)?$", "")
    path = F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.split(query, "&", -1)), "&")
    named = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(bare.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), named).otherwise(bare)


def header_map(block: Column) -> Column:
    """Header lines as a map by lower-case name; repeated fields are joined by a comma."""
    fields = F.filter(
        F.transform(
            F.split(F.coalesce(block, F.lit("")), "\r?\n", -1),
            lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("k"),
                               F.trim(F.regexp_replace(s, "^[^:]*:?", "")).alias("v"), s.contains(":").alias("is")),
        ), lambda f: f["is"] & (f["k"] != ""),
    )
    names = F.array_distinct(F.transform(fields, lambda f: f["k"]))
    value = lambda n: F.array_join(F.transform(F.filter(fields, lambda f: f["k"] == n), lambda f: f["v"]), ", ")
    return F.map_from_arrays(names, F.transform(names, value))


def latest_before(events: DataFrame) -> DataFrame:
    """As-of join of ``events`` (url, date, full, record_id) with itself: every row that is not
    full gets ``source_id``, the last full row of its URL with an earlier date."""
    order = ["url", "date", "full", "record_id"]  # at one date what is not full comes first
    placed = stage(
        events.filter("url is not null and date is not null").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()), "captures",
    )
    last = F.max(F.when(F.col("full"), F.struct("date", "record_id")))
    block = Window.partitionBy("part", "url").orderBy("date", "full", "record_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(
        placed.groupBy("url", "part").agg(last.alias("last"))
        .withColumn("carried", F.max("last").over(earlier)).filter("carried is not null")
        .select("url", "part", "carried"), "captures-carried",
    )
    inside = placed.withColumn("inside", last.over(block)).filter(~F.col("full"))
    found = stage(
        inside.select("url", "part", "record_id", F.col("inside.record_id").alias("own")), "captures-inside"
    )
    return found.join(carried, ["url", "part"], "left").select(
        "record_id", F.coalesce("own", "carried.record_id").alias("source_id")
    )


def _join_named(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Left join by ``key`` in which rows without one, which find nothing, do not meet in one task."""
    found = rows.filter(F.col(key).isNotNull()).join(others, key, "left")
    return found.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def resolve(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit: record_id, url, source_id, verdict, headers, payload.

    ``records``: record_id, uri, date, type (response or revisit), profile, status, headers (a
    block of lines) and payload.  ``verdict`` is etag, last_modified or unchecked if resolved, else
    mismatch or no_response, and then headers are its own and the payload is null.

    A response without ``record_id`` cannot be named, so an earlier one that can is the source;
    a revisit without one stays, as no_response.
    """
    revisit = (F.col("type") == "revisit") & F.col("profile").contains(NOT_MODIFIED)
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    kinds = records.withColumn("full", full).withColumn("revisit", revisit).filter("full or revisit")
    events = kinds.select("record_id", canonical_url(F.col("uri")).alias("url"), "date", "full")
    sources = stage(latest_before(events).dropDuplicates(["record_id"]), "revisit-sources")
    own = records.filter(revisit).select("record_id", canonical_url(F.col("uri")).alias("url"), header_map(F.col("headers")).alias("new"))
    stored = records.filter(full).select(
        F.col("record_id").alias("source_id"), header_map(F.col("headers")).alias("old"), "payload"
    )
    # Bodies move once, in the join; only those of repeated records move to be made unique.
    twice = stage(
        stored.groupBy("source_id").agg(F.count("*").alias("n")).filter("n > 1").select("source_id"), "responses-twice"
    )
    once = stored.join(twice, "source_id", "left_anti").unionByName(
        stored.join(twice, "source_id", "left_semi").dropDuplicates(["source_id"])
    )
    pointed = stage(_join_named(own, sources, "record_id"), "revisits-pointed")
    both = _join_named(pointed, once, "source_id")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    new, old = (lambda k: F.col("new")[k]), (lambda k: F.col("old")[k])
    agree = lambda k, f: F.coalesce(f(new(k)) == f(old(k)), F.lit(False))
    verdict = (
        F.when(F.col("old").isNull(), "no_response")
        .when(new("etag").isNotNull(), F.when(agree("etag", weak), "etag").otherwise("mismatch"))
        .when(new("last-modified").isNotNull(),
              F.when(agree("last-modified", lambda c: c), "last_modified").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    done = F.col("verdict").isin("etag", "last_modified", "unchecked")
    permitted = F.map_filter("new", lambda k, v: ~k.isin(KEPT))
    merged = F.map_zip_with(F.col("old"), permitted, lambda k, a, b: F.coalesce(b, a))
    return both.withColumn("verdict", verdict).select(
        "record_id", "url", "source_id", "verdict", F.when(done, merged).otherwise(F.col("new")).alias("headers"),
        F.when(done, F.col("payload")).alias("payload"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl of ``pages``: each page answers in full once, and later a
    revisit under another spelling of its URL is told that nothing changed.

    Pages are captured in the order of their ids, a minute apart.  A revisit comes up to a week
    later; of seven, two name a stale ETag, one sends Last-Modified alone and one no validator.
    """
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    tag = F.md5(F.coalesce("html", F.lit("")))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    seen = F.concat(F.lit("t"), at.cast("string"))
    respond = F.concat(
        line("Content-Type", F.lit("text/html")), line("ETag", F.concat(F.lit('"'), tag, F.lit('"'))),
        line("Last-Modified", seen), line("Content-Length", F.length(F.coalesce("html", F.lit(""))).cast("string")),
        line("Cache-Control", F.lit("max-age=60")),
    )
    kind = F.pmod("page_id", F.lit(7))
    delay = F.pmod(F.col("page_id") * 7919, F.lit(604_800)) + 30
    stale = F.when(kind < 2, F.lit("0")).otherwise(F.lit(""))
    told = F.concat(
        F.when(kind < 5, line("ETag", F.concat(F.lit('W/"'), tag, stale, F.lit('"')))).otherwise(""),
        F.when(kind == 5, line("Last-Modified", seen)).otherwise(""),
        line("Content-Length", F.lit("0")), line("Cache-Control", F.lit("max-age=120")),
        line("Date", F.concat(F.lit("t"), (at + delay).cast("string"))),
    )
    other = F.concat(F.regexp_replace("url", r"^https?://(?:www\.)?", "HTTPS://WWW."), F.lit("#again"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.col("url").alias("uri"), at.alias("date"),
        F.lit("response").alias("type"), F.lit("").alias("profile"), F.lit(200).alias("status"),
        respond.alias("headers"), F.col("html").alias("payload"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), other.alias("uri"), (at + delay).alias("date"),
        F.lit("revisit").alias("type"), F.lit(NOT_MODIFIED).alias("profile"), F.lit(304).alias("status"),
        told.alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)
