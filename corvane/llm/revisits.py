"""Resolution of not-modified revisit records of web archives.

A revisit whose server said "not modified" has no body of its own. It takes that
of the latest earlier full response with the same canonical URL, if the
validators agree, and the headers that such an answer may renew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import hot_bound, join_by_key, materialize

#: Header fields that a not-modified answer may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track visitors.
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|ref)="
#: Slices of time into which the captures of a URL are dealt.
SLICES = 256


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without "www." or a default port, no fragment, no tracking parameters, the others sorted, no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^(?i:https?)://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def plain_headers(headers: Column) -> Column:
    """Names in lower case; of names that differ by case only, the last one; null as no headers."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, target_id, outcome, status, headers, body.

    records: record_id, kind ("response" or "revisit"), url, date (long or timestamp), status, headers (map), body;
    other columns are not read. Full responses are responses of status 200 with a body. Of two at the same time the
    greater record_id counts as later; a response at the revisit's own time is not earlier. outcome: "resolved"; "no
    validator" (neither entity tags nor modification dates on both sides), "mismatch", or "no response" (also for a null
    URL or date), and then there is no body. Entity tags compare weakly and go before dates. Repeated revisits give
    repeated rows. Of responses that share a record_id the earliest counts, of those the least URL, then the least hash of
    body and headers.
    """
    base = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.col("date").cast("long").alias("at"), "status", plain_headers(F.col("headers")).alias("headers"), "body")
    full = base.where((F.col("kind") == "response") & (F.col("status") == 200) & F.col("body").isNotNull() & F.col("url_key").isNotNull() & F.col("at").isNotNull())
    # Of responses that share an id one counts, the same wherever full is worked out.
    whole = [c for c in base.columns if c != "record_id"]
    rank = F.struct("at", "url_key", F.xxhash64("body", F.array_sort(F.map_entries("headers"))))
    full = full.groupBy("record_id").agg(F.min_by(F.struct(*whole), rank).alias("row")).select("record_id", *(F.col("row")[c].alias(c) for c in whole))
    # Written once, so that a revisit's number is the same wherever it is asked for.
    revisits = materialize(base.where("kind = 'revisit'").select("record_id", "url_key", "at", F.col("headers").alias("own")).withColumn("row", F.monotonically_increasing_id()), "revisits")
    bounds = base.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, span = bounds["low"] or 0, max(1, (bounds["high"] or 0) - (bounds["low"] or 0) + 1)
    part = F.least(F.lit(SLICES - 1), F.floor((F.col("at") - low) / F.lit(span) * SLICES)).cast("int")
    # Only moments go through the as-of join, each once, and a URL's moments are dealt into slices of time: a hot URL is no single group.
    moments = full.groupBy("url_key", "at").agg(F.max(F.struct("at", "record_id")).alias("seen")).withColumn("n", F.lit(0).cast("long"))
    asked_at = revisits.where("url_key is not null and at is not null").groupBy("url_key", "at").agg(F.count("*").alias("n"))
    events = moments.unionByName(asked_at, allowMissingColumns=True).withColumn("part", part)
    in_slice = Window.partitionBy("url_key", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    nearest = events.withColumn("before", F.max("seen").over(in_slice)).where("n > 0").select("url_key", "part", "at", "n", "before")
    ends = events.where("seen is not null").groupBy("url_key", "part").agg(F.max("seen").alias("last"))
    asked = nearest.select("url_key", "part").distinct()
    slices = asked.join(ends, ["url_key", "part"], "full")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    carried = slices.withColumn("carried", F.max("last").over(earlier)).select("url_key", "part", "carried")
    answers = nearest.join(carried, ["url_key", "part"], "left").select("url_key", "at", "n", F.coalesce("before", "carried")["record_id"].alias("target_id"))
    most = hot_bound(revisits.count())
    found = materialize(join_by_key(revisits, answers, ["url_key", "at"], F.col("row"), least=most), "found")
    # A response asked for by very many revisits is there several times, and each revisit asks one of them.
    copies = found.where("target_id is not null").groupBy("target_id").agg(F.floor(F.count("*") / most).alias("copies"))
    copies = materialize(copies.where("copies > 0"), "hot")  # at most a million
    asking = found.join(F.broadcast(copies), "target_id", "left").withColumn("copy", F.pmod(F.xxhash64("row"), F.coalesce("copies", F.lit(0)) + 1)).drop("copies")
    targets = full.select(F.col("record_id").alias("target_id"), F.col("headers").alias("theirs"), F.col("status").alias("target_status"), F.col("body").alias("target_body"))
    targets = targets.join(F.broadcast(copies), "target_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(0).cast("long"))))).drop("copies")
    out = asking.join(targets, ["target_id", "copy"], "left")
    tag, their_tag = F.col("own")["etag"], F.col("theirs")["etag"]
    date, their_date = F.col("own")["last-modified"], F.col("theirs")["last-modified"]
    outcome = (
        F.when(F.col("target_id").isNull(), "no response")
        .when(tag.isNotNull() & their_tag.isNotNull(), F.when(_opaque(tag) == _opaque(their_tag), "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & their_date.isNotNull(), F.when(F.trim(date) == F.trim(their_date), "resolved").otherwise("mismatch"))
        .otherwise("no validator")
    )
    renewed = F.map_filter("own", lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("theirs", lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    out = out.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return out.select("record_id", "url_key", "target_id", "outcome", F.when(good, F.col("target_status")).alias("status"), F.when(good, merged).otherwise(F.col("own")).alias("headers"), F.when(good, F.col("target_body")).alias("body"))
