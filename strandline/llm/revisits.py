"""WARC: resolution of not-modified revisits.

A revisit record says that a server answered 304 and stores no body.  It is joined as of its time to the latest
earlier full response of the same canonical URL; the validators of both are checked, and the headers of the two are
merged: the 304's headers replace the stored ones except those that describe the body or the connection.

As-of is a running "last full response" in two levels, so that one URL with a third of all records is spread: time is
cut at quantiles into slots, the running value inside (url, slot) is one window, and what earlier slots leave behind
is a second window over at most `slots` rows of a URL.  Bodies do not travel; the result names the record that has it.

Defined cases: a record with null url resolves to nothing; captured_at is a whole number (bigint), and a null one is the earliest;
order is (captured_at, record_id); of records equal in both, a response comes before a revisit, and of equal responses any
may be taken; a kind that is neither is no record of either sort; a validator that either side lacks is not compared, and
without any common validator a revisit is not resolved; of headers whose names differ in case alone the last in order of bytes
counts; very long texts are in bodies, which are not read; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that name a visit and not a page.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid"
# Headers that a 304 must not replace (they describe the stored body or one connection).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., port 80 or 443, then path without a final slash, then the sorted parameters.

    Scheme, fragment and tracking parameters do not count.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _lowered(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case alone the last in order of bytes counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(lowered, lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), e["key"]) == 0)
    return F.map_from_entries(last)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with those of the 304 over them, as far as a 304 may replace them; names in lower case."""
    permitted = F.map_filter(_lowered(fresh), lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(_lowered(stored), lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def resolve_revisits(records: DataFrame, slots: int = 256) -> DataFrame:
    """records: record_id, url, captured_at, kind (response or revisit), etag, last_modified, payload_digest, headers.

    One row per revisit: record_id, canonical_url, captured_at, outcome (resolved, validators differ, no earlier
    response), target_id, payload_digest and headers of the restored response, null where not resolved.
    """
    stored = F.struct("captured_at", "record_id", "etag", "last_modified", "payload_digest", "headers")
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "kind", "etag", "last_modified", "payload_digest", "headers",
    )
    cuts = [F.percentile_approx("captured_at", [i / slots for i in range(1, slots)], 10_000)] if slots > 1 else [F.array()]
    cuts = sorted(set(records.agg(*cuts).first()[0] or []))
    slot = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda x: x <= F.col("captured_at"))) if cuts else F.lit(0)
    rows = rows.withColumn("_slot", slot).withColumn("_full", F.when(F.col("kind") == "response", stored))
    earlier = Window.partitionBy("canonical_url", "_slot").orderBy("captured_at", "record_id", "kind").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_here", F.last("_full", ignorenulls=True).over(earlier)).where(F.col("kind") == "revisit")
    left = (
        rows.groupBy("canonical_url", "_slot")
        .agg(F.max_by("_full", F.when(F.col("kind") == "response", F.struct("captured_at", "record_id"))).alias("_last"))
        .withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)))
        .select("canonical_url", "_slot", "_carried")
    )
    # Windows put records without a URL together; the join does not.
    here = F.when(F.col("canonical_url").isNotNull(), F.col("_here"))
    found = inside.join(left, ["canonical_url", "_slot"], "left").withColumn("_base", F.coalesce(here, "_carried"))
    base = F.col("_base")
    checks = [
        F.when(F.col("etag").isNotNull() & base["etag"].isNotNull(), _strong(F.col("etag")) == _strong(base["etag"])),
        F.when(F.col("last_modified").isNotNull() & base["last_modified"].isNotNull(), F.col("last_modified") == base["last_modified"]),
        F.when(F.col("payload_digest").isNotNull() & base["payload_digest"].isNotNull(), F.col("payload_digest") == base["payload_digest"]),
    ]
    agreed = F.coalesce(*checks, F.lit(False))
    for check in checks:
        agreed = agreed & F.coalesce(check, F.lit(True))
    outcome = F.when(base.isNull(), "no earlier response").when(agreed, "resolved").otherwise("validators differ")
    found = found.withColumn("outcome", outcome)
    when = lambda c: F.when(F.col("outcome") == "resolved", c)
    return found.select(
        "record_id",
        "canonical_url",
        "captured_at",
        "outcome",
        when(base["record_id"]).alias("target_id"),
        when(base["payload_digest"]).alias("payload_digest"),
        when(merged_headers(base["headers"], F.col("headers"))).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: every page a full response, and three revisits a page in the ways that occur.

    A page of id i is captured at 100 * i.  Later its URL is visited again: at 100 * i + 40 with its own validators, at
    100 * i + 60 with another etag, and at 100 * i - 20 (before it) with its own.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    visit = lambda kind, step, tag, lengths: F.struct(
        (F.col("page_id") * 4 + step).alias("record_id"),
        F.lit(kind).alias("kind"),
        (F.col("page_id") * 100 + {0: 0, 1: 40, 2: 60, 3: -20}[step]).alias("captured_at"),
        tag.alias("etag"),
        F.create_map(F.lit("Content-Length"), lengths, F.lit("Date"), (F.col("page_id") * 100 + step).cast("string"), F.lit("X-Step"), F.lit(str(step))).alias("headers"),
    )
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    visits = F.array(
        visit("response", 0, etag, size), visit("revisit", 1, F.concat(F.lit("W/"), etag), F.lit("0")),
        visit("revisit", 2, F.lit('"other"'), F.lit("0")), visit("revisit", 3, etag, F.lit("0")),
    )
    return pages.select("url", digest.alias("_digest"), F.explode(visits).alias("v")).select(
        "url", "v.*", F.lit(None).cast("string").alias("last_modified"), F.when(F.col("v.kind") == "response", F.col("_digest")).alias("payload_digest"),
    )
