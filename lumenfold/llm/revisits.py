"""Not-modified revisit resolution for web archives (operator 2).

A revisit record stands for a response that the server said had not changed. It is joined
as of its time to the latest earlier full response of the same canonical URL; the join
holds if the validators agree, and the stored headers are then updated by those headers of
the revisit that may replace them.

The as-of join runs over seconds, not records: of each canonical URL and second, the full
response that counts there, made by an aggregate that combines before it shuffles. The
latest earlier one is a running maximum in the order of time. A URL with more than `HOT`
seconds is cut into `SLICES` slices of about as many seconds each, whatever their spread in
time, and the last full response of a slice is carried over to later ones; so no URL is
ever one group. A second of one URL with more than `HOT` revisits is dealt to `SALTS` parts.

Earlier means a strictly smaller captured_at; of responses at the same second the one with
the greatest record_id counts. Null and blank urls resolve to nothing. Records with a null
time are not earlier than any, and as revisits find nothing. Repeated records resolve each.
Records of other types, null ones too, and responses of another status than 200 are passed
over. Null headers are none. An empty table gives an empty result. Columns other than the
named ones aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, flag, lower_ascii, written

HOT, SLICES, SALTS = 100_000, 256, 64
#: Headers that describe the stored body or one connection, which a
#: not-modified answer can't replace.
NOT_REPLACED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that name a referrer, not a resource.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """Host without user, www and default port, path without a closing slash, query
    parameters sorted without the tracking ones; scheme and fragment don't count."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    return F.when(url.isNull() | (F.trim(url) == ""), None).otherwise(F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _strong(etag: Column) -> Column:
    """Weak comparison: the tag without its weakness mark."""
    return F.regexp_replace(etag, r"^W/", "")


def merge_headers(stored: Column, newer: Column) -> Column:
    """Arrays of (key, value), keys in lower case: stored ones, updated by newer ones
    where that is permitted; sorted by key."""
    allowed = F.filter(newer, lambda h: ~h["key"].isin(*NOT_REPLACED))
    names = F.transform(allowed, lambda h: h["key"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["key"])), allowed))


def resolve(records: DataFrame, hot: int = HOT) -> DataFrame:
    """records: record_id long, url, captured_at long (seconds), record_type ('response' or
    'revisit'), status int, etag, last_modified, digest, headers array<struct<key,value>>.

    One row for each revisit: record_id, canonical_url, refers_to, refers_at, outcome
    ('resolved', 'validator-mismatch', 'no-validator' or 'no-earlier-response'), matched_by
    ('etag', 'last-modified', 'digest' or null), headers (merged; the revisit's own where
    it isn't resolved).
    """
    headers = F.array_sort(F.coalesce(F.transform("headers", lambda h: F.struct(lower_ascii(h["key"]).alias("key"), h["value"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>")))
    named = records.select("record_id", canonical_url(F.col("url")).alias("u"), F.col("captured_at").alias("t"), "record_type", "status", "etag", "last_modified", "digest", headers.alias("headers"))
    timed = named.filter("u is not null and t is not null")
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    fields = F.struct("t", "record_id", "etag", "last_modified", "digest", "headers")
    revisit = F.col("record_type") == "revisit"
    used = timed.filter(full | revisit).withColumn("full", F.when(full, fields))
    seconds = written(used.groupBy("u", "t").agg(F.max("full").alias("full"), F.count_if(revisit).alias("n")), "captured-seconds")
    crowded = seconds.groupBy("u").agg(F.count("*").alias("seconds")).filter(F.col("seconds") > hot).select("u")
    cuts = seconds.join(crowded, "u", "left_semi").groupBy("u").agg(F.percentile_approx("t", [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts"))
    sliced = seconds.join(cuts, "u", "left").withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("t")))))
    before = Window.partitionBy("u", "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    here = sliced.withColumn("ref", F.max("full").over(before)).filter("n > 0").select("u", "t", "slice", "ref")
    # last response of each slice of a crowded URL, carried to the slices after it
    last = sliced.filter("cuts is not null").groupBy("u", "slice").agg(F.max("full").alias("full"))
    earlier = Window.partitionBy("u").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("u", "slice", F.max("full").over(earlier).alias("carried"))
    found = here.join(carried, ["u", "slice"], "left").select("u", "t", F.coalesce("ref", "carried").alias("ref"))
    key = F.xxhash64("u", "t")
    bursts = bit_filter(seconds.filter(F.col("n") > hot), key)
    dealt = lambda rows, salt: flag(rows, key, bursts, "burst").withColumn("salt", salt).drop("burst")
    asked = dealt(timed.filter(revisit), F.when(F.col("burst"), F.pmod(F.xxhash64("record_id", "etag"), F.lit(SALTS))).otherwise(0).cast("int"))
    found = dealt(found, F.explode(F.when(F.col("burst"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = asked.join(found, ["u", "t", "salt"])
    lost = named.filter("u is null or t is null").filter(revisit).withColumn("ref", F.lit(None).cast(met.schema["ref"].dataType))
    columns = ["record_id", "u", "etag", "last_modified", "digest", "headers", "ref"]
    return met.select(*columns).unionByName(lost.select(*columns)).select(*_outcome())


def _outcome() -> list[Column]:
    ref, by = F.col("ref"), F.lit(None).cast("string")
    verdict = F.lit("no-validator")
    for name, mine, theirs in (("digest", F.col("digest"), ref["digest"]), ("last-modified", F.col("last_modified"), ref["last_modified"]), ("etag", _strong(F.col("etag")), _strong(ref["etag"]))):
        both = mine.isNotNull() & theirs.isNotNull()  # the strongest validator that both have decides
        by = F.when(both, F.when(mine == theirs, name)).otherwise(by)
        verdict = F.when(both, F.when(mine == theirs, "resolved").otherwise("validator-mismatch")).otherwise(verdict)
    verdict = F.when(ref.isNull(), "no-earlier-response").otherwise(verdict)
    done = verdict == "resolved"
    return [
        F.col("record_id"), F.col("u").alias("canonical_url"), F.when(ref.isNotNull(), ref["record_id"]).alias("refers_to"), F.when(ref.isNotNull(), ref["t"]).alias("refers_at"),
        verdict.alias("outcome"), F.when(ref.isNotNull(), by).alias("matched_by"), F.when(done, merge_headers(ref["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    ]


DAY = 86_400


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A history of archive records for each page (page_id, url, html), about four a page.

    Pages are an hour apart in the order of page_id; kind is record_id modulo 8:
    0 a revisit before any response of the page, on every fifth page; 1 the first response;
    2 an error page, on every fourth; 3 a new version with other headers, on every second;
    4 another one at the same second, on every sixth; 5 a revisit at that second with the
    first version's validators, on every third; 6 a revisit half a day later with those of
    the newest version, or on every seventh page stale ones. What validates goes by page_id
    modulo 5: the entity tag (0 and 1), the time of last change (2), both (3), a digest (4);
    revisits of every eleventh page have none.
    """
    pid, kind = F.col("page_id"), F.col("kind")
    here = {0: pid % 5 == 0, 1: F.lit(True), 2: pid % 4 == 0, 3: pid % 2 == 0, 4: pid % 6 == 0, 5: pid % 3 == 0, 6: F.lit(True)}
    kinds = F.explode(F.array_compact(F.array(*[F.when(on, k) for k, on in here.items()])))
    base = pages.select(pid, "url", F.coalesce("html", F.lit("")).alias("html"), kinds.alias("kind"))
    newest = F.when(pid % 6 == 0, "c").when(pid % 2 == 0, "b").otherwise("a")
    version = F.when(kind == 2, "x").when(kind == 3, "b").when(kind == 4, "c").when((kind == 6) & (pid % 7 != 1), newest).otherwise("a")
    again, mode = kind.isin(0, 5, 6), pid % 5
    told = ~(again & (pid % 11 == 0))
    at = pid * 3600 + F.when(kind == 0, -100).when(kind == 2, 600).when(kind.isin(3, 4, 5), 1200).when(kind == 6, DAY // 2).otherwise(0)
    body = F.md5(F.concat("html", version).cast("binary"))
    etag = F.when(told & mode.isin(0, 1, 3), F.concat(F.when(again & (pid % 2 == 1), F.lit("W/")).otherwise(F.lit("")), F.lit('"'), F.substring(body, 1, 12), F.lit('"')))
    pair = lambda on, k, v: F.when(on, F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
    headers = F.array_compact(F.array(
        pair(F.lit(True), "Date", at), pair(F.lit(True), "Content-Length", F.when(again, 0).otherwise(1000 + pid % 100)), pair(F.lit(True), "Cache-Control", F.when(again, F.lit("max-age=60")).otherwise(F.lit("max-age=3600"))),
        pair(again, "Expires", at + 60), pair(again & (pid % 2 == 1), "Connection", F.lit("close")), pair(~again, "Content-Type", F.lit("text/html")), pair(~again, "X-Version", version), pair(~again & (kind != 3), "Server", F.concat(F.lit("s"), (pid % 3).cast("string"))),
    ))
    return base.select(
        (pid * 8 + kind).alias("record_id"), "url", at.alias("captured_at"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, 304).when(kind == 2, 404).otherwise(200).alias("status"), etag.alias("etag"),
        F.when(told & mode.isin(2, 3), F.concat(F.lit("day "), F.floor(pid / 24).cast("string"), version)).alias("last_modified"), F.when(told & (mode == 4), body).alias("digest"), headers.alias("headers"),
    )


def digest(resolved: DataFrame) -> DataFrame:
    """Flat columns of a resolution."""
    line = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "; ")
    return resolved.select("record_id", "canonical_url", "refers_to", "refers_at", "outcome", "matched_by", line.alias("headers"))
