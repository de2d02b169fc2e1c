"""Not-modified revisits (1): an as-of join to the latest earlier full response of the same canonical URL.

Captures of a URL are dealt by (URL, time bucket). Inside a bucket a window finds
the latest earlier response; for the first captures of a bucket it comes from the
earlier buckets of the URL, of which there are a bounded number of one-row
summaries. So a URL with a third of all captures is spread over time, and only
narrow columns are sorted; headers are joined to the pairs afterwards.

The revisit's validators are then checked: its entity tag (weak comparison) if it
has one, else its last-modified date. Where they agree, the record gets the
response's headers, overlaid with those that a 304 may update.

Defined cases: a revisit without an earlier response is ``orphan``, also if its
url or time is null; one without validators is ``unchecked`` and merged like a
resolved one; a validator that differs, or that the response lacks, gives
``changed`` and the revisit's own headers. Of responses at the same time the one
with the greatest id counts; a response at the very time of the revisit is not
earlier. Null header maps are empty; header names ignore case (of two that differ
in case only, the first in byte order is taken). Repeated revisits are resolved
row by row; repeated responses count once. Null ids are handed through for
revisits; a response without an id cannot be referred to and is not used.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.operators.numbering import range_bucket
from taskloom.session import written

# The header fields that a 304 response carries for the stored one to take over.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, trailing slashes and tracking parameters; parameters sorted."""
    text = F.regexp_replace(url.cast("string"), r"#[\s\S]*$", "")
    text = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(text, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(text, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(text, r"^[^?]*\?([\s\S]*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def lowered(headers: Column) -> Column:
    """Header map with small names; of names that differ in case only the first is taken."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    small = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(small, lambda e, i: ~F.exists(F.slice(small, 1, i), lambda b: b["key"] == e["key"]))
    return F.map_from_entries(first)


def merged(stored: Column, update: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """Stored headers, overlaid with the permitted ones of the update; both with small names."""
    new = F.map_filter(update, lambda k, v: k.isin(*permitted) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(new, k)), new)


def resolve(records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts",
            status_col: str = "status", headers_col: str = "headers", full: int = 200, revisit: int = 304) -> DataFrame:
    """One row a revisit: record_id, url_key, ts, state (resolved, unchecked, changed, orphan), source_id (the
    response it stands for, where resolved or unchecked) and headers (a map with small names). Times are bigint.
    """
    rows = records.select(
        F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("key"), F.col(time_col).cast("long").alias("at"),
        F.col(status_col).alias("status"), F.col(headers_col).alias("headers")).where(F.col("status").isin(full, revisit))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    narrow = rows.where("key is not null and at is not null").select("row", "id", "key", "at", "status")
    answer = F.when((F.col("status") == full) & F.col("id").isNotNull(), F.struct("at", "id"))
    narrow = narrow.withColumn("bucket", range_bucket(narrow, "at")).withColumn("answer", answer)
    cells = narrow.groupBy("key", "bucket").agg(F.max("answer").alias("newest"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("carried", F.max("newest").over(before)).select("key", "bucket", "carried")
    inside = Window.partitionBy("key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    # A bucket's own responses are later than any carried one.
    found = narrow.withColumn("own", F.max("answer").over(inside)).where(F.col("status") == revisit).join(carried, ["key", "bucket"])
    pairs = written(found.select("row", F.coalesce("own", "carried")["id"].alias("source_id")).where("source_id is not null"), "warc-pairs")
    stored = rows.where((F.col("status") == full) & F.col("id").isNotNull()).groupBy(F.col("id").alias("source_id")).agg(
        F.min_by("headers", F.struct("at", "row")).alias("stored"))
    # A response that very many revisits refer to: both sides are dealt by the join, so Spark can split it.
    known = written(pairs.join(written(stored, "warc-stored"), "source_id").select("row", "source_id", "stored"), "warc-known")
    joined = rows.where(F.col("status") == revisit).join(known, "row", "left")
    joined = joined.withColumn("own", lowered(F.col("headers"))).withColumn("stored", F.when(F.col("source_id").isNotNull(), lowered(F.col("stored"))))
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    tag, tag_then = weak(F.col("own")["etag"]), weak(F.col("stored")["etag"])
    date, date_then = F.col("own")["last-modified"], F.col("stored")["last-modified"]
    agrees = F.when(tag.isNotNull(), F.coalesce(tag == tag_then, F.lit(False))).otherwise(F.coalesce(date == date_then, F.lit(False)))
    state = F.when(F.col("source_id").isNull(), "orphan").when(tag.isNull() & date.isNull(), "unchecked").when(agrees, "resolved").otherwise("changed")
    joined = joined.withColumn("state", state)
    usable = F.col("state").isin("resolved", "unchecked")
    return joined.select(
        F.col("id").alias("record_id"), F.col("key").alias("url_key"), F.col("at").alias("ts"), "state",
        F.when(usable, F.col("source_id")).alias("source_id"), F.when(usable, merged(F.col("stored"), F.col("own"))).otherwise(F.col("own")).alias("headers"))
