"""WARC captures: a "not modified" revisit gets the latest earlier full response of its URL.

The as-of join runs in slices of time of a day: within a slice by a window over (url, slice); across
slices by a window over one row for each slice. So what one task sorts is bounded by a URL's captures
within one day, and by nothing else: a URL captured very often in a single day is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a 304 response that replace those of the stored response; all others are kept as stored.
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SLICE_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, ``/`` as empty path.

    A text that is no URL with a scheme and a host stays as it is, without its fragment.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path, query = F.regexp_replace(rest, r"\?.*$", ""), F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|ref)(?:=|$)"))), "&")
    path = F.when(path == "", "/").otherwise(path)
    return F.when(host == "", bare).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the first entry counts."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda d: d["key"] == e["key"]))
    return F.map_from_entries(F.filter(first, lambda e: e["value"].isNotNull()))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit with its base: revisit_id, url, base_id, status, headers.

    ``records`` has record_id long, kind (``response`` or ``revisit``), url, captured timestamp, and
    headers, a map. The base is the latest response of the same canonical URL captured before the revisit;
    of several at that time the one with the largest record_id. ``status`` is

    - ``resolved``: the validators agree. ETags are compared weakly (``W/`` is left off); without one in the
      revisit, Last-Modified decides;
    - ``mismatch``: they do not, or the response lacks the validator: the base is named, nothing merged;
    - ``unchecked``: the revisit brings no validator: merged like a resolved one;
    - ``no_base``: there is no earlier response.

    Headers are the base's, with the fields of MERGED taken from the revisit where it has them;
    null unless merged. A revisit with a null URL or time has no base, and a response without them
    is none; a null map is an empty one; rows of another kind are ignored. Repeated revisits are answered one by one. Extra
    columns are ignored, an empty table gives no rows.
    """
    rows = records.select(
        F.col("record_id").cast("bigint").alias("record_id"), "kind", canonical_url(F.col("url")).alias("url"),
        F.col("captured").cast("timestamp").alias("at"), F.coalesce(_lowered(F.col("headers")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"),
    )
    revisits = rows.where("kind = 'revisit'")
    findable = F.col("url").isNotNull() & F.col("at").isNotNull()
    sliced = rows.where(findable & F.col("kind").isin("revisit", "response")).withColumn(
        "slice", F.floor(F.unix_micros("at") / F.lit(SLICE_SECONDS * 1_000_000))
    )
    base = F.when(F.col("kind") == "response", F.struct("at", "record_id", "headers"))
    # Maps cannot be compared, so the latest response is found by its time and id alone.
    latest = sliced.where("kind = 'response'").groupBy("url", "slice").agg(
        F.max_by(F.struct("at", "record_id", "headers"), F.struct("at", "record_id")).alias("last")
    )
    earlier = latest.union(
        sliced.where("kind = 'revisit'").select("url", "slice").distinct()
        .withColumn("last", F.lit(None).cast(latest.schema["last"].dataType))
    )
    earlier = earlier.groupBy("url", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = earlier.select("url", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # Range frame to just before this time: a response of the same instant is not earlier.
    moment = Window.partitionBy("url", "slice").orderBy(F.unix_micros("at")).rangeBetween(Window.unboundedPreceding, -1)
    inside = F.max(F.when(F.col("kind") == "response", F.struct("at", "record_id"))).over(moment)
    met = sliced.withColumn("inside", inside).where("kind = 'revisit'").select("record_id", "url", "at", "slice", "headers", "inside")
    own = sliced.where("kind = 'response'").select(
        F.struct("at", "record_id").alias("inside"), "url", base.alias("near")
    ).dropDuplicates(["url", "inside"])
    placed = met.join(carried, ["url", "slice"], "left").join(own, ["url", "inside"], "left")
    found = placed.select("record_id", "url", "headers", F.coalesce("near", "carried").alias("base"))
    lost = revisits.where(~findable).select("record_id", "url", "headers", F.lit(None).cast(found.schema["base"].dataType).alias("base"))
    return found.union(lost).select("record_id", "url", "base", *_judged())


def _judged() -> list[Column]:
    new, old = F.col("headers"), F.col("base.headers")
    strip = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    agree = F.when(new["etag"].isNotNull(), strip(new["etag"]) == strip(old["etag"])).otherwise(F.trim(new["last-modified"]) == F.trim(old["last-modified"]))
    status = (
        F.when(F.col("base").isNull(), "no_base").when(new["etag"].isNull() & new["last-modified"].isNull(), "unchecked")
        .when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("mismatch")
    )
    taken = F.map_filter(new, lambda k, _: k.isin(*MERGED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(taken), k)), taken)
    return [status.alias("status"), F.when(status.isin("resolved", "unchecked"), merged).alias("headers")]


def resolved(records: DataFrame) -> DataFrame:
    """:func:`resolve_revisits` with its base flattened: revisit_id, url, base_id, base_at, status, headers."""
    return resolve_revisits(records).select(
        F.col("record_id").alias("revisit_id"), "url", F.col("base.record_id").alias("base_id"), F.col("base.at").alias("base_at"), "status", "headers"
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """WARC records from ``pages``: each page was answered in full, later twice with "not modified".

    A revisit spells the URL its own way, and carries an ETag, a date, a stale ETag or nothing, by its number.
    """
    page = F.col("page_id").cast("bigint")
    start = F.timestamp_seconds(F.lit(1_600_000_000) + page * 7_919 % 31_536_000)
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    modified = F.date_format(start, "yyyy-MM-dd HH:mm:ss")
    shouted = F.regexp_replace("url", "^https://", "HTTPS://")
    kinds = [
        (0, "response", 0, F.col("url"), {"ETag": etag, "Last-Modified": modified, "Content-Type": F.lit("text/html"), "Cache-Control": F.lit("max-age=60"), "Content-Length": F.octet_length("html").cast("string")}),
        (1, "revisit", 40_000, shouted, {"ETag": F.when(page % 4 == 0, '"stale"').when(page % 4 == 1, F.concat(F.lit("W/"), etag)), "Last-Modified": F.when(page % 4 == 2, modified), "Cache-Control": F.lit("max-age=120"), "Content-Length": F.lit("0")}),
        (2, "revisit", -3_600, F.concat("url", F.lit("#part")), {"ETag": etag, "Expires": F.lit("0"), "Server": F.lit("other")}),
    ]
    rows = F.array(*[
        F.struct(
            (page * 3 + i).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), (start + F.make_dt_interval(secs=F.lit(float(later)))).alias("captured"),
            F.map_filter(F.create_map(*[c for k, v in headers.items() for c in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("headers"),
        )
        for i, kind, later, url, headers in kinds
    ])
    return pages.select(F.explode(rows).alias("r")).select("r.*")
