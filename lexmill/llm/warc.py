"""Resolution of not-modified revisits in web archives, in DataFrame operations only.

A revisit record (a 304 answer) has no body of its own: it stands for the latest earlier full response of the same canonical URL,
if its validators agree (its entity tag with the response's, else its Last-Modified date, else its payload digest).  The resolved
record takes the body's digest and length from the response, and of its own headers those that a 304 answer may update.

The as-of join is done in two steps, so that a URL with a third of all captures isn't one task: captures are dealt into
blocks of time, the last response of each block is carried to later blocks (a window over blocks, not rows), and inside a block
rows look back only in their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 answer may update; all others are the response's.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't change what a URL names.
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, http for https, no www., default port, fragment, user or tracking parameters; parameters sorted;
    no slash at the end of the path.  Null stays null; what isn't a URL only loses its fragment and blanks at its ends."""
    u = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"#.*$", "")
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?([^?]*)(?:\?(.*))?$"
    part = lambda k: F.regexp_extract(u, form, k)
    scheme = F.regexp_replace(F.lower(part(1)), "^https$", "http")
    host = F.regexp_replace(F.lower(part(2)), r"^www\.|\.$", "")
    port = F.regexp_replace(part(3), r"^:(?:80|443)?$", "")
    path = F.regexp_replace(part(4), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(5), "&"), lambda x: (x != "") & ~x.rlike("(?i)" + TRACKING))), "&")
    return F.when(u.rlike(form), F.concat(scheme, F.lit("://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(u)


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only the last counts.  Null is no headers."""
    given = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(given, lambda e: F.lower(e["key"])))
    value = lambda name: F.element_at(F.filter(given, lambda e: F.lower(e["key"]) == name), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def resolve_revisits(records: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """records with canonical, refers_to, status_of, merged headers, and the body's digest and length.

    records has record_id, url, time (timestamp or seconds as a number), kind ("response" or "revisit"), headers
    (map<string,string>), digest and length; other columns stay.  resolution is "response" for records of that kind, else
    "resolved", "no-response" (nothing earlier; of equal times the response counts as earlier), or "mismatch" (a validator
    that both have differs).  Of responses at one time the one with the greatest record_id is the latest.  A null url, time or kind resolves
    nothing: "unusable".  Repeated rows get equal results.  No rows give no rows.
    """
    t = F.col("time").cast("double") if dict(records.dtypes)["time"] not in ("timestamp_ntz",) else F.unix_micros(F.col("time").cast("timestamp")) / 1e6
    rows = records.withColumns({"canonical": canonical_url(F.col("url")), "__t": t, "__h": lower_keys(F.col("headers"))})
    usable = F.col("canonical").isNotNull() & F.col("__t").isNotNull() & F.coalesce(F.col("kind").isin("response", "revisit"), F.lit(False))
    rows = rows.withColumn("__b", F.floor(F.col("__t") / block_seconds))
    best = F.struct(F.col("__t").alias("t"), F.col("record_id").alias("id"), F.col("__h").alias("h"), F.col("digest").alias("digest"), F.col("length").alias("length"))
    responses = rows.where(usable & (F.col("kind") == "response"))
    pick = F.struct("__t", "record_id")
    last = responses.groupBy("canonical", "__b").agg(F.max_by(best, pick).alias("last"))
    revisits = rows.where(usable & (F.col("kind") == "revisit"))
    asked = revisits.select("canonical", "__b").distinct().withColumn("last", F.lit(None).cast(dict(last.dtypes)["last"]))
    blocks = last.unionByName(asked).groupBy("canonical", "__b").agg(F.first("last", True).alias("last"))
    carried = F.last("last", True).over(Window.partitionBy("canonical").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    carry = blocks.select("canonical", "__b", carried.alias("__carry"))
    own = Window.partitionBy("canonical", "__b").orderBy("__t", F.col("kind") == "revisit", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.where(usable).withColumn("__own", F.last(F.when(F.col("kind") == "response", best), True).over(own))
    found = inside.join(carry, ["canonical", "__b"], "left").withColumn("__r", F.when(F.col("kind") == "revisit", F.coalesce("__own", "__carry"))).drop("__own", "__carry")
    found = found.unionByName(rows.where(~usable).withColumn("__r", F.lit(None).cast(dict(found.dtypes)["__r"])))

    both = lambda name: (F.col("__h")[name].isNotNull() & F.col("__r.h")[name].isNotNull())
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    agrees = F.when(both("etag"), tag(F.col("__h")) == tag(F.col("__r.h"))).when(both("last-modified"), F.col("__h")["last-modified"] == F.col("__r.h")["last-modified"]).when(F.col("digest").isNotNull() & F.col("__r.digest").isNotNull(), F.col("digest") == F.col("__r.digest")).otherwise(True)
    resolution = F.when(~usable, "unusable").when(F.col("kind") == "response", "response").when(F.col("__r").isNull(), "no-response").when(agrees, "resolved").otherwise("mismatch")
    found = found.withColumn("resolution", resolution)
    resolved = F.col("resolution") == "resolved"
    update = F.map_filter("__h", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("__r.h"), lambda k, v: ~F.map_contains_key(update, k)), update)
    return found.withColumns({
        "refers_to": F.when(resolved, F.col("__r.id")),
        "merged": F.when(resolved, merged).otherwise(F.col("__h")),
        "body_digest": F.when(resolved, F.col("__r.digest")).otherwise(F.when(F.col("resolution") == "response", F.col("digest"))),
        "body_length": F.when(resolved, F.col("__r.length")).otherwise(F.when(F.col("resolution") == "response", F.col("length"))),
    }).drop("__t", "__h", "__b", "__r")
