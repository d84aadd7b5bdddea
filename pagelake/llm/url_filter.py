"""URL filters over dated lists: every capture is judged by the entries active when it was fetched.

A list's history is a table of changes (list, pattern, action add or remove, at).
Changes become validity intervals: an addition holds until the next change of the
same list and pattern. An address matches a pattern that is its host, a parent
domain of at least two labels, or its host with a prefix of its path by whole
segments. The as-of join looks up, for each of these keys and each list that
names it, the last change at or before the fetch; the interval it opens holds or
not.

A popular domain may have a third of all captures and any number of changes. So
no window runs over a key: rows meet by (list, pattern, hour). Inside an hour the
last change is carried forward; what was valid when the hour began comes from one
row per key and hour. Everything is DataFrame functions.

Defined results: a capture without a time, or with an address without scheme and
host, matches nothing and is kept. Changes with a null field are ignored; actions
other than add and remove too. At equal times remove wins, and a repeated change
counts once. Hosts ignore case, a port, user names and a final dot. Repeated
captures are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICE = "hour"

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def keys_of(host: Column, path: Column) -> Column:
    """The host, its parents of two labels or more, and the host with each prefix of the path's segments."""
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))),
        lambda i: F.concat_ws("/", host, F.array_join(F.slice(segments, 1, i), "/")),
    )).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, prefixes)))


_KEY = ["list", "pattern"]


def _sliced(at: str) -> Column:
    return F.date_trunc(SLICE, at)


def intervals(changes: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: still open) and active for every change that counts."""
    known = changes.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    one = known.groupBy(*_KEY, "at").agg(F.max("action").alias("action")).withColumn("slice", _sliced("at"))
    firsts = one.groupBy(*_KEY, "slice").agg(F.min("at").alias("first"))
    later = firsts.select(*_KEY, "slice", F.lead("first").over(W.partitionBy(*_KEY).orderBy("slice")).alias("later"))
    inside = F.lead("at").over(W.partitionBy(*_KEY, "slice").orderBy("at"))
    return one.withColumn("next", inside).join(later, [*_KEY, "slice"]).select(
        *_KEY, F.col("at").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"), (F.col("action") == "add").alias("active")
    )


def as_of(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """capture, list, pattern, valid_from and valid_to of the interval that holds each capture's time.

    ``captures`` has capture (unique), pattern and at.
    """
    lists = spans.select(*_KEY).distinct()
    asked = captures.join(lists, "pattern").select(*_KEY, "at", _sliced("at").alias("slice"), "capture")
    span = F.struct("valid_from", "valid_to", "active").alias("span")
    told = spans.select(*_KEY, F.col("valid_from").alias("at"), _sliced("valid_from").alias("slice"), span)
    ends = told.groupBy(*_KEY, "slice").agg(F.max_by("span", "at").alias("span"))
    steps = ends.unionByName(asked.select(*_KEY, "slice").distinct(), allowMissingColumns=True)
    steps = steps.groupBy(*_KEY, "slice").agg(F.first("span", ignorenulls=True).alias("span"))
    earlier = W.partitionBy(*_KEY).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    begun = steps.select(*_KEY, "slice", F.last("span", ignorenulls=True).over(earlier).alias("begun"))
    both = asked.unionByName(told, allowMissingColumns=True)
    upto = W.partitionBy(*_KEY, "slice").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    held = both.withColumn("inside", F.last("span", ignorenulls=True).over(upto)).where("capture IS NOT NULL")
    found = held.join(begun, [*_KEY, "slice"]).withColumn("held", F.coalesce("inside", "begun"))
    return found.where("held.active").select("capture", *_KEY, "held.valid_from", "held.valid_to")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds host, n_active (intervals that hold), lists (their names, sorted, comma-joined) and blocked.

    ``captures`` has page_id, url and fetched_at.
    """
    rows = captures.select("page_id", "url", "fetched_at").withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    groups = ["page_id", "url", "fetched_at", "host"]
    # Equal captures are looked up once and come back as often as they occur.
    rows = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("copies")).withColumn("capture", F.xxhash64(*groups))
    path = F.coalesce(F.regexp_extract("url", PATH, 1), F.lit(""))
    asked = rows.where("fetched_at IS NOT NULL").select(
        "capture", F.col("fetched_at").alias("at"), F.explode(keys_of(F.col("host"), path)).alias("pattern")
    )
    found = as_of(asked, intervals(changes)).groupBy("capture").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    out = rows.join(found, "capture", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        *groups, F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("lists").isNotNull().alias("blocked"),
    )
