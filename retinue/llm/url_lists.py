"""URL filtering against dated lists: an as-of join of captures with the entries valid at fetch time.

List entries are dated changes of a key, a domain or a single address. The
changes of a key become validity intervals; each capture is evaluated against
the intervals of all its keys at its own fetch time, and the most specific one
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retinue.llm.spread import spread_join
from retinue.session import materialise

#: Time units (seconds here) of a bucket. Intervals are cut at bucket limits, so
#: that captures of one key in different buckets meet in different tasks.
BUCKET = 30 * 86_400
#: Of changes of one key at the same time the first of these holds.
ACTIONS = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; empty if there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""))


def address_of(url: Column) -> Column:
    """Host and path, without query, fragment and closing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/+$", ""))


def keys_of(url: Column) -> Column:
    """What a list may name to match a capture: its host, the domains above it, its address."""
    labels = F.split(host_of(url), r"\.")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(domains, F.array(address_of(url))))


def intervals(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``<key, action, valid_from, valid_to>``: each change holds until the next of its key (null: still).

    The next change is looked up within a bucket of time first and, for the last
    change of a bucket, among the first changes of the key's buckets; so the
    history of one key need not fit one task.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    named = entries.select("key", F.col("time").cast("long"), "action").filter("key IS NOT NULL AND time IS NOT NULL").filter(rank > 0)
    best = F.min(F.struct(rank.alias("rank"), "action")).alias("best")
    changes = named.groupBy("key", "time").agg(best).select("key", "time", "best.action")
    changes = changes.withColumn("part", F.floor(F.col("time") / bucket))
    inside = Window.partitionBy("key", "part").orderBy("time")
    changes = changes.withColumn("next", F.lead("time").over(inside))
    firsts = changes.groupBy("key", "part").agg(F.min("time").alias("first"))
    later = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("key").orderBy("part"))).drop("first")
    joined = changes.join(later, ["key", "part"])
    return joined.select("key", "action", F.col("time").alias("valid_from"), F.coalesce("next", "later").alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``<page_id, url, fetched, n_rows, n_active, key, action, valid_from, kept>``, one row per distinct capture.

    ``captures`` is ``<page_id, url, fetched>``, ``entries`` ``<key, time, action>``
    with an action of ``ACTIONS``; times are whole numbers of one unit. Of the
    active (not removed) entries the one with the longest key decides, and a
    capture is kept unless that one blocks. ``n_active`` counts the active entries.

    * ``n_rows`` tells how often a repeated capture occurs.
    * A capture without a URL or fetch time matches nothing and is kept.
    * Entries without key or time, or of an unknown action, are never active.
    * Without entries all captures are kept; without captures the result is empty.
    """
    seen = captures.groupBy("page_id", "url", F.col("fetched").cast("long").alias("fetched")).agg(F.count(F.lit(1)).alias("n_rows"))
    seen = materialise(seen, "url-captures")
    span = seen.agg(F.min("fetched"), F.max("fetched")).first()
    low, high = (span[0] or 0) // bucket, (span[1] or 0) // bucket
    held = intervals(entries, bucket).filter("action <> 'remove'")
    begin = F.greatest(F.floor(F.col("valid_from") / bucket), F.lit(low))
    # Valid up to, not at, the next change.
    end = F.least(F.coalesce(F.floor((F.col("valid_to") - 1) / bucket), F.lit(high)), F.lit(high))
    held = held.withColumn("begin", begin).withColumn("end", end).filter("begin <= end")
    held = held.withColumn("part", F.explode(F.sequence("begin", "end"))).drop("begin", "end")
    place = F.concat_ws("|", "part", "key").alias("place")
    held = held.select(place, "key", "action", "valid_from", "valid_to")

    named = seen.filter("url IS NOT NULL AND fetched IS NOT NULL")
    asked = named.select("page_id", "url", "fetched", F.floor(F.col("fetched") / bucket).alias("part"), F.explode(keys_of(F.col("url"))).alias("key"))
    asked = asked.select("page_id", "url", "fetched", place)
    found = spread_join(asked, held, "place", ["page_id", "url"])
    found = found.filter("valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)")
    best = F.max(F.struct(F.length("key").alias("size"), "key", "action", "valid_from")).alias("best")
    found = found.groupBy("page_id", "url", "fetched").agg(best, F.count(F.lit(1)).alias("n_active"))
    found = found.toDF("_page", "_url", "_fetched", "best", "n_active")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("page_id", "_page"), ("url", "_url"), ("fetched", "_fetched"))]
    joined = seen.join(found, same[0] & same[1] & same[2], "left")
    return joined.select(
        *("page_id", "url", "fetched", "n_rows"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.key").alias("key"),
        F.col("best.action").alias("action"),
        F.col("best.valid_from").alias("valid_from"),
        (~F.col("best.action").eqNullSafe(F.lit("block"))).alias("kept"),
    )
