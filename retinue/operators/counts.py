"""Word, log and click counts, and the per-user activity rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retinue.functions.logs import log_fields
from retinue.functions.strings import split_tokens

# The tags of a user-behaviour line. The colons differ in width.
USER_TAG = "用户："
ACTIVITY_TAGS = {
    "view": "正在查看新闻:",
    "apply": "写过的新闻",
    "search": "正在搜索新闻：",
}


CLICK_SCHEMA = "uid string, event_time string, os_type string, click_count bigint"


def word_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """``<word, cnt>``, unsorted."""
    words = lines.select(F.explode(split_tokens(F.col(col))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def word_count(lines: DataFrame, col: str = "value") -> DataFrame:
    """``<word, cnt>`` in word order."""
    return sort_by_key(word_counts(lines, col), "word")


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def counts_by_key(df: DataFrame, key: Column | str) -> DataFrame:
    """``<key, cnt>``; null keys are left out."""
    column = F.col(key) if isinstance(key, str) else key
    return df.select(column.alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("cnt"))


def counts_by_count(df: DataFrame, key: Column | str) -> DataFrame:
    """``<cnt, key>`` ascending by count, then by key."""
    return sort_by_key(counts_by_key(df, key).select("cnt", "key"), "cnt", "key")


def ip_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    return counts_by_count(lines, log_fields(F.col(col))["ip"])


def page_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    return counts_by_count(lines, log_fields(F.col(col))["page"])


def agent_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    return counts_by_key(lines, log_fields(F.col(col))["agent"])


def log_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """``<dimension, key, cnt>`` for ip, page, agent and rejected lines, from one scan and one shuffle.

    A rejected (too short) line has no key.
    """
    parsed = lines.select(log_fields(F.col(col)).alias("f"))
    found = [F.struct(F.lit(d).alias("dimension"), F.col(f"f.{d}").alias("key")) for d in ("ip", "page", "agent")]
    rejected = F.struct(F.lit("rejected").alias("dimension"), F.lit(None).cast("string").alias("key"))
    entries = F.when(F.col("f").isNotNull(), F.array(*found)).otherwise(F.array(rejected))
    return parsed.select(F.inline(entries)).groupBy("dimension", "key").agg(F.count("*").alias("cnt"))


def parse_clicks(messages: DataFrame, col: str = "value", schema: str = CLICK_SCHEMA) -> DataFrame:
    return messages.select(F.from_json(F.col(col).cast("string"), schema).alias("e")).select("e.*")


def click_counts(clicks: DataFrame, uid: str = "uid", count: str = "click_count", rejects: Observation | None = None) -> DataFrame:
    """``<uid, clicks>``: sum of the click counts of every user.

    A message without a user, malformed ones included, is rejected. ``rejects``
    counts ``received`` and ``rejected`` messages in the same pass; it has them
    when the result was computed once.
    """
    bad = F.col(uid).isNull()
    return _observed(clicks, bad, rejects).where(~bad).groupBy(F.col(uid).alias("uid")).agg(F.sum(count).alias("clicks"))


def _observed(rows: DataFrame, bad: Column, rejects: Observation | None) -> DataFrame:
    if rejects is None:
        return rows
    return rows.observe(rejects, F.count(F.lit(1)).alias("received"), F.count_if(bad).alias("rejected"))


def reject_row(spark: SparkSession, rejects: Observation) -> DataFrame:
    """``<received, rejected>``, one row, of an observation whose frame was computed."""
    found = rejects.get
    return spark.createDataFrame([(found["received"], found["rejected"])], "received long, rejected long")


def activity_events(
    lines: DataFrame, col: str = "value", pos: str = "pos", rejects: Observation | None = None
) -> DataFrame:
    """``<user, kind, item, pos>`` of tagged lines. A line can carry several tags.

    A tag on a line without a user, and a search term that cannot be decoded,
    are rejected; ``rejects`` counts ``received`` and ``rejected`` tags in the same pass.

    The user runs from its tag to the next comma; the item runs from the kind's
    tag to the end of the line; search terms are URL-decoded and trimmed.
    """
    text = F.col(col)
    user = F.regexp_extract(text, f"{USER_TAG}([^,]*),", 1)
    items = []
    for kind, tag in ACTIVITY_TAGS.items():
        item = F.substring(text, F.instr(text, tag) + len(tag), F.length(text))
        if kind == "search":
            item = F.trim(F.try_url_decode(item))
        items.append(F.when(text.contains(tag), F.struct(F.lit(kind).alias("kind"), item.alias("item"))))
    found = F.filter(F.array(*items), lambda e: e.isNotNull())
    rows = lines.select(F.col(pos).alias("pos"), user.alias("user"), F.explode(found).alias("e"))
    good = F.coalesce(F.col("user") != "", F.lit(False)) & F.col("e.item").isNotNull()
    return _observed(rows, ~good, rejects).where(good).select("user", "e.kind", "e.item", "pos")


def first_seen(events: DataFrame) -> DataFrame:
    """``<user, kind, item, pos>``: every distinct item with the position it was first seen at."""
    return events.groupBy("user", "kind", "item").agg(F.min("pos").alias("pos"))


def user_activity(
    lines: DataFrame, col: str = "value", pos: str = "pos", part_rows: int = 1_000_000, rejects: Observation | None = None
) -> DataFrame:
    """``<user, part, activity>``: JSON of the distinct items per kind, comma-joined in first-seen order.

    Part ``n`` of a user holds what was first seen in the ``n``-th stretch of
    ``part_rows`` positions, for every user alike; the parts in order give the
    whole list, and no task gathers more of a user than one stretch of lines.
    ``rejects`` is that of :func:`activity_events`.
    """
    items = first_seen(activity_events(lines, col, pos, rejects))
    parted = items.withColumn("part", F.floor(F.col("pos") / F.lit(part_rows)).cast("long"))

    def joined(kind: str) -> Column:
        mine = F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "item")))
        return F.when(F.size(mine) > 0, F.array_join(F.array_sort(mine)["item"], ",")).alias(kind)

    lists = parted.groupBy("user", "part").agg(*[joined(kind) for kind in ACTIVITY_TAGS])
    return lists.select("user", "part", F.to_json(F.struct(*ACTIVITY_TAGS)).alias("activity"))
