"""Removal of lines that many sites share, in DataFrame operations only.

Each distinct line gets a HyperLogLog sketch of the sites it occurs on, merged by
aggregation. Where the estimate is clear of the threshold it decides; lines near
it get an exact count of their sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retinue.llm.spread import slot_filter, slot_of, spread_join
from retinue.session import materialise

#: Sites from which on a line is boilerplate.
LEAST_SITES = 5
#: Binary logarithm of the registers of a sketch, and the relative standard error that gives.
SKETCH_BITS = 12
ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
#: Estimates within this many standard errors of the threshold, or one site, are counted exactly.
ERRORS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) == ""


def _occurrences(docs: DataFrame) -> DataFrame:
    """``<line, site>`` of every line with a character other than white space."""
    rows = docs.select(F.coalesce("source", F.lit("")).alias("site"), F.explode(_lines(F.col("text"))).alias("text"))
    return rows.filter(~_blank(F.col("text"))).select(_key(F.col("text")).alias("line"), "site")


def shared_lines(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """``<line>``: digests of the lines that occur on ``least_sites`` sites or more."""
    rows = _occurrences(docs)
    # A line that occurs less often cannot be on so many sites.
    sketched = rows.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.count(F.lit(1)).alias("n"))
    spread = sketched.filter(F.col("n") >= least_sites).select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, ERRORS * ERROR * least_sites)
    spread = materialise(spread.filter(F.col("sites") >= least_sites - margin), "line-spread")
    clear = spread.filter(F.col("sites") > least_sites + margin).select("line")
    near = spread.filter(F.col("sites") <= least_sites + margin).select("line")
    # Distinct sites are counted by two groupings that fold before their shuffles.
    exact = slot_filter(rows, "line", near).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    exact = exact.filter(F.col("sites") >= least_sites).join(near, "line", "left_semi").select("line")
    return materialise(clear.union(exact), "line-shared")


def remove_shared_lines(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """``<doc_id, n_lines, n_removed, text>``, one row for every row of ``docs``; ``text`` is without shared lines.

    A line is what stands between line feeds, compared byte by byte (by MD5);
    lines of white space alone are never counted nor removed. ``source`` is the
    site. Only ``doc_id``, ``source`` and ``text`` are read.

    * Null and empty texts have no lines; a null text stays null.
    * A null ``source`` is a site of its own, the same as an empty one.
    * Null ids and repeated rows are rows like others; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    shared = shared_lines(docs, least_sites)
    # Which texts hold which shared lines, by digests of both.
    texts = docs.select(_key(F.coalesce("text", F.lit(""))).alias("ref"), _lines(F.col("text")).alias("own"))
    held = texts.select("ref", F.explode(F.array_distinct(F.transform("own", _key))).alias("line"))
    held = slot_filter(held, "line", shared).distinct()
    held = spread_join(held, shared, "line", ["ref"], "left_semi")
    gone = materialise(held.groupBy("ref").agg(F.collect_set("line").alias("gone")), "line-gone")

    # Texts in no slot of a text with shared lines stay where they are.
    placed = docs.withColumn("ref", _key(F.coalesce("text", F.lit(""))))
    slots = F.broadcast(gone.select(slot_of(F.col("ref")).alias("_slot")).distinct())
    slotted = placed.withColumn("_slot", slot_of(F.col("ref")))
    none = F.array().cast("array<binary>").alias("gone")
    clear = slotted.join(slots, "_slot", "left_anti").select("doc_id", "text", none)
    marked = slotted.join(slots, "_slot", "left_semi").drop("_slot")
    marked = spread_join(marked, gone, "ref", ["doc_id"], "left").select("doc_id", "text", F.coalesce("gone", none))
    rows = clear.union(marked).toDF("doc_id", "text", "gone").withColumn("own", _lines(F.col("text")))

    def stays(line: Column) -> Column:
        return _blank(line) | ~F.array_contains("gone", _key(line))

    # A blank line has a digest too, so it is only looked up where something goes.
    left = F.when(F.size("gone") > 0, F.filter("own", stays)).otherwise(F.col("own"))
    full = F.size(F.filter("own", lambda line: ~_blank(line)))
    cleaned = rows.select("doc_id", "text", full.cast("long").alias("n_lines"), F.size("own").alias("n"), left.alias("left"))
    text = F.when(F.col("text").isNotNull(), F.array_join("left", "\n")).alias("text")
    return cleaned.select("doc_id", "n_lines", (F.col("n") - F.size("left")).cast("long").alias("n_removed"), text)
