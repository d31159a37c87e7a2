"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

Every text (white space left out) has a hash code. A directory over the leading
bits of the codes doubles until no bucket holds more keys than its capacity; a
bucket is a range of codes and its keys are looked after by one owner task,
which compares the bytes of texts with equal code and chains those that differ.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retinue.llm.spread import slot_filter, spread_join
from retinue.session import bucket_count, materialise

#: Left out before texts are compared (fixed values of the contract).
WHITE = " \t\n\x0b\x0c\r"
#: Keys of a bucket before it is split.
CAPACITY = 4096
#: The directory never has more than two to this power of slots, so it may be broadcast.
MAX_DEPTH = 20
#: Bits of a hash code; not 64, so that codes are not negative.
HASH_BITS = 62


def signatures(docs: DataFrame, hash_bits: int = HASH_BITS, row: str | None = None) -> DataFrame:
    """``<doc_id, n_points, code, digest>`` of every row, after the column ``row`` if given; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ["doc_id"] if row is None else [row, "doc_id"]
    return (
        docs.select(*names, F.length(text).alias("n_points"), F.translate(text, WHITE, "").alias("norm"))
        .select(*names, "n_points", _code(hash_bits), F.unhex(F.sha2("norm", 256)).alias("digest"))
    )


def _code(hash_bits: int):
    return F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits).alias("code")


def directory(keys: DataFrame, n_keys: int, capacity: int = CAPACITY, hash_bits: int = HASH_BITS) -> tuple[DataFrame, int]:
    """``<slot, bucket, depth>`` for every taken slot of the leading bits, and the number of these bits.

    ``keys`` has one row per distinct ``code``. From depth 0 on, a bucket that
    holds more than ``capacity`` keys is split by one more bit; the directory
    has as many slots as its deepest bucket asks for (four doublings beyond an
    even spread at most; what is still overfull stays an overflowing bucket).
    """
    bits = min(hash_bits, MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n_keys) / capacity))) + 4)
    cells = keys.groupBy(F.shiftright("code", hash_bits - bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = cells.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    totals = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = levels.join(totals, ["depth", "prefix"]).filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    local = fits.groupBy("slot").agg(F.min("depth").alias("depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")
    return local.select("slot", first.alias("bucket"), "depth"), bits


def byte_groups(docs: DataFrame, shared: DataFrame, slots: DataFrame, bits: int, best: Column, hash_bits: int = HASH_BITS, row: str | None = None) -> DataFrame:
    """``<code, chain, digest, best, group_size>`` of the texts whose ``code`` is in ``shared``: more than one row has it.

    Their texts go to the owners of their buckets. Copies are folded before the
    shuffle, and the owner's grouping compares whole texts; different texts of
    one code are chained in the order of their digests.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ["doc_id"] if row is None else [row, "doc_id"]
    texts = docs.select(*names, F.length(text).alias("n_points"), F.translate(text, WHITE, "").alias("norm"))
    texts = slot_filter(texts.withColumn("code", _code(hash_bits)), "code", shared)
    texts = texts.withColumn("slot", F.shiftright("code", hash_bits - bits)).join(F.broadcast(slots.select("slot", "bucket")), "slot")
    owned = texts.groupBy("bucket", "code", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Other texts in the same slots come along; whole codes do, so no group is cut.
    owned = owned.join(shared, "code", "left_semi")
    entries = owned.select("bucket", "code", F.struct(F.unhex(F.sha2("norm", 256)).alias("digest"), "best", "group_size").alias("entry"))
    listed = entries.groupBy("bucket", "code").agg(F.array_sort(F.collect_list("entry")).alias("chained"))
    # Rows find their entry by its digest, so different bytes must never share one.
    clash = F.size("chained") != F.size(F.array_distinct("chained.digest"))
    checked = F.when(clash, F.raise_error(F.lit("different texts with one digest"))).otherwise(F.col("chained"))
    return listed.select("code", F.posexplode(checked).alias("chain", "entry")).select("code", "chain", "entry.*")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = HASH_BITS, row: str | None = None) -> DataFrame:
    """``<doc_id, keep_id, group_size, kept, text_sha256, bucket, chain>``, one row for every row of ``docs``.

    Texts are equal when they are identical without white space (``WHITE``).
    The row with the most code points in its original text stays, then the one
    with the smallest ``doc_id``. Only ``doc_id`` and ``text`` are read.

    * Null and empty texts are equal to each other and to pure white space.
    * A null ``doc_id`` comes after all others in a tie; ``kept`` is then true
      only for a row whose group has no other id.
    * Rows that repeat a ``doc_id`` share its decision.
    * With ``row``, a column of whole numbers that no two rows share, the result
      has it in front, it settles what ``doc_id`` leaves open, and ``kept`` is
      true for exactly one row of every group.
    * An empty table gives an empty result.
    """
    signed = materialise(signatures(docs, hash_bits, row), "exact-signatures")
    settled = [] if row is None else [F.bitwise_not(row).alias("row")]
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("other"), *settled))
    narrow = [best.alias("best"), F.first("digest").alias("digest"), F.count(F.lit(1)).alias("rows")]
    keys = materialise(signed.groupBy("code").agg(*narrow), "exact-keys")
    slots, bits = directory(keys, keys.count(), capacity, hash_bits)
    slots = materialise(slots, "exact-directory")
    # Where a code repeats, owners compare the bytes; a row alone with its code is a group.
    several = byte_groups(docs, keys.filter("rows > 1").select("code"), slots, bits, best, hash_bits, row)
    single = keys.filter("rows = 1").select("code", F.lit(0).alias("chain"), "digest", "best", F.lit(1).cast("long").alias("group_size"))
    groups = single.unionByName(several).withColumn("slot", F.shiftright("code", hash_bits - bits)).join(F.broadcast(slots), "slot")
    index = groups.select(
        "bucket",
        "code",
        "chain",
        "digest",
        F.bitwise_not("best.other").alias("keep_id"),
        *([] if row is None else [F.bitwise_not("best.row").alias("keep_row")]),
        "group_size",
    )
    # The index on shared files: an owner writes a range of buckets.
    owners = max(1, min(bucket_count(docs.sparkSession), slots.select("bucket").distinct().count()))
    index = materialise(index.repartitionByRange(owners, "bucket", "code").sortWithinPartitions("code", "chain"), "exact-index")
    rows = signed.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("n_points", "code")
    sizes = index.select("digest", F.col("group_size").alias("_n"))
    found = spread_join(rows, index.drop("code"), "digest", [row or "doc_id"], total=signed.count(), sizes=sizes)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) if row is None else F.col(row) == F.col("keep_row")
    first = [] if row is None else [row]
    return found.select(*first, "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain")
