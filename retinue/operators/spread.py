"""Joins and filters that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is split when it holds over one part in SHARES of the rows, so at most
#: SHARES keys are split: the broadcast list of split keys has this many rows
#: at any size of the input.
SHARES = 4096
#: Rows of a key that are never worth splitting.
SMALL = 64
#: Broadcast slot lists have at most two to the power SLOT_BITS rows.
SLOT_BITS = 18


def spread_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    by: list[str],
    how: str = "inner",
    total: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` rows per ``key`` to the single row per ``key`` of ``one``.

    Keys that hold more than one part in ``SHARES`` of ``many`` are cut into
    pieces by a hash of the columns ``by``, and their row of ``one`` is repeated
    once for each piece. ``how`` is ``inner``, ``left`` or ``left_semi``.
    ``sizes`` (``key``, ``_n``) may hand over the counted rows of the keys.
    """
    total = many.count() if total is None else total
    limit = max(SMALL, total // SHARES)
    held, pieces, salted = (unused([*many.columns, *one.columns], name) for name in ("_n", "_pieces", "_salt"))
    if sizes is None:
        sizes = many.groupBy(key).agg(F.count(F.lit(1)).alias(held))
    else:
        sizes = sizes.select(key, F.col("_n").alias(held))
    hot = sizes.filter(F.col(held) > limit).select(key, F.ceil(F.col(held) / F.lit(limit)).cast("int").alias(pieces))
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*by), F.coalesce(pieces, F.lit(1))).cast("int")
    left = many.join(hot, key, "left").withColumn(salted, salt).drop(pieces)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1))
    right = one.join(hot, key, "left").withColumn(salted, copies).drop(pieces)
    return left.join(right, [key, salted], how).drop(salted)


def slot_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - SLOT_BITS)


def unused(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slot_filter(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Drop most ``rows`` whose ``key`` is not among ``wanted``, without moving any.

    Keys are mapped to a fixed number of slots and the slots of ``wanted``
    (bounded, see ``SLOT_BITS``) travel to the rows. Some other rows pass too,
    and all of them when every slot is taken: an exact join has to follow.
    """
    slot = unused(rows.columns, "_slot")
    slots = wanted.select(slot_of(F.col(key)).alias(slot)).distinct()
    found = rows.withColumn(slot, slot_of(F.col(key))).join(F.broadcast(slots), slot, "left_semi")
    return found.select(rows.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``; only rows in a slot of ``gone`` are moved. A null key stays."""
    slot = unused(rows.columns, "_slot")
    slots = F.broadcast(gone.select(slot_of(F.col(key)).alias(slot)).distinct())
    placed = rows.withColumn(slot, slot_of(F.col(key)))
    clear = placed.join(slots, slot, "left_anti")
    checked = placed.join(slots, slot, "left_semi").join(gone.select(key), key, "left_anti")
    return clear.select(rows.columns).union(checked.select(rows.columns))
