"""Joins that stay even under hot keys, as the operators on training text use them."""

from retinue.operators.spread import SHARES, SLOT_BITS, SMALL, slot_filter, slot_of, spread_join, unused, without

__all__ = ["SHARES", "SLOT_BITS", "SMALL", "slot_filter", "slot_of", "spread_join", "unused", "without"]
