"""Text rules that need no model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, kept to what Java and RE2 read alike.
MARKUP = r"<[^>]*>"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"


def clean_xml(text: Column) -> Column:
    """Markup removed, the remaining words joined by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARKUP, " "), r"\s+", " "))


def tokenize(text: Column) -> Column:
    """Words and single punctuation marks, ``array<string>``."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def ssplit(text: Column) -> Column:
    """Sentences, ``array<string>``: trimmed, without blank ones."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def first_sentence(text: Column) -> Column:
    """The first of :func:`ssplit`, without looking at the rest; null if there is none."""
    # A match is blank only if the whole text is, so the first one decides.
    found = F.regexp_replace(F.regexp_extract(text, f"({SENTENCE})", 1), r"^\s+|\s+$", "")
    return F.when(found != "", found)
