"""String rules shared by the log, text and table operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(text: Column, separator: str = " ") -> Column:
    """Split that keeps leading and inner empty tokens and drops trailing ones.

    A text made of separators alone has no token; an empty text has one empty
    token.
    """
    quoted = re.escape(separator)
    if separator == " ":
        head = F.rtrim(text)
    else:
        head = F.regexp_replace(text, f"(?:{quoted})+$", "")
    only_separators = (F.length(text) > 0) & (head == "")
    return F.when(only_separators, F.array().cast("array<string>")).otherwise(F.split(head, quoted))


def file_name(path: Column) -> Column:
    """Last ``/`` segment."""
    return F.element_at(F.split(path, "/"), -1)


def parse_doubles(line: Column, separator: str = ",") -> Column:
    """Delimited numbers -> array<double>; tokens are trimmed and empty ones dropped."""
    tokens = F.transform(F.split(line, re.escape(separator)), lambda t: F.trim(t))
    return F.filter(tokens, lambda t: t != "").cast("array<double>")


def bytes_to_text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def encode_base64(content: Column) -> Column:
    return F.base64(content)


def decode_base64(text: Column) -> Column:
    return F.unbase64(text)


def epoch_millis(ts: Column | None = None) -> Column:
    return F.unix_millis(F.current_timestamp() if ts is None else ts)
