"""Fields of access-log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retinue.functions.strings import split_tokens

# Token positions of the address and of the page.
IP_TOKEN = 0
PAGE_TOKEN = 10


def log_fields(line: Column, ip_token: int = IP_TOKEN, page_token: int = PAGE_TOKEN) -> Column:
    """``struct<ip, page, agent>``; null for a line too short to have them all.

    The agent is the last token of the line.
    """
    tokens = split_tokens(line)
    fields = F.struct(
        F.get(tokens, F.lit(ip_token)).alias("ip"),
        F.get(tokens, F.lit(page_token)).alias("page"),
        F.element_at(tokens, -1).alias("agent"),
    )
    return F.when(F.size(tokens) > max(ip_token, page_token), fields)
