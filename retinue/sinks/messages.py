"""Publishing files and lines as messages, and result sinks in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_messages(files: DataFrame) -> DataFrame:
    """``<key string, value binary>``: file name and bytes."""
    return files.select(F.col("name").alias("key"), F.col("content").alias("value"))


def line_messages(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.select(F.lit(None).cast("string").alias("key"), F.encode(F.col(col), "UTF-8").alias("value"))


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Send the messages to a topic (needs the Kafka connector package)."""
    writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("topic", topic).save()


def publish_parquet(messages: DataFrame, path: str) -> None:
    """Append the messages to a folder that ``file_stream`` reads."""
    messages.select("key", "value").write.mode("append").parquet(path)


def save_text(df: DataFrame, path: str, separator: str = ",") -> None:
    """Rows as text lines ``(a,b,...)``, replacing what an earlier attempt wrote."""
    line = F.concat(F.lit("("), F.concat_ws(separator, *[F.col(c).cast("string") for c in df.columns]), F.lit(")"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def match_log(matches: DataFrame) -> DataFrame:
    """One line per matched query: its name and the time it was matched."""
    names = matches.select("query").distinct()
    return names.select(
        F.concat_ws(" ", "query", F.lit("matched at"), F.unix_millis(F.current_timestamp()).cast("string")).alias("value")
    )
