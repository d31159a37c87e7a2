"""Streaming sources. Every streaming operator takes any frame of these shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])


def kafka_stream(spark: SparkSession, servers: str, topics: str | list[str], **options: str) -> DataFrame:
    """``<key string, value binary>`` of one or several topics (needs the Kafka connector package)."""
    names = topics if isinstance(topics, str) else ",".join(topics)
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return reader.option("subscribe", names).options(**options).load().select(F.col("key").cast("string"), "value")


def image_stream(spark: SparkSession, servers: str, topic: str, partitions: int = 30, **options: str) -> DataFrame:
    """Image messages, spread over ``partitions`` tasks for the feature work."""
    return kafka_stream(spark, servers, topic, **options).repartition(partitions)


def text_stream(spark: SparkSession, servers: str, topics: str | list[str], **options: str) -> DataFrame:
    """``<value string>`` of one or several topics."""
    return kafka_stream(spark, servers, topics, **options).select(F.col("value").cast("string"))


def socket_text_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """``<value string>``, one row per received line."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def merged_stream(streams: dict[str, DataFrame]) -> DataFrame:
    """Several sources as one stream with a column ``source`` that names them.

    Each source keeps its own progress in the one checkpoint, so one that has
    ended or has nothing yet holds up no other. The names are taken in order,
    which must be the same in every run with a checkpoint. Columns that a
    source lacks are null.
    """
    if not streams:
        raise ValueError("no sources")
    named = [streams[name].withColumn("source", F.lit(name)) for name in sorted(streams)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream (also the stand-in for a topic of messages)."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
