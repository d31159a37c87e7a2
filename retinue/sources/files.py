"""File sources: binary files, images, text lines, numeric vectors, graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retinue.functions.strings import file_name, parse_doubles


def read_binary_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``<name, path, length, content>``, one row per file.

    ``content`` is read only where it is selected, and never moved: the number
    of tasks follows from ``spark.sql.files.maxPartitionBytes``,
    ``openCostInBytes`` and ``minPartitionNum`` of the session.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(file_name(F.col("path")).alias("name"), "path", "length", "content")


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``<image_name, path, image struct>``: decoded images; files that do not decode are skipped."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    origin = F.col("image.origin")
    return images.select(file_name(origin).alias("image_name"), origin.alias("path"), "image")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``<value>``, one row per line."""
    return spark.read.text(path)


def parse_vectors(lines: DataFrame, header_marker: str | None = None, col: str = "value") -> DataFrame:
    """CSV numeric lines -> ``vector array<double>``; lines with the marker are dropped."""
    if header_marker:
        lines = lines.where(~F.col(col).contains(header_marker))
    return lines.withColumn("vector", parse_doubles(F.col(col))).drop(col)


def read_vectors(spark: SparkSession, path: str, header_marker: str | None = None) -> DataFrame:
    return parse_vectors(read_lines(spark, path), header_marker)


def parse_edge_list(lines: DataFrame) -> DataFrame:
    """Whitespace separated ``src dst`` lines -> longs; ``#`` lines and blank lines are skipped."""
    text = F.trim("value")
    parts = F.split(text, r"\s+")
    rows = lines.where((text != "") & ~text.startswith("#"))
    return rows.select(F.get(parts, 0).cast("long").alias("src"), F.get(parts, 1).cast("long").alias("dst"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_edge_list(read_lines(spark, path))


def parse_vertex_attrs(lines: DataFrame) -> DataFrame:
    """``id,a,b,...`` lines -> ``<id long, attrs array<string>>``."""
    parts = F.split("value", ",")
    return lines.where(F.trim("value") != "").select(
        F.trim(F.get(parts, 0)).cast("long").alias("id"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).alias("attrs"),
    )


def read_vertex_attrs(spark: SparkSession, path: str) -> DataFrame:
    return parse_vertex_attrs(read_lines(spark, path))


def accepted_channels(image: Column) -> Column:
    """True for images of 1 or 3 channels, the only ones features are taken from."""
    return image["nChannels"].isin(1, 3)


def channel_gate(images: DataFrame) -> DataFrame:
    return images.where(accepted_channels(F.col("image")))
