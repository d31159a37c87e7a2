"""Frames that several registered queries derive from the given tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.functions.images import encode_png
from retinue.functions.vectors import to_matrix
from retinue.plans.registry import table

#: Consecutive embeddings that stand for the descriptors of one image.
DESCRIPTORS_PER_IMAGE = 10


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<vec_id, image_name, descriptor, label>``: ten embeddings per image."""
    image = F.floor(F.col("vec_id") / DESCRIPTORS_PER_IMAGE).cast("string")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("img"), image).alias("image_name"), F.col("embedding").alias("descriptor"), "label"
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<image_name, features>``: the descriptors of each image as one array."""
    # The one shuffle of this plan, with a task for every core at least: the
    # work per image that follows is far heavier than its bytes suggest.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = descriptors(spark, sf_dir).repartition(tasks, "image_name")
    grouped = rows.groupBy("image_name").agg(F.array_sort(F.collect_list(F.struct("vec_id", "descriptor"))).alias("d"))
    return grouped.select("image_name", F.col("d.descriptor").alias("features"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<center_id, center>``: the mean embedding of every label, a codebook both engines agree on."""
    rows = table(spark, sf_dir, "embeddings")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    means = rows.groupBy(F.col("label").alias("center_id")).agg(mean.alias("mean"))
    return means.select("center_id", vector_to_array("mean").alias("center"))


CENTERS_SQL = """
means AS (
  SELECT label, pos, avg(x) AS m
  FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS pos
        FROM embeddings)
  GROUP BY label, pos),
centers AS (SELECT label AS center_id, list(m ORDER BY pos) AS center FROM means GROUP BY label),
distances AS (
  SELECT vec_id, 'img' || CAST(vec_id // 10 AS VARCHAR) AS image_name, center_id,
         list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), center),
                                 lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM embeddings, centers),
assigned AS (
  SELECT vec_id, image_name, center_id AS cluster
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, center_id) AS n FROM distances)
  WHERE n = 1)"""

HISTOGRAM_SQL = CENTERS_SQL + """,
cells AS (
  SELECT i.image_name, c.center_id AS cluster, count(a.vec_id) AS cnt
  FROM (SELECT DISTINCT image_name FROM assigned) i
  CROSS JOIN centers c
  LEFT JOIN assigned a ON a.image_name = i.image_name AND a.cluster = c.center_id
  GROUP BY ALL)"""

PAIRS_SQL = HISTOGRAM_SQL + """,
pairs AS (
  SELECT q.image_name AS query, g.image_name AS match,
         CAST(sum((q.cnt - g.cnt) * (q.cnt - g.cnt)) AS BIGINT) AS distance
  FROM cells q JOIN cells g ON q.cluster = g.cluster
  GROUP BY ALL),
ranked AS (
  SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, match) AS INTEGER) AS rank,
         match, distance
  FROM pairs)"""


def drawn_pixels(features: pa.Scalar) -> np.ndarray:
    """The vectors of an image as grey levels, in two lines each and four by four pixels per value."""
    values = to_matrix(features.values)
    grey = np.clip(128 + 400 * values.reshape(2 * len(values), -1), 0, 255)
    return np.kron(grey, np.ones((4, 4))).astype(np.uint8)


def pixel_images(spark: SparkSession, sf_dir: str, encode=encode_png) -> DataFrame:
    """``<image_name, content>``: every image of :func:`images` drawn and encoded as a file."""

    def draw(batches):
        for batch in batches:
            files = [encode(drawn_pixels(features)) for features in batch.column("features")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_name"), pa.array(files, pa.binary())], ["image_name", "content"]
            )

    schema = T.StructType([T.StructField("image_name", T.StringType()), T.StructField("content", T.BinaryType())])
    return images(spark, sf_dir).mapInArrow(draw, schema)


#: The descriptors that :func:`cell_means` finds in the drawn pictures, value by value.
PIXELS_SQL = """
pixels AS (
  SELECT 'img' || CAST(vec_id // 10 AS VARCHAR) AS image_name, vec_id, len(embedding) // 2 AS half,
         unnest(range(len(embedding))) AS i,
         CAST(floor(least(greatest(128 + 400 * unnest(CAST(embedding AS DOUBLE[])), 0), 255)) AS BIGINT) AS v
  FROM embeddings),
descriptors AS (SELECT image_name, 2 * (vec_id % 10) + i // half AS pos, i % half AS j, v FROM pixels)"""

#: Visual words are the descriptors of the first picture.
WORDS_SQL = PIXELS_SQL + """,
apart AS (
  SELECT d.image_name, d.pos, c.pos AS cluster, sum((d.v - c.v) * (d.v - c.v)) AS d
  FROM descriptors d JOIN descriptors c ON d.j = c.j AND c.image_name = 'img0' GROUP BY ALL),
word AS (
  SELECT image_name, cluster FROM (SELECT *, row_number() OVER (PARTITION BY image_name, pos ORDER BY d, cluster) AS n FROM apart)
  WHERE n = 1),
cells AS (
  SELECT i.image_name, c.pos AS cluster, count(w.cluster) AS cnt
  FROM (SELECT DISTINCT image_name FROM descriptors) i
  CROSS JOIN (SELECT DISTINCT pos FROM descriptors WHERE image_name = 'img0') c
  LEFT JOIN word w ON w.image_name = i.image_name AND w.cluster = c.pos GROUP BY ALL),
ranked AS (
  SELECT query, match, distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, match) AS INTEGER) AS rank
  FROM (SELECT q.image_name AS query, g.image_name AS match, CAST(sum((q.cnt - g.cnt) * (q.cnt - g.cnt)) AS BIGINT) AS distance
        FROM cells q JOIN cells g ON q.cluster = g.cluster GROUP BY ALL))"""


def cell_means(pixels: np.ndarray) -> np.ndarray:
    """A simple extractor: one descriptor per line of four by four cells, of their mean grey levels."""
    height, width = pixels.shape[:2]
    return pixels.mean(axis=2).reshape(height // 4, 4, width // 4, 4).mean(axis=(1, 3))


def encode_raw(pixels: np.ndarray) -> bytes:
    """Grey pixels as messages carry them here: width and height, then the values."""
    return np.array(pixels.shape[::-1], "<u4").tobytes() + pixels.tobytes()


def decode_raw(content: bytes) -> np.ndarray | None:
    width, height = np.frombuffer(content[:8], "<u4") if len(content) >= 8 else (0, 0)
    fits = len(content) == 8 + int(width) * int(height)
    return np.frombuffer(content, np.uint8, offset=8).reshape(height, width, 1) if fits else None


def first_words(described: DataFrame, feature: str) -> DataFrame:
    """``<center_id, center>``: the descriptors of the first picture as a codebook."""
    first = described.where("image_name = 'img0'").select(F.posexplode(feature).alias("center_id", "center"))
    return first.select("center_id", F.col("center").cast("array<double>").alias("center"))


def export_files(files: DataFrame, folder: str, suffix: str = "") -> int:
    """Write ``<image_name, content>`` as one file per row below a shared folder; returns the number of files."""
    # A path without a scheme is taken as Spark takes it.
    jvm = files.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    qualified = path.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toString()
    place = qualified.replace("file:/", "file:///", 1) if qualified.startswith("file:/") and "://" not in qualified else qualified

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(place)
        system.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(*(column.to_pylist() for column in batch.columns)):
                with system.open_output_stream(f"{base}/{name}{suffix}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = files.select("image_name", "content").mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
