"""Local image features as a distributed job over an image table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.sinks.cells import CellTable
from retinue.sources.files import accepted_channels, read_binary_files, read_images

#: Images whose descriptors one output batch holds.
IMAGES_PER_BATCH = 32

FEATURE = T.ArrayType(T.ArrayType(T.FloatType()))

#: A user's extractor: pixels (height, width, channels) uint8 -> (n, dim) matrix.
Extractor = Callable[[np.ndarray], np.ndarray]

#: A user's decoder of message bytes: pixels, or None for bytes that are no image.
Decoder = Callable[[bytes], "np.ndarray | None"]

# Cells of an image table by group: bytes apart from what is computed from them.
IMAGE_GROUPS = {
    "content": "path string, content binary",
    "features": "features array<array<float>>",
    "histogram": "histogram array<int>",
}


def extract_features(
    images: DataFrame, extractor: Extractor, out: str = "features", source: str = "image", decoder: Decoder | None = None
) -> DataFrame:
    """Adds ``array<array<float>>`` descriptors (column ``out``) to every image.

    ``source`` is an ``image`` struct of Spark's image reader, or a column of
    bytes for which a ``decoder`` has to be given. Images of 1 or 3 channels are
    used. An image that cannot be decoded, has other channels or has no point
    gets null; an error in the extractor or the decoder fails the job.
    """
    decoded = isinstance(images.schema[source].dataType, T.StructType)
    if decoded == (decoder is not None):
        raise ValueError("a decoder is needed for bytes, and only for these")

    def pixels(value):
        if not decoded:
            found = decoder(value)
            return None if found is None else np.atleast_3d(found)
        shape = (value["height"], value["width"], value["nChannels"])
        return np.frombuffer(value["data"], np.uint8).reshape(shape)

    def features(value):
        found = None if value is None else pixels(value)
        if found is None or found.shape[2] not in (1, 3):
            return None
        points = np.asarray(extractor(found), np.float32)
        return points if len(points) else None

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, IMAGES_PER_BATCH):
                part = batch.slice(start, IMAGES_PER_BATCH)
                found = [features(value) for value in part.column(source).to_pylist()]
                column = _feature_array(found)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    schema = T.StructType([*images.schema.fields, T.StructField(out, FEATURE)])
    return images.mapInArrow(run, schema)


def _feature_array(found: list[np.ndarray | None]) -> pa.Array:
    some = [m for m in found if m is not None]
    values = np.concatenate([m.ravel() for m in some]) if some else np.zeros(0, np.float32)
    widths = np.concatenate([np.full(len(m), m.shape[1]) for m in some]) if some else np.zeros(0, int)
    rows = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)), pa.array(values, pa.float32())
    )
    counts = [0 if m is None else len(m) for m in found]
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, rows, mask=pa.array([m is None for m in found]))


def ingest_images(spark: SparkSession, path: str | list[str], extractor: Extractor, out: str = "features") -> DataFrame:
    """``<image_name, path, content, out>`` of all files; a file is kept without features too.

    The descriptors come from Spark's image reader, which knows JPEG, PNG and
    others without further packages, and meet the bytes by path.
    """
    files = read_binary_files(spark, path)
    rows = files.select(F.col("name").alias("image_name"), "path", "content")
    # The two readers write the scheme of a path with one slash or with three.
    plain = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/")
    found = decoded_features(spark, path, extractor, out).select(plain.alias("_path"), out)
    return rows.withColumn("_path", plain).join(found, "_path", "left").select(*rows.columns, out)


def ingest_into(
    store: CellTable, path: str | list[str], extractor: Extractor, out: str = "features", decoder: Decoder | None = None
) -> None:
    """All files into the image table, as :func:`ingest_images` describes them, without a join.

    Bytes and descriptors lie in groups of their own, so each is written from
    its own reading of the files; bytes move once, to their buckets. With a
    ``decoder`` the files are read once, and descriptors come from the bytes.
    """
    files = read_binary_files(store.spark, path).select(F.col("name").alias("image_name"), "path", "content")
    if decoder is not None:
        store.put(extract_features(files, extractor, out, "content", decoder))
        return
    store.put(files)
    store.put(decoded_features(store.spark, path, extractor, out).select("image_name", out))


def decoded_features(spark: SparkSession, path: str | list[str], extractor: Extractor, out: str = "features") -> DataFrame:
    """``<image_name, path, out>`` of the images that Spark's reader decodes and that have 1 or 3 channels."""
    images = read_images(spark, path).where(accepted_channels(F.col("image")))
    return extract_features(images, extractor, out).drop("image")


def image_table(spark: SparkSession, root: str) -> CellTable:
    return CellTable(spark, root, IMAGE_GROUPS)


def backfill_feature(
    images: DataFrame, src_col: str, fn: Callable[[DataFrame], DataFrame], dst_col: str, key: str = "image_name"
) -> DataFrame:
    """``<key, dst_col>`` of the rows that have ``src_col`` and for which ``fn`` finds a value.

    ``fn`` adds ``dst_col`` to ``<key, src_col>``. The result is ready to be
    put into the table: rows without a value are not written.
    """
    stored = images.where(F.col(src_col).isNotNull()).select(key, src_col)
    return fn(stored).where(F.col(dst_col).isNotNull()).select(key, dst_col)


def feature_summary(images: DataFrame, kinds: list[str], key: str = "image_name") -> DataFrame:
    """``<image_name, kind, n_rows, n_cols>`` of every stored descriptor matrix."""
    parts = []
    for kind in kinds:
        size = F.struct(
            F.lit(kind).alias("kind"),
            F.size(kind).alias("n_rows"),
            F.size(F.get(F.col(kind), F.lit(0))).alias("n_cols"),
        )
        parts.append(F.when(F.col(kind).isNotNull(), size))
    found = F.filter(F.array(*parts), lambda s: s.isNotNull())
    return images.select(key, F.inline(found))


def feature_totals(summary: DataFrame) -> DataFrame:
    """Images and descriptors per kind."""
    return summary.groupBy("kind").agg(
        F.count("*").alias("images"), F.sum("n_rows").alias("descriptors"), F.avg("n_rows").alias("mean_descriptors")
    )
