"""Match a stream of images against a stored gallery."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retinue.operators.codebook import SharedCodebook, quantise, share_codebook
from retinue.operators.features import Decoder, Extractor, extract_features
from retinue.operators.similarity import Gallery, matches_wide, top_k_similar
from retinue.session import materialise
from retinue.sinks.cells import CellTable, remembered
from retinue.sinks.messages import match_log
from retinue.streaming.batches import run_per_batch

FEATURE = "features"


def received_images(messages: DataFrame, extractor: Extractor, decoder: Decoder) -> DataFrame:
    """Messages ``<key, value>`` -> ``<image_name, content, features>``. Without a key the image is named by its bytes."""
    name = F.coalesce("key", F.sha2("value", 256)).alias("image_name")
    images = messages.select(name, F.col("value").alias("content"))
    return extract_features(images, extractor, FEATURE, "content", decoder)


def once_each(batch: DataFrame) -> DataFrame:
    """Rows of a batch of messages, equal ones (by key and content) once."""
    if "value" not in batch.columns:
        return batch.dropDuplicates()
    content = F.sha2(F.col("value").cast("binary"), 256)
    return batch.withColumn("_content", content).dropDuplicates([c for c in ("key", "_content") if c == "_content" or c in batch.columns]).drop("_content")


def one_per_name(images: DataFrame, name: str = "image_name") -> DataFrame:
    """One row per name, the greatest by its other columns; rows without a name all stay."""
    others = [c for c in images.columns if c != name]
    alone = F.when(F.col(name).isNull(), F.monotonically_increasing_id())
    best = images.groupBy(name, alone.alias("_alone")).agg(F.max(F.struct(*others)).alias("_row"))
    return best.select(name, "_row.*").select(images.columns)


def match_image_stream(
    messages: DataFrame,
    gallery: DataFrame | None,
    centers: DataFrame | SharedCodebook,
    out: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    k: int = 10,
    empty: str = "zero",
    store: CellTable | None = None,
    store_feature: str = "features",
    interval: str | None = "800 milliseconds",
    available_now: bool = False,
    grow: bool = False,
) -> StreamingQuery:
    """The ``k`` most similar gallery images of every image that arrives.

    ``prepare`` turns a batch of messages into ``<image_name, features, ...>``,
    for instance by :func:`received_images`. A message that a batch has twice
    (same key and content) is prepared once, and of images under one name a
    batch keeps one; different images under one message key all stay.
    Per batch, below ``out``: ``matches/batch=<id>`` (one row per rank),
    ``wide/batch=<id>`` (cells ``name#distance``) and ``log/batch=<id>`` (text).
    An image without features is matched with an all-zero histogram unless
    ``empty="drop"``. With ``store`` the received images are kept as well.
    The codebook is read once and kept by the executors.

    ``gallery`` is read once and stays as it is, unless ``grow`` is set: then
    the gallery is what ``store`` holds (``gallery`` is not given), and an image
    stored by one batch is found by the next. A batch that runs again after a
    failure sees the images of the batches before it and replaces its own
    outputs and cells, so the results are those of a run without failure. The
    store must not be compacted between a failure and the run that recovers.
    """
    if grow and (store is None or gallery is not None):
        raise ValueError("a growing gallery is that of the store")
    shared = share_codebook(centers)
    spark = messages.sparkSession
    kept: list[Gallery] = []
    first_put = first_put_of(spark, checkpoint) if store is not None else 0
    if not grow:
        stored = gallery.where(F.col("histogram").isNotNull()).select("image_name", "histogram")
        kept.append(Gallery(materialise(stored, "gallery"), k))

    def match(batch: DataFrame, batch_id: int) -> None:
        once = one_per_name(prepare(once_each(batch)))
        images = quantise(once, shared, FEATURE, empty=empty).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if grow and not kept:
                kept.append(Gallery(materialise(_stored_before(store, first_put + batch_id), "gallery"), k))
            # The three outputs come from one written result.
            path = f"{out}/matches/batch={batch_id}"
            top_k_similar(images, kept[0], k).write.mode("overwrite").parquet(path)
            matches = images.sparkSession.read.parquet(path)
            matches_wide(matches, k).write.mode("overwrite").parquet(f"{out}/wide/batch={batch_id}")
            match_log(matches).write.mode("overwrite").text(f"{out}/log/batch={batch_id}")
            if store is not None:
                save_received_images(images, store, store_feature, first_put + batch_id)
            if grow:
                kept[0] = kept[0].added(images)
        except BaseException:
            # The next attempt begins with what the store holds then.
            if grow:
                kept.clear()
            raise
        finally:
            images.unpersist()

    return run_per_batch(messages, match, checkpoint, interval=interval, available_now=available_now)


def first_put_of(spark: SparkSession, checkpoint: str) -> int:
    """Number of the write of batch 0, kept beside the checkpoint: a batch that runs again replaces its own write."""
    return int(remembered(spark, checkpoint.rstrip("/") + "-first-put", str(time.time_ns())))


def _stored_before(store: CellTable, put: int) -> DataFrame:
    """Histograms of the store without the write of this number and later ones of the stream."""
    state = store.manifest()
    before = tuple(p for p in state.parts if p.base or p.put < put)
    return store.scan(["histogram"], before).select("image_name", "histogram")


def save_received_images(images: DataFrame, store: CellTable, feature: str = "features", put_id: int | None = None) -> None:
    """Bytes, histogram and (if any) descriptors of the received images into the image table."""
    cells = images.withColumnRenamed(FEATURE, feature)
    store.put(cells.select("image_name", *[c for c in store.columns if c in cells.columns]), put_id=put_id)
