"""Visual codebook: k-means training, assignment and histograms."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.functions.vectors import list_array, nearest_row, to_matrix
from retinue.operators.similarity import nearest
from retinue.session import materialise

#: Most codebook bytes sent to a task in one piece; a larger codebook is
#: applied piece by piece.
MAX_CENTER_BYTES = 64 * 1024 * 1024
#: Most codebook bytes that a task holds in all its pieces.
MAX_SHARED_BYTES = 1024 * 1024 * 1024


def explode_descriptors(
    images: DataFrame, feature: str, key: str = "image_name", out: str = "descriptor"
) -> DataFrame:
    """One row per descriptor: ``<key, pos, descriptor>``."""
    return images.where(F.col(feature).isNotNull()).select(key, F.posexplode(feature).alias("pos", out))


def train_codebook(
    descriptors: DataFrame,
    k: int,
    col: str = "descriptor",
    max_iter: int = 30,
    runs: int = 3,
    seed: int = 1,
) -> KMeansModel:
    """k-means with parallel initialisation; the best of ``runs`` seeds is kept."""
    vectors = descriptors.where(F.col(col).isNotNull()).select(
        array_to_vector(F.col(col).cast("array<double>")).alias("features")
    )
    return _best_fit(vectors, k, max_iter, runs, seed)


def cluster_table(
    rows: DataFrame, cols: list[str], k: int, max_iter: int = 30, runs: int = 3, seed: int = 1
) -> tuple[KMeansModel, DataFrame]:
    """k-means on ordinary numeric columns: the model and all ``rows`` with a ``cluster`` column.

    Rows with a null in one of ``cols`` are not trained on and have a null ``cluster``.
    """
    assembled = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(rows)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    model = _best_fit(assembled.where(complete).select("features"), k, max_iter, runs, seed)
    found = model.transform(assembled).withColumn("cluster", F.when(complete, F.col("prediction")))
    return model, found.drop("features", "prediction")


def _best_fit(vectors: DataFrame, k: int, max_iter: int, runs: int, seed: int) -> KMeansModel:
    cached = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The runs share the cached rows; one fills the cores that another
        # leaves idle between its iterations.
        with ThreadPoolExecutor(max_workers=runs) as pool:
            fit = inheritable_thread_target(vectors.sparkSession)(
                lambda run: KMeans(k=k, maxIter=max_iter, seed=seed + run).fit(cached)
            )
            return min(pool.map(fit, range(runs)), key=lambda model: model.summary.trainingCost)
    finally:
        cached.unpersist()


def centers_table(spark: SparkSession, model: KMeansModel) -> DataFrame:
    """``<center_id int, center array<double>>``; as many rows as centres were found."""
    rows = [(i, [float(v) for v in center]) for i, center in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "center_id int, center array<double>")


def save_codebook(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_codebook(path: str) -> KMeansModel:
    return KMeansModel.load(path)


@dataclass(frozen=True)
class SharedCodebook:
    """A codebook that the tasks hold, as broadcast matrices in ``center_id`` order."""

    pieces: tuple
    starts: tuple[int, ...]
    n_centers: int


class CodebookTooLarge(ValueError):
    """The codebook is over ``MAX_SHARED_BYTES``."""


def share_codebook(centers: DataFrame | SharedCodebook, max_bytes: int = MAX_CENTER_BYTES) -> SharedCodebook:
    """Send a centres table to the tasks, in pieces of at most ``max_bytes``.

    Ids are dense from 0, so every piece is read with its own range filter and
    no more than one piece is in flight on its way through the driver. Done
    once for a stream, it serves all batches.
    """
    if isinstance(centers, SharedCodebook):
        return centers
    size = centers.agg(F.count("*"), F.max(F.size("center")), F.max("center_id")).first()
    n, dim, last = size[0], size[1], size[2]
    if not n:
        raise ValueError("the codebook is empty")
    if last != n - 1:
        raise ValueError("center_id must be dense from 0")
    if n * dim * 8 > MAX_SHARED_BYTES:
        raise CodebookTooLarge(f"{n} centres of {dim} values")
    step = max(1, max_bytes // (8 * dim))
    pieces, starts = [], tuple(range(0, n, step))
    for start in starts:
        part = centers.where(F.col("center_id").between(start, start + step - 1))
        rows = part.select("center_id", F.col("center").cast("array<double>")).toArrow().sort_by("center_id")
        pieces.append(centers.sparkSession.sparkContext.broadcast(to_matrix(rows.column("center"))))
    return SharedCodebook(tuple(pieces), starts, n)


def _nearest_struct(piece, first_id: int):
    @F.arrow_udf("struct<distance: double, center_id: int>")
    def find(descriptors: pa.Array) -> pa.Array:
        index, distance = nearest_row(to_matrix(descriptors), piece.value)
        return pa.StructArray.from_arrays(
            [pa.array(distance), pa.array((index + first_id).astype(np.int32))], ["distance", "center_id"]
        )

    return find


def assign(
    df: DataFrame,
    centers: DataFrame | SharedCodebook,
    col: str = "descriptor",
    out: str = "cluster",
    max_bytes: int = MAX_CENTER_BYTES,
    row_key: list[str] | None = None,
) -> DataFrame:
    """Nearest centre of every descriptor by squared distance, lowest id on ties.

    No shuffle: the codebook travels to the rows. A codebook over ``max_bytes``
    is applied in several pieces within the same pass and the least
    (distance, id) wins. One over ``MAX_SHARED_BYTES`` is joined instead, as the
    gallery of a nearest-row search, with the same result; ``row_key`` may name
    columns that identify the rows, else they are numbered.
    """
    try:
        shared = share_codebook(centers, max_bytes)
    except CodebookTooLarge:
        if row_key:
            return _assign_by_search(df, centers, col, out, row_key)
        numbered = materialise(df.withColumn("_number", F.monotonically_increasing_id()), "descriptors")
        return _assign_by_search(numbered, centers, col, out, ["_number"]).drop("_number")
    best = [_nearest_struct(piece, start)(F.col(col)) for piece, start in zip(shared.pieces, shared.starts)]
    winner = best[0] if len(best) == 1 else F.least(*best)
    return df.where(F.col(col).isNotNull()).withColumn(out, winner["center_id"])


def _assign_by_search(df, centers, col, out, row_key):
    rows = df.where(F.col(col).isNotNull()).withColumn("_row", F.to_json(F.struct(*row_key)))
    asked = rows.select("_row", F.col(col).cast("array<double>").alias("vector"))
    stored = centers.select(F.col("center_id").alias("_row"), F.col("center").alias("vector"))
    found = nearest(asked, stored, key="_row", vector="vector", broadcast_queries=0)
    return rows.join(found.select(F.col("query").alias("_row"), F.col("match").alias(out)), "_row").drop("_row")


def histogram(
    assigned: DataFrame, n_centers: int, key: str = "image_name", cluster: str = "cluster"
) -> DataFrame:
    """Dense int array of cluster counts per key: ``<key, histogram>``.

    Counted per (key, cluster) first, so a key that holds most of the rows
    reaches the second step as at most ``n_centers`` rows.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def dense(ids: pa.Array, counts: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        out = np.zeros((len(ids), n_centers), dtype=np.int32)
        rows = np.repeat(np.arange(len(ids)), lengths)
        out[rows, ids.flatten().to_numpy()] = counts.flatten().to_numpy()
        return list_array(out.ravel(), np.full(len(ids), n_centers), pa.int32())

    counts = assigned.groupBy(key, cluster).agg(F.count("*").cast("int").alias("cnt"))
    cells = counts.groupBy(key).agg(F.collect_list(F.struct(cluster, "cnt")).alias("cells"))
    return cells.select(key, dense(F.col(f"cells.{cluster}"), F.col("cells.cnt")).alias("histogram"))


def quantise(
    images: DataFrame,
    centers: DataFrame | SharedCodebook,
    feature: str,
    out: str = "histogram",
    empty: str = "drop",
    max_bytes: int = MAX_CENTER_BYTES,
) -> DataFrame:
    """Histogram of each image from its own descriptor array, without a shuffle.

    ``empty="drop"`` leaves out images that have no descriptor, ``"zero"``
    gives them an all-zero histogram. With a codebook over ``MAX_SHARED_BYTES``
    the rows are numbered and their descriptors joined instead.
    """
    if empty not in ("drop", "zero"):
        raise ValueError("empty must be 'drop' or 'zero'")
    try:
        shared = share_codebook(centers, max_bytes)
    except CodebookTooLarge:
        return _quantise_by_search(images, centers, feature, out, empty)
    pieces, n_centers, starts = shared.pieces, shared.n_centers, np.array(shared.starts)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def count_words(descriptors: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(descriptors), 0).to_numpy(zero_copy_only=False)
        points = to_matrix(descriptors.flatten())
        out = np.zeros(len(descriptors) * n_centers, dtype=np.int32)
        if len(points):
            found = [nearest_row(points, piece.value) for piece in pieces]
            distances = np.stack([d for _, d in found])
            which = distances.argmin(axis=0)
            ids = np.stack([i for i, _ in found])[which, np.arange(len(points))] + starts[which]
            owner = np.repeat(np.arange(len(descriptors)), lengths)
            out = np.bincount(owner * n_centers + ids, minlength=len(out)).astype(np.int32)
        return list_array(out, np.full(len(descriptors), n_centers), pa.int32())

    column = F.col(feature)
    if empty == "drop":
        images = images.where(column.isNotNull() & (F.size(column) > 0))
    return images.withColumn(out, count_words(column))


def _quantise_by_search(images, centers, feature, out, empty):
    # Written, so that the numbers stay the same on both sides of the join.
    rows = materialise(images.withColumn("_image", F.monotonically_increasing_id()), "images")
    each = explode_descriptors(rows, feature, "_image")
    assigned = assign(each, centers, row_key=["_image", "pos"])
    n_centers = centers.count()
    counted = histogram(assigned, n_centers, "_image").withColumnRenamed("histogram", out)
    if empty == "drop":
        return rows.join(counted, "_image").drop("_image")
    zeros = F.array_repeat(F.lit(0), n_centers)
    return rows.join(counted, "_image", "left").withColumn(out, F.coalesce(out, zeros)).drop("_image")


def histogram_job(
    images: DataFrame, feature: str, centers: DataFrame | SharedCodebook, key: str = "image_name"
) -> DataFrame:
    """Projected scan -> quantise: ``<key, histogram>`` ready to be stored as new cells."""
    return quantise(images.select(key, feature), centers, feature).select(key, "histogram")
