"""Exact nearest images by squared histogram distance, and lookups of the results.

Two physical forms give the same rows:

* few queries (their number is checked): the queries travel to the gallery,
  every task keeps only its own best rows per query;
* many queries: a pivot-partitioned join. Gallery vectors are grouped into cells
  around a bounded set of pivots. A query first searches the cell of its own
  nearest pivot; the distance of the ``k``-th row found there bounds the result,
  and the triangle inequality tells which other cells can still hold a nearer
  row. Every cell is cut into tiles of bounded size on both sides, so that no
  task depends on how large a cell is.

Neither form materialises the pairs.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.functions.arrays import squared_distance
from retinue.functions.vectors import row_blocks, smallest_per_row, squared_distances, to_matrix
from retinue.session import materialise

#: Up to this many queries are sent to the gallery instead of being shuffled.
BROADCAST_QUERIES = 4096
#: ... if their vectors hold no more values than this (32 MB as float64).
BROADCAST_VALUES = 4_000_000
#: Gallery rows of a tile. Its queries are more by the factor, since every
#: further part of the queries repeats the gallery rows of the cell.
TILE_ROWS = 16_384
QUERY_FACTOR = 2
#: The pivots grow with the square root of the gallery, up to this many bytes of
#: vectors, which the driver and every task keep.
PIVOT_BYTES = 64 * 1024 * 1024
#: Additions to a prepared gallery before it is written as one table again.
MOST_ADDITIONS = 32
#: Rows per Arrow batch that the router emits.
EMIT_ROWS = 8192
#: Tables of a block's cells that are held at once where queries are routed, and where they are matched.
ROUTED_TABLES = 8
MATCHED_TABLES = 4
#: Relative slack of the float bounds, far above their rounding error.
SLACK = 1e-9


def top_k_similar(
    queries: DataFrame,
    gallery: DataFrame | Gallery,
    k: int = 10,
    key: str = "image_name",
    vector: str = "histogram",
    broadcast_queries: int = BROADCAST_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``<query, rank, match, distance>``: the ``k`` nearest gallery rows of each query.

    Exact; ties go to the smaller name; a gallery below ``k`` rows gives fewer
    rows. Keys are unique on both sides; rows without a vector take no part.
    """
    if not isinstance(gallery, Gallery):
        gallery = Gallery(gallery, k, key, vector)
    elif gallery.k is None or gallery.k < k:
        raise ValueError("the gallery was prepared for fewer results")
    search = _Search(queries, gallery, key, vector, k=k)
    near = search.candidates(broadcast_queries, tile_rows)
    order = Window.partitionBy("query").orderBy("distance", "match")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "match", "distance")


def nearest(queries: DataFrame, gallery: DataFrame, **options) -> DataFrame:
    """``<query, match, distance>``: the single nearest gallery row."""
    return top_k_similar(queries, gallery, k=1, **options).drop("rank")


def all_matches(
    queries: DataFrame,
    gallery: DataFrame,
    max_distance: int,
    key: str = "image_name",
    vector: str = "histogram",
    broadcast_queries: int = BROADCAST_QUERIES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``<query, distance, match, copies>``: every gallery vector within ``max_distance``.

    Images with one and the same vector form one row, named by the first of
    them and counted in ``copies``; :func:`copies_of` lists its members. So the
    result is whole, yet a large group of copies does not multiply out.
    """
    search = _Search(queries, Gallery(gallery, None, key, vector), key, vector, max_distance=max_distance)
    near = search.candidates(broadcast_queries, tile_rows)
    return near.select("query", "distance", "match", "copies")


def copies_of(gallery: DataFrame, key: str = "image_name", vector: str = "histogram") -> DataFrame:
    """``<match, image>``: the members behind each ``match`` of :func:`all_matches`."""
    rows = gallery.where(F.col(vector).isNotNull()).select(F.col(key).alias("image"), vector)
    heads = rows.groupBy(vector).agg(F.min("image").alias("match"))
    return rows.join(heads, vector).select("match", "image")


def pairwise_distance(
    pairs: DataFrame,
    queries: DataFrame,
    gallery: DataFrame,
    key: str = "image_name",
    vector: str = "histogram",
) -> DataFrame:
    """``<query, match, distance>`` for the listed ``pairs<query, match>``: two key joins."""
    left = queries.select(F.col(key).alias("query"), F.col(vector).alias("query_vector"))
    right = gallery.select(F.col(key).alias("match"), F.col(vector).alias("match_vector"))
    joined = pairs.select("query", "match").join(left, "query").join(right, "match")
    distance = squared_distance(F.col("query_vector"), F.col("match_vector"))
    return joined.select("query", "match", distance.alias("distance"))


class Gallery:
    """The gallery side of a search for up to ``k`` nearest rows (or, with ``k=None``, for a radius).

    What the pivot-partitioned join needs of it is made at the first search
    that takes this form, written to the shared folder, and serves all later
    searches, such as the batches of a stream.
    """

    def __init__(self, images: DataFrame, k: int | None = 10, key: str = "image_name", vector: str = "histogram"):
        self.k = k
        self.key, self.vector, self.additions = key, vector, 0
        rows = images.where(F.col(vector).isNotNull()).select(F.col(key).alias("match"), F.col(vector).alias("vector"))
        if k is None:
            heads = rows.groupBy("vector").agg(F.min("match").alias("match"), F.count("*").alias("copies"))
            rows = heads.select("match", "vector", "copies")
        self.rows = rows

    @cached_property
    def cells(self) -> tuple[DataFrame, dict, np.ndarray] | None:
        """Rows with their ``cell`` and ``reach`` (distance to its pivot), the cells' sizes and ranges, the pivots."""
        rows, spark = self.rows, self.rows.sparkSession
        if self.k is not None:
            # Of images with the same vector only the k first names can appear
            # in a result. The limit is applied before the shuffle as well, so
            # a huge group of copies costs k rows per task.
            order = Window.partitionBy("vector").orderBy("match")
            rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= self.k).drop("nth")
        rows = materialise(rows, "gallery")
        n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        n_pivots = min(PIVOT_BYTES // (8 * max(1, width or 1)), max(1, math.isqrt(n)))
        # A fixed pseudo-random choice; it steers the cost, never the result.
        copies = self.k or 1
        chosen = rows.select("vector").orderBy(F.xxhash64("vector")).limit(n_pivots * copies).toArrow()
        if not chosen.num_rows:
            return None
        pivots = np.unique(to_matrix(chosen.column("vector")), axis=0)[:n_pivots]
        added = [T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]
        cell_of = _cell_of(spark.sparkContext.broadcast(pivots))
        celled = materialise(rows.mapInArrow(cell_of, T.StructType(rows.schema.fields + added)), "cells")
        return celled, _cell_sizes(celled), pivots


    def added(self, images: DataFrame) -> Gallery:
        """This gallery with further images, of which a name that it has already takes the new vector.

        New rows are put to the pivots that are there (the choice of pivots
        steers the cost, never the result) and the cells' sizes and ranges are
        brought up to date, so an addition costs its own size. After
        ``MOST_ADDITIONS`` of them, or when a vector was replaced, what was
        prepared is made anew from the rows, which are written as one table.
        """
        if self.k is None:
            raise ValueError("galleries for a radius are not added to")
        new = Gallery(images, self.k, self.key, self.vector)
        new.rows = materialise(new.rows, "gallery-added")
        known = self.rows.join(F.broadcast(new.rows.withColumnRenamed("vector", "_new")), "match")
        if known.filter(~F.col("vector").eqNullSafe(F.col("_new"))).isEmpty():
            # Images that are there with the same vector are nothing new.
            new.rows = new.rows.join(F.broadcast(known.select("match")), "match", "left_anti").select("match", "vector")
            kept = self.rows
            replaced = False
        else:
            kept = self.rows.join(F.broadcast(new.rows.select("match")), "match", "left_anti").select("match", "vector")
            replaced = True
        grown = Gallery.__new__(Gallery)
        grown.k, grown.key, grown.vector = self.k, self.key, self.vector
        grown.additions = self.additions + 1
        grown.rows = kept.unionByName(new.rows)
        if replaced or grown.additions > MOST_ADDITIONS:
            grown.rows, grown.additions = materialise(grown.rows, "gallery"), 0
        elif self.__dict__.get("cells") is not None:
            celled, sizes, pivots = self.cells
            cell_of = _cell_of(self.rows.sparkSession.sparkContext.broadcast(pivots))
            more = materialise(new.rows.mapInArrow(cell_of, celled.schema), "cells-added")
            grown.__dict__["cells"] = celled.unionByName(more), _merged_sizes(sizes, _cell_sizes(more)), pivots
        return grown


def _cell_sizes(celled: DataFrame) -> dict:
    """Rows and reach of every cell; at most one row per pivot reaches the driver."""
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"))
    return sizes.toArrow().to_pydict()


def _merged_sizes(first: dict, second: dict) -> dict:
    found = dict(zip(first["cell"], zip(first["n"], first["low"], first["high"])))
    for cell, n, low, high in zip(second["cell"], second["n"], second["low"], second["high"]):
        was = found.get(cell, (0, low, high))
        found[cell] = was[0] + n, min(was[1], low), max(was[2], high)
    columns = list(zip(*found.values())) or [(), (), ()]
    return {"cell": list(found), "n": list(columns[0]), "low": list(columns[1]), "high": list(columns[2])}


class _Search:
    """One search: what is asked (``k`` nearest or a radius) and over which rows."""

    def __init__(self, queries, gallery, key, vector, k=None, max_distance=None):
        self.k = k
        self.max_distance = max_distance
        self.gallery = gallery
        self.spark = queries.sparkSession
        self.queries = queries.where(F.col(vector).isNotNull()).select(
            F.col(key).alias("query"), F.col(vector).alias("vector")
        )
        element = gallery.rows.schema["vector"].dataType.elementType
        whole = isinstance(element, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        self.schema = T.StructType(
            [
                T.StructField("query", self.queries.schema["query"].dataType),
                T.StructField("match", gallery.rows.schema["match"].dataType),
                T.StructField("distance", T.LongType() if whole else T.DoubleType()),
            ]
            + ([] if k is not None else [T.StructField("copies", T.LongType())])
        )

    # -- choice of the physical form ------------------------------------

    def candidates(self, broadcast_queries: int, tile_rows: int) -> DataFrame:
        few = self._few_queries(broadcast_queries)
        return self._scan_gallery(few) if few is not None else self._tile_join(tile_rows)

    def _few_queries(self, most: int) -> pa.Table | None:
        """All queries if they are within the bound, else ``None``; reads at most one more."""
        if most <= 0:
            return None
        width = self.queries.select(F.max(F.size("vector"))).first()
        most = min(most, BROADCAST_VALUES // max(1, width[0] or 1))
        bound = math.inf if self.max_distance is None else float(self.max_distance)
        head = self.queries.withColumn("bound", F.lit(bound)).limit(most + 1).toArrow()
        return head if head.num_rows <= most else None

    # -- queries travel to the gallery ------------------------------------

    def _scan_gallery(self, few: pa.Table) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(few)
        match_block, k = self._matcher(), self.k

        def scan(batches):
            best = None
            for batch in batches:
                part = pa.Table.from_batches([batch])
                if part.num_rows == 0 or shared.value.num_rows == 0:
                    continue
                found = match_block(shared.value, part)
                if k is None:
                    yield from found.to_batches()
                else:
                    best = found if best is None else _best_rows(pa.concat_tables([best, found]), k)
            if best is not None:
                yield from best.to_batches()

        return self.gallery.rows.mapInArrow(scan, self.schema)

    # -- pivot-partitioned join -------------------------------------------

    def _tile_join(self, tile_rows: int) -> DataFrame:
        if self.gallery.cells is None:
            return self.spark.createDataFrame([], self.schema)
        celled, cells, pivots = self.gallery.cells
        queries = materialise(self.queries, "queries")
        plan = self.spark.sparkContext.broadcast((pivots, cells))
        bounded = T.StructType(queries.schema.fields + [T.StructField("bound", T.DoubleType())])
        routed = T.StructType(bounded.fields + [T.StructField("cell", T.IntegerType())])
        if self.k is None:
            asking = queries.withColumn("bound", F.lit(float(self.max_distance)))
            return self._search_tiles(asking.mapInArrow(_other_cells(plan, False), routed), celled, cells, tile_rows)
        asking = queries.withColumn("bound", F.lit(float("inf")))
        home = self._search_tiles(asking.mapInArrow(_home_cell(plan), routed), celled, cells, tile_rows)
        order = Window.partitionBy("query").orderBy("distance", "match")
        nth = home.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= self.k)
        home = materialise(nth, "home")
        kth = home.where(F.col("nth") == self.k).select("query", F.col("distance").cast("double").alias("kth"))
        asking = queries.join(kth, "query", "left").select(
            *queries.columns, F.coalesce("kth", F.lit(float("inf"))).alias("bound")
        )
        asking = materialise(asking, "bounded")
        rest = self._search_tiles(asking.mapInArrow(_other_cells(plan, True), routed), celled, cells, tile_rows)
        return home.drop("nth").unionByName(rest)

    def _search_tiles(self, routed: DataFrame, celled: DataFrame, cells: dict, tile_rows: int) -> DataFrame:
        """Results of ``routed<query, vector, bound, cell>`` within their cells."""
        # Both sides of a cell are cut into parts by the counted number of rows.
        asked = routed.groupBy("cell").count().toArrow().to_pydict()
        asked = dict(zip(asked["cell"], asked["count"]))
        layout = self.spark.createDataFrame(
            [
                (int(c), math.ceil(n / tile_rows), math.ceil(asked[c] / (QUERY_FACTOR * tile_rows)))
                for c, n in zip(cells["cell"], cells["n"])
                if c in asked
            ],
            "cell int, gallery_parts int, query_parts int",
        )
        layout = F.broadcast(layout)  # one row per pivot, which PIVOT_BYTES bounds
        tile = ["cell", "gallery_part", "query_part"]

        def every(parts):
            return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

        left = (
            routed.join(layout, "cell")
            .withColumn("query_part", F.pmod(F.xxhash64("query"), "query_parts").cast("int"))
            .withColumn("gallery_part", every("gallery_parts"))
            .select(*tile, "query", "vector", "bound")
        )
        right = (
            celled.join(layout, "cell")
            .withColumn("gallery_part", F.pmod(F.xxhash64("match"), "gallery_parts").cast("int"))
            .withColumn("query_part", every("query_parts"))
            .select(*tile, *self.gallery.rows.columns)
        )
        match_block, schema = self._matcher(), self.schema

        def match_tile(asking: pa.Table, stored: pa.Table) -> pa.Table:
            if asking.num_rows == 0 or stored.num_rows == 0:
                return _arrow_schema(schema).empty_table()
            return match_block(asking, stored)

        return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(match_tile, schema)

    def _matcher(self):
        k, schema = self.k, self.schema

        def match_block(asking: pa.Table, stored: pa.Table) -> pa.Table:
            """Results of one block of queries within one block of the gallery."""
            stored = stored.sort_by("match")
            vectors = to_matrix(stored.column("vector"))
            unique, first, where = np.unique(
                to_matrix(asking.column("vector")), axis=0, return_index=True, return_inverse=True
            )
            # The bound follows from the vector, so equal queries share it.
            bound = asking.column("bound").to_numpy()[first]
            if k is not None:
                bound = bound * (1 + SLACK)
            rows, cols, dists = [], [], []
            for block in row_blocks(len(unique), MATCHED_TABLES * len(vectors)):
                d = squared_distances(unique[block], vectors)
                near = d <= bound[block, None]
                if k is not None:
                    r, c = smallest_per_row(d, k)
                    keep = near[r, c]
                    r, c = r[keep], c[keep]
                else:
                    r, c = np.nonzero(near)
                rows.append(r + block.start)
                cols.append(c)
                dists.append(d[r, c])
            rows, cols, dists = map(np.concatenate, (rows, cols, dists))
            # Equal queries were searched once; give each of them its result.
            starts = np.searchsorted(rows, np.arange(len(unique) + 1))
            lengths = np.diff(starts)[where.ravel()]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            skip = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = starts[:-1][where.ravel()][owner] + skip
            columns = {
                "query": asking.column("query").take(pa.array(owner)),
                "match": stored.column("match").take(pa.array(cols[at])),
                "distance": pa.array(dists[at]).cast(_arrow_schema(schema).field("distance").type, safe=False),
            }
            if k is None:
                columns["copies"] = stored.column("copies").take(pa.array(cols[at]))
            return pa.table(columns).cast(_arrow_schema(schema))

        return match_block


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _best_rows(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each query of a table that several blocks added to."""
    found = found.sort_by([("query", "ascending"), ("distance", "ascending"), ("match", "ascending")])
    query = found.column("query").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return found.filter(pa.array(nth < k))


def _cell_of(pivots):
    def add_cell(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = to_matrix(batch.column("vector"))
            cell = np.empty(len(vectors), np.int32)
            reach = np.empty(len(vectors))
            for block in row_blocks(len(vectors), len(pivots.value)):
                d = squared_distances(vectors[block], pivots.value)
                cell[block] = d.argmin(axis=1)
                reach[block] = np.sqrt(d.min(axis=1).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(reach)], [*batch.schema.names, "cell", "reach"]
            )

    return add_cell


def _home_cell(plan):
    """The cell of each query's nearest pivot."""

    def home(batches):
        pivots, _ = plan.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = to_matrix(batch.column("vector"))
            cell = np.empty(len(vectors), np.int32)
            for block in row_blocks(len(vectors), len(pivots)):
                cell[block] = squared_distances(vectors[block], pivots).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return home


def _other_cells(plan, skip_home: bool):
    """Repeat each query once per cell that can hold a row within its bound."""

    def cells_for(vectors, bound, pivots, cells):
        ids = np.asarray(cells["cell"])
        low, high = np.asarray(cells["low"]), np.asarray(cells["high"])
        to_pivot = np.sqrt(squared_distances(vectors, pivots).astype(np.float64))
        bound = np.sqrt(bound)
        bound = (bound + SLACK * (1.0 + to_pivot.max(axis=1) + high.max()))[:, None]
        d = to_pivot[:, ids]
        keep = (d - bound <= high) & (d + bound >= low)
        # A row of cell c is nearer to pivot c than to the pivot nearest to the
        # query, so the query is at least this far from it.
        home = to_pivot.argmin(axis=1)
        # Only the pivots that are nearest to a query of this block, not all of them with each other.
        homes, own = np.unique(home, return_inverse=True)
        between = np.sqrt(squared_distances(pivots[homes], pivots[ids]).astype(np.float64))[own]
        gap = d**2 - (to_pivot.min(axis=1) ** 2)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            margin = np.where(between > 0, gap / (2 * between), 0.0)
        keep &= margin <= bound
        if skip_home:
            keep &= ids[None, :] != home[:, None]
        rows, cols = np.nonzero(keep)
        return rows, ids[cols]

    def route(batches):
        pivots, cells = plan.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = to_matrix(batch.column("vector"))
            bound = batch.column("bound").to_numpy()
            for block in row_blocks(len(vectors), ROUTED_TABLES * len(pivots)):
                rows, cell = cells_for(vectors[block], bound[block], pivots, cells)
                for start in range(0, len(rows), EMIT_ROWS):
                    part = slice(start, start + EMIT_ROWS)
                    taken = batch.take(pa.array(rows[part] + block.start))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cell[part].astype(np.int32))], [*batch.schema.names, "cell"]
                    )

    return route


# -- stored results -----------------------------------------------------------


def matches_wide(matches: DataFrame, k: int = 10) -> DataFrame:
    """``<query, image_1 .. image_k>`` with cells ``name#distance``."""
    cell = F.concat_ws("#", "match", F.col("distance").cast("string"))
    return matches.groupBy("query").agg(
        *[F.max(F.when(F.col("rank") == i, cell)).alias(f"image_{i}") for i in range(1, k + 1)]
    )


def matches_long(wide: DataFrame, k: int = 10) -> DataFrame:
    """Inverse of :func:`matches_wide`; the last ``#`` separates name and distance."""
    cells = F.array(*[F.col(f"image_{i}") for i in range(1, k + 1)])
    rows = wide.select("query", F.posexplode(cells).alias("pos", "cell")).where(F.col("cell").isNotNull())
    return rows.select(
        "query",
        (F.col("pos") + 1).alias("rank"),
        F.regexp_extract("cell", r"(?s)^(.*)#", 1).alias("match"),
        F.element_at(F.split("cell", "#"), -1).cast("long").alias("distance"),
    )


def expand_matches(
    wide: DataFrame, images: DataFrame, k: int = 10, key: str = "image_name", content: str = "content"
) -> DataFrame:
    """``<query, rank, match, distance, content>``: stored results joined back to the images.

    Rank 0 is the query itself. A match whose image is gone keeps its row with
    null content.
    """
    own = wide.select(
        "query", F.lit(0).alias("rank"), F.col("query").alias("match"), F.lit(None).cast("long").alias("distance")
    )
    stored = images.select(F.col(key).alias("match"), F.col(content))
    return own.unionByName(matches_long(wide, k)).join(stored, "match", "left").select(
        "query", "rank", "match", "distance", content
    )
