"""Property graphs as two frames: ``vertices<id, ...>`` and ``edges<src, dst, ...>``."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.operators.spread import spread_join
from retinue.session import bucket_count, bucketed, materialise, shared_root

#: Neighbours in one adjacency row, about.
ADJACENCY_ROW = 10_000


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """``<id>`` of every vertex that an edge names."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def graph_from_edges(edges: DataFrame) -> Graph:
    """The vertex set is what occurs in the edges."""
    return Graph(edge_endpoints(edges), edges)


def build_graph(vertices: DataFrame, edges: DataFrame, default: dict) -> Graph:
    """Given vertices and edge endpoints; an endpoint that was not given gets ``default``.

    One aggregation over both, so the ids are shuffled once.
    """
    names = [c for c in vertices.columns if c != "id"]
    given = vertices.select("id", F.struct(*names).alias("attrs"))
    ends = edge_endpoints(edges).select("id", F.lit(None).cast(given.schema["attrs"].dataType).alias("attrs"))
    merged = given.unionByName(ends).groupBy("id").agg(F.max("attrs").alias("attrs"))
    filled = [
        F.when(F.col("attrs").isNull(), F.lit(default[n])).otherwise(F.col(f"attrs.{n}")).alias(n) for n in names
    ]
    return Graph(merged.select("id", *filled), edges)


def filter_vertices(graph: Graph, predicate: Column) -> DataFrame:
    return graph.vertices.where(predicate)


def filter_edges(graph: Graph, predicate: Column) -> DataFrame:
    return graph.edges.where(predicate)


def join_vertices(vertices: DataFrame, attrs: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Left join of vertex attributes; a vertex without a row gets the default of each column."""
    found = attrs.withColumn("_found", F.lit(True))
    joined = vertices.join(found, "id", "left")
    filled = [F.when(F.col("_found"), F.col(c)).otherwise(default).alias(c) for c, default in defaults.items()]
    return joined.select(*vertices.columns, *filled)


def triplets(graph: Graph) -> DataFrame:
    """``<src, dst, edge columns, src_*, dst_*>``: every edge with both ends' attributes.

    Edges of a hub are spread over several tasks by their other end; the hub's
    attributes are repeated once for each. Vertex ids are unique.
    """
    found, total = graph.edges, graph.edges.count()
    for end, other in (("src", "dst"), ("dst", "src")):
        own = graph.vertices.select(
            F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in graph.vertices.columns if c != "id"]
        )
        found = spread_join(found, own, end, [other], total=total, sizes=edge_counts(graph.edges, end))
    attributes = [f"{end}_{c}" for end in ("src", "dst") for c in graph.vertices.columns if c != "id"]
    return found.select("src", "dst", *[c for c in graph.edges.columns if c not in ("src", "dst")], *attributes)


def edge_counts(edges: DataFrame, end: str) -> DataFrame:
    """``<end, _n>``: the edges at every vertex on one side."""
    return edges.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))


def facts(graph: Graph, name: str = "name", attr: str = "attr") -> DataFrame:
    """``<fact>``: "<source name> is the <edge attribute> of <target name>"."""
    text = F.concat(F.col(f"src_{name}"), F.lit(" is the "), F.col(attr), F.lit(" of "), F.col(f"dst_{name}"))
    return triplets(graph).select(text.alias("fact"))


def subgraph(graph: Graph, predicate: Column) -> Graph:
    """Vertices that pass and the edges with both ends among them. Hubs are spread as in :func:`triplets`."""
    kept = graph.vertices.where(predicate)
    edges, total = graph.edges, graph.edges.count()
    for end, other in (("src", "dst"), ("dst", "src")):
        ids = kept.select(F.col("id").alias(end))
        edges = spread_join(edges, ids, end, [other], "left_semi", total=total, sizes=edge_counts(graph.edges, end))
    return Graph(kept, edges.select(graph.edges.columns))


def pagerank(
    graph: Graph,
    tol: float = 0.001,
    reset: float = 0.15,
    rounds: int | None = None,
    max_iter: int | None = None,
) -> DataFrame:
    """``<id, rank>``, un-normalised: ``reset + (1 - reset) * sum(rank / outdegree)``.

    Starts every vertex at ``reset`` and passes on what each rank gained in the
    last round. A vertex whose gain is at most ``tol`` sends nothing, and the
    loop ends when no vertex sends. Parallel edges count separately; the rank of
    a vertex without out-edges goes nowhere. ``rounds`` asks for that many
    rounds at most instead; ``max_iter`` is a bound that fails when reached.
    """
    shared_root(graph.edges.sparkSession)  # a checkpoint folder is set from here on
    rows, degrees = _out_edges(graph.edges)
    start = graph.vertices.select("id").join(degrees.withColumnRenamed("src", "id"), "id", "left")
    ranks = start.select(
        "id", "degree", "salts", F.lit(float(reset)).alias("rank"), F.lit(float(reset)).alias("gain")
    ).checkpoint()
    # The edges are laid out once; a round then shuffles only vertex-sized rows:
    # what the senders pass on, and that summed per receiver before it moves.
    with bucketed(rows, "adjacency", "src", "salt") as weighted:
        for done in itertools.count(1):
            if rounds is not None and done > rounds:
                break
            if max_iter is not None and done > max_iter:
                raise RuntimeError(f"ranks have not converged to {tol} after {max_iter} rounds")
            # A round reads the ranks twice, so each one is cut off from the last.
            ranks = _rank_round(ranks, weighted, tol, reset).checkpoint()
            if ranks.where(F.col("gain") > tol).isEmpty():
                break
    return ranks.select("id", "rank")


def _rank_round(ranks: DataFrame, weighted: DataFrame, tol: float, reset: float) -> DataFrame:
    sending = ranks.where((F.col("gain") > tol) & F.col("degree").isNotNull())
    share = F.col("gain") * (1.0 - reset) / F.col("degree")
    copies = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    senders = sending.select(F.col("id").alias("src"), share.alias("share"), copies.alias("salt"))
    # The small side of both joins is hashed, so that neither the edges nor the ranks are sorted in every round.
    sent = weighted.join(senders.hint("shuffle_hash"), ["src", "salt"]).select(F.inline("neighbours"), "share")
    received = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("weight") * F.col("share")).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    joined = ranks.drop("gain").join(received.hint("shuffle_hash"), "id", "left")
    return joined.select("id", "degree", "salts", (F.col("rank") + gain).alias("rank"), gain.alias("gain"))


def _out_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``<src, salt, neighbours array<struct<dst, weight>>>`` and ``<src, degree, salts>``.

    A row holds about ``ADJACENCY_ROW`` neighbours; a hub has as many rows as
    it needs, told apart by a salt, so that neither building nor joining them
    puts all its edges into one task. Only the parallel edges of hubs are
    counted first; those of others stay single in a row that is small anyway.
    So all edges move once, to where they stay.
    """
    ends = edges.select("src", "dst")
    degrees = ends.groupBy("src").agg(F.count("*").alias("degree"))
    salts = F.ceil(F.col("degree") / F.lit(ADJACENCY_ROW)).cast("int")
    degrees = materialise(degrees.withColumn("salts", salts), "degrees")
    # Written, so that their size decides how they are joined.
    hubs = materialise(degrees.where(F.col("salts") > 1).select("src", "salts"), "hubs")
    # Always 0, yet not a constant, which would be left out of the layout of the rows.
    alone = F.pmod(F.xxhash64("dst"), F.lit(1)).cast("int")
    single = ends.select("src", alone.alias("salt"), "dst", F.lit(1).cast("long").alias("weight"))
    if not hubs.isEmpty():
        single = single.join(hubs, "src", "left_anti")
        salt = F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int")
        salted = ends.join(hubs, "src").withColumn("salt", salt)
        single = single.unionByName(salted.groupBy("src", "salt", "dst").agg(F.count("*").alias("weight")))
    # The explicit step tells the rows of a hub apart before anything is gathered.
    placed = single.repartition(bucket_count(edges.sparkSession), "src", "salt")
    rows = placed.groupBy("src", "salt").agg(F.collect_list(F.struct("dst", "weight")).alias("neighbours"))
    return rows, degrees


def top_ranked(ranks: DataFrame, n: int = 5, by: str = "rank") -> DataFrame:
    """The ``n`` highest, descending; ties by id."""
    return ranks.orderBy(F.desc(by), "id").limit(n)


def top_pagerank(
    graph: Graph, attrs: DataFrame, predicate: Column, n: int = 5, tol: float = 0.001, **options
) -> DataFrame:
    """Rank the subgraph of the vertices whose attributes pass; ``<id, attributes, rank>`` of the ``n`` highest.

    A vertex without an attribute row has an empty list (or null) there.
    """
    empty = {}
    for field in attrs.drop("id").schema:
        nothing = F.array() if isinstance(field.dataType, T.ArrayType) else F.lit(None)
        empty[field.name] = nothing.cast(field.dataType)
    described = join_vertices(graph.vertices.select("id"), attrs, empty)
    kept = subgraph(Graph(described, graph.edges), predicate)
    # Read by several steps of the ranking, and joins made both.
    kept = Graph(materialise(kept.vertices, "kept"), materialise(kept.edges, "kept-edges"))
    ranks = pagerank(kept, tol=tol, **options)
    return top_ranked(join_vertices(kept.vertices, ranks, {"rank": F.lit(0.0)}), n)
