"""Property graph and PageRank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retinue.operators import graph as G
from retinue.plans.registry import query, table
from retinue.session import shared_dir
from retinue.sources.files import parse_vectors, read_edge_list, read_vertex_attrs

DEFAULT = {"name": "nobody", "position": "none"}


def order_graph(spark, sf_dir) -> G.Graph:
    """Customers as vertices, orders as edges; most order ids are no customer and get the default."""
    vertices = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("position")
    )
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("attr")
    )
    return G.build_graph(vertices, edges, DEFAULT)


GRAPH_SQL = """
edges AS (SELECT o_custkey AS src, o_orderkey AS dst, o_orderpriority AS attr FROM orders),
ids AS (SELECT c_custkey AS id FROM customer UNION SELECT src FROM edges UNION SELECT dst FROM edges),
vertices AS (SELECT id, coalesce(c_name, 'nobody') AS name, coalesce(c_mktsegment, 'none') AS position
             FROM ids LEFT JOIN customer ON id = c_custkey)"""


@query("build_graph", f"WITH {GRAPH_SQL} SELECT id, name, position FROM vertices")
def build_graph(spark, sf_dir):
    return order_graph(spark, sf_dir).vertices


@query("graph_from_edges", f"WITH {GRAPH_SQL} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def graph_from_edges(spark, sf_dir):
    return G.graph_from_edges(order_graph(spark, sf_dir).edges).vertices


@query("filter_vertices", f"WITH {GRAPH_SQL} SELECT count(*) AS n FROM vertices WHERE position = 'BUILDING'")
def filter_vertices(spark, sf_dir):
    return G.filter_vertices(order_graph(spark, sf_dir), F.col("position") == "BUILDING").agg(F.count("*").alias("n"))


@query("filter_edges", f"WITH {GRAPH_SQL} SELECT count(*) AS n FROM edges WHERE src > dst")
def filter_edges(spark, sf_dir):
    return G.filter_edges(order_graph(spark, sf_dir), F.col("src") > F.col("dst")).agg(F.count("*").alias("n"))


@query(
    "triplets",
    f"""WITH {GRAPH_SQL}
    SELECT e.src, e.dst, e.attr, s.name AS src_name, s.position AS src_position, d.name AS dst_name,
           d.position AS dst_position
    FROM edges e JOIN vertices s ON s.id = e.src JOIN vertices d ON d.id = e.dst""",
)
def triplets(spark, sf_dir):
    return G.triplets(order_graph(spark, sf_dir)).select(
        "src", "dst", "attr", "src_name", "src_position", "dst_name", "dst_position"
    )


@query(
    "triplet_facts",
    f"""WITH {GRAPH_SQL} SELECT s.name || ' is the ' || e.attr || ' of ' || d.name AS fact
    FROM edges e JOIN vertices s ON s.id = e.src JOIN vertices d ON d.id = e.dst""",
)
def triplet_facts(spark, sf_dir):
    return G.facts(order_graph(spark, sf_dir))


@query(
    "join_vertices",
    f"""WITH {GRAPH_SQL}, spent AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY o_custkey)
    SELECT id, name, coalesce(n_orders, 0) AS n_orders FROM vertices LEFT JOIN spent USING (id)""",
)
def join_vertices(spark, sf_dir):
    graph = order_graph(spark, sf_dir)
    counts = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_orders"))
    return G.join_vertices(graph.vertices.select("id", "name"), counts, {"n_orders": F.lit(0).cast("long")})


@query(
    "subgraph",
    f"""WITH {GRAPH_SQL}, kept AS (SELECT id FROM vertices WHERE position <> 'none')
    SELECT src, dst, attr FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""",
)
def subgraph(spark, sf_dir):
    return G.subgraph(order_graph(spark, sf_dir), F.col("position") != "none").edges


def supply_graph(spark, sf_dir) -> G.Graph:
    """Line items as edges between suppliers (odd ids) and parts (even ids); returns point back."""
    part, supplier = F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1
    back = F.col("l_returnflag") == "R"
    edges = table(spark, sf_dir, "lineitem").select(
        F.when(back, part).otherwise(supplier).alias("src"), F.when(back, supplier).otherwise(part).alias("dst")
    )
    return G.graph_from_edges(edges)


RANK_SQL = """
edges AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN l_partkey * 2 ELSE l_suppkey * 2 + 1 END AS src,
         CASE WHEN l_returnflag = 'R' THEN l_suppkey * 2 + 1 ELSE l_partkey * 2 END AS dst
  FROM lineitem),
ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
weights AS (SELECT src, dst, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY src) AS w FROM edges GROUP BY src, dst),
r0 AS (SELECT id, CAST(0.15 AS DOUBLE) AS rank FROM ids)""" + "".join(
    f""",
r{i} AS MATERIALIZED (
  SELECT id, 0.15 + coalesce(0.85 * s, 0) AS rank
  FROM ids LEFT JOIN (SELECT dst, sum(rank * CAST(w AS DOUBLE)) AS s FROM weights JOIN r{i - 1} ON src = id GROUP BY dst) ON dst = id)"""
    for i in range(1, 11)
)


@query("pagerank", f"WITH {RANK_SQL} SELECT id, round(rank, 5) AS rank FROM r10")
def pagerank(spark, sf_dir):
    """Ten rounds without a tolerance."""
    ranks = G.pagerank(supply_graph(spark, sf_dir), tol=0.0, rounds=10)
    return ranks.select("id", F.round("rank", 5).alias("rank"))


def gains_sql(edges: str) -> str:
    """Rounds in which a vertex passes on its last gain while that exceeds the tolerance."""
    return f"""
weights AS MATERIALIZED (
  SELECT src, dst, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY src) AS w FROM {edges} GROUP BY src, dst),
gains AS (
  SELECT 0 AS round, id, CAST(0.15 AS DOUBLE) AS gain FROM ids
  UNION ALL
  SELECT round + 1, dst, 0.85 * sum(gain * w) FROM gains JOIN weights ON src = id
  WHERE gain > 0.001 GROUP BY round, dst),
ranks AS (SELECT id, sum(gain) AS rank FROM gains GROUP BY id)"""


SUPPLY_SQL = RANK_SQL.split("weights AS")[0]


@query(
    "pagerank_to_tolerance", f"WITH RECURSIVE {SUPPLY_SQL} {gains_sql('edges')} SELECT id, round(rank, 5) AS rank FROM ranks"
)
def pagerank_to_tolerance(spark, sf_dir):
    return G.pagerank(supply_graph(spark, sf_dir), tol=0.001).select("id", F.round("rank", 5).alias("rank"))


@query(
    "top_pagerank",
    f"""WITH RECURSIVE {SUPPLY_SQL.replace('ids AS', 'every AS')}
    attrs AS (SELECT p_partkey * 2 AS id, p_name AS first FROM part
              UNION ALL SELECT s_suppkey * 2 + 1, s_name FROM supplier WHERE s_acctbal >= 0),
    ids AS (SELECT id FROM every SEMI JOIN attrs USING (id)),
    kept AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)),
    {gains_sql('kept')}
    SELECT id, first, round(rank, 5) AS rank FROM ranks JOIN attrs USING (id) ORDER BY ranks.rank DESC, id LIMIT 5""",
)
def top_pagerank(spark, sf_dir):
    """Rank among the parts and the suppliers that owe nothing (others have no attributes); five best."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"), F.array("p_name", "p_brand").alias("attrs"))
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(
        (F.col("s_suppkey") * 2 + 1).alias("id"), F.array("s_name", F.col("s_nationkey").cast("string")).alias("attrs")
    )
    top = G.top_pagerank(supply_graph(spark, sf_dir), parts.union(suppliers), F.size("attrs") == 2, 5)
    return top.select("id", F.col("attrs")[0].alias("first"), F.round("rank", 5).alias("rank"))


@query(
    "top_ranked",
    "SELECT c_custkey AS id, c_acctbal AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5",
)
def top_ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("rank"))
    return G.top_ranked(rows)


@query("read_edge_list", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def edge_list(spark, sf_dir):
    """Orders written as an edge-list text file and read back."""
    path = shared_dir(spark, "edge-list")
    line = F.concat_ws(" ", "o_custkey", "o_orderkey").alias("value")
    table(spark, sf_dir, "orders").select(line).write.text(path)
    return read_edge_list(spark, path)


@query(
    "read_vertex_attrs",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(2 AS INTEGER) AS n FROM customer",
)
def vertex_attrs(spark, sf_dir):
    path = shared_dir(spark, "vertices")
    table(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("value")).write.text(path)
    rows = read_vertex_attrs(spark, path)
    return rows.select("id", F.col("attrs")[0].alias("name"), F.col("attrs")[1].alias("segment"), F.size("attrs").alias("n"))


@query(
    "parse_vectors",
    """SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM customer
       WHERE c_mktsegment <> 'BUILDING'""",
)
def vectors(spark, sf_dir):
    """CSV lines with padding and empty tokens; lines carrying the header marker are dropped."""
    c = F.col
    cells = F.concat(c("c_nationkey").cast("string"), F.lit(", "), c("c_acctbal").cast("string"), F.lit(",,"))
    line = F.when(c("c_mktsegment") == "BUILDING", F.lit("Channel,Region")).otherwise(cells)
    lines = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), line.alias("value"))
    rows = parse_vectors(lines, "Channel")
    return rows.select("id", c("vector")[0].alias("nation"), c("vector")[1].alias("balance"))
