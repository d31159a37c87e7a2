import pytest
from pyspark.sql import functions as F

from retinue.operators import graph as G
from retinue.sources.files import read_edge_list, read_vertex_attrs, read_vectors

LINKS = [(5, 3), (8, 3), (3, 5), (9, 4), (2, 4), (4, 2), (2, 9), (9, 2), (8, 9)]
MEMBERS = "2,ash,Tree One\n3,elm,Tree Two\n4,oak,Tree Three\n5,fir,Tree Four\n8,yew,Tree Five\n9,box,Tree Six\n11,bare\n"


def plain_ranks(links, rounds=500):
    """Ranks by repeating the definition."""
    ids = {v for link in links for v in link}
    out = {v: sum(src == v for src, _ in links) for v in ids}
    ranks = dict.fromkeys(ids, 0.15)
    for _ in range(rounds):
        ranks = {v: 0.15 + 0.85 * sum(ranks[src] / out[src] for src, dst in links if dst == v) for v in ids}
    return ranks


FIXED_POINT = plain_ranks(LINKS)


@pytest.fixture
def people(spark):
    vertices = spark.createDataFrame(
        [(3, "ida", "trainee"), (7, "ole", "fitter"), (5, "mia", "master"), (2, "tom", "master")],
        "id long, name string, position string",
    )
    edges = spark.createDataFrame(
        [(3, 7, "helper"), (5, 3, "teacher"), (2, 5, "partner"), (5, 7, "chief"), (4, 0, "pupil")],
        "src long, dst long, attr string",
    )
    return G.build_graph(vertices, edges, {"name": "nobody", "position": "none"})


def test_missing_vertices_get_the_default(people):
    rows = {r.id: (r.name, r.position) for r in people.vertices.collect()}
    assert rows[0] == rows[4] == ("nobody", "none") and rows[7] == ("ole", "fitter") and len(rows) == 6


def test_filters_and_facts(people):
    assert G.filter_vertices(people, F.col("position") == "fitter").count() == 1
    assert G.filter_edges(people, F.col("src") > F.col("dst")).count() == 2
    facts = {r.fact for r in G.facts(people).collect()}
    assert "ida is the helper of ole" in facts and "nobody is the pupil of nobody" in facts and len(facts) == 5


def test_subgraph_keeps_edges_with_both_ends(people):
    part = G.subgraph(people, F.col("position") != "master")
    assert {(r.src, r.dst) for r in part.edges.collect()} == {(3, 7), (4, 0)}


@pytest.fixture
def followers(spark, folder):
    with open(folder + "/followers.txt", "w") as out:
        out.write("# src dst\n" + "".join(f"{a} {b}\n" for a, b in LINKS) + "\n")
    return G.graph_from_edges(read_edge_list(spark, folder + "/followers.txt"))


def test_pagerank_reaches_the_fixed_point(followers):
    ranks = {r.id: r.rank for r in G.pagerank(followers, tol=1e-7).collect()}
    assert ranks.keys() == FIXED_POINT.keys()
    for vertex, rank in FIXED_POINT.items():
        assert ranks[vertex] == pytest.approx(rank, abs=1e-5)


def test_a_bound_on_rounds_fails_when_reached(followers):
    with pytest.raises(RuntimeError, match="not converged"):
        G.pagerank(followers, tol=1e-7, max_iter=2)
    assert G.pagerank(followers, tol=1e-7, rounds=2).count() == len(FIXED_POINT)


def test_hub_is_split_and_ranks_agree(followers, monkeypatch):
    monkeypatch.setattr(G, "ADJACENCY_ROW", 1)
    ranks = {r.id: r.rank for r in G.pagerank(followers, tol=1e-4).collect()}
    for vertex, rank in FIXED_POINT.items():
        assert ranks[vertex] == pytest.approx(rank, abs=2e-3)


def test_parallel_edges_count_and_dangling_rank_is_lost(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "src long, dst long")
    ranks = {r.id: r.rank for r in G.pagerank(G.graph_from_edges(edges), tol=1e-9).collect()}
    assert ranks[1] == pytest.approx(0.15)
    assert ranks[2] == pytest.approx(0.15 + 0.85 * 0.15 * 2 / 3)
    assert ranks[3] == pytest.approx(0.15 + 0.85 * 0.15 / 3)


def test_top_pagerank_of_users_with_two_attributes(spark, folder, followers):
    with open(folder + "/users.txt", "w") as out:
        out.write(MEMBERS)
    users = read_vertex_attrs(spark, folder + "/users.txt")
    assert {r.id: len(r.attrs) for r in users.collect()}[11] == 1
    top = G.top_pagerank(followers, users, F.size("attrs") == 2, n=5).collect()
    assert [r.id for r in top] == sorted(FIXED_POINT, key=lambda v: (-FIXED_POINT[v], v))[:5]
    assert [list(r.attrs)[0] for r in top][:2] == [{2: "ash", 3: "elm", 4: "oak", 5: "fir", 9: "box"}[r.id] for r in top[:2]]


def test_join_vertices_defaults(spark):
    vertices = spark.createDataFrame([(1,), (2,)], "id long")
    attrs = spark.createDataFrame([(1, ["a"])], "id long, attrs array<string>")
    rows = G.join_vertices(vertices, attrs, {"attrs": F.array().cast("array<string>")}).collect()
    assert {r.id: r.attrs for r in rows} == {1: ["a"], 2: []}


def test_read_vectors(spark, folder):
    with open(folder + "/v.csv", "w") as out:
        out.write("Channel,Region\n2, 3,,12669\n1,0.5,\n")
    rows = read_vectors(spark, folder + "/v.csv", "Channel").collect()
    assert [list(r.vector) for r in rows] == [[2.0, 3.0, 12669.0], [1.0, 0.5]]


def test_hub_edges_are_spread(spark):
    """A vertex with nine tenths of the edges: no task has more than its share of the triplets."""
    n, parts = 20_000, 8
    edges = spark.range(n).select(F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id")).alias("src"), (F.col("id") + 1).alias("dst"), F.col("id").alias("w"))
    vertices = spark.range(n + 1).select("id", F.concat(F.lit("v"), F.col("id")).alias("name"))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        graph = G.Graph(vertices, edges)
        found = G.triplets(graph)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2 * n / parts
        assert found.filter("src_name <> concat('v', src) OR dst_name <> concat('v', dst)").isEmpty()
        part = G.subgraph(graph, F.col("id") % 2 == 0).edges
        assert sorted(map(tuple, part.collect())) == sorted(tuple(r) for r in edges.filter("src % 2 = 0 AND dst % 2 = 0").collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_parallel_edges_of_a_hub_are_counted_before_they_move(spark, monkeypatch):
    """only hubs' parallel edges are counted; ranks are those of the definition."""
    monkeypatch.setattr(G, "ADJACENCY_ROW", 3)
    links = [(1, 2)] * 40 + [(1, i) for i in range(3, 9)] + [(2, 1), (2, 1), (3, 1)]
    edges = spark.createDataFrame(links, "src long, dst long")
    rows, degrees = G._out_edges(edges)
    assert sum(len(r.neighbours) for r in rows.where("src = 1").collect()) == 7
    assert {r.src: r.degree for r in degrees.collect()} == {1: 46, 2: 2, 3: 1}
    want = plain_ranks(links)
    got = {r.id: r.rank for r in G.pagerank(G.graph_from_edges(edges), tol=1e-9).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-6) for v in want)


def test_the_ranked_subgraph_is_joined_once(spark, monkeypatch):
    """F8: the ranking reads the subgraph several times, so it reads what was written."""
    seen = []
    ranking = G.pagerank
    monkeypatch.setattr(G, "pagerank", lambda graph, **options: seen.append(graph) or ranking(graph, **options))
    graph = G.graph_from_edges(spark.createDataFrame(LINKS, "src long, dst long"))
    attrs = spark.createDataFrame([(i, ["a"]) for i in (2, 3, 4, 5, 9)], "id long, attrs array<string>")
    top = G.top_pagerank(graph, attrs, F.size("attrs") == 1, n=1)
    plans = [frame._jdf.queryExecution().optimizedPlan().toString() for frame in (seen[0].vertices, seen[0].edges)]
    assert not any("Join" in plan or "Aggregate" in plan for plan in plans)
    kept = plain_ranks([link for link in LINKS if 8 not in link])
    assert [r.id for r in top.collect()] == sorted(kept, key=lambda v: (-kept[v], v))[:1]
