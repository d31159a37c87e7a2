import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retinue.functions.arrays import concat_features, reshape_rows, squared_distance
from retinue.functions.vectors import to_matrix, nearest_row, smallest_per_row, squared_distances
from retinue.operators import codebook as C
from retinue.operators import similarity as S


def vectors(spark, rows, prefix):
    data = [(f"{prefix}{i}", [int(v) for v in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "image_name string, histogram array<int>")


def brute_force(queries, gallery, k):
    d = ((queries[:, None].astype(np.int64) - gallery[None]) ** 2).sum(axis=2)
    out = set()
    for i, row in enumerate(d):
        best = sorted((int(v), f"g{j}") for j, v in enumerate(row))[:k]
        out |= {(f"q{i}", n + 1, name, value) for n, (value, name) in enumerate(best)}
    return out


FORMS = [{}, {"broadcast_queries": 0, "tile_rows": 16}, {"broadcast_queries": 0}]


@pytest.mark.parametrize("options", FORMS)
def test_top_k_is_exact_with_a_third_of_copies(spark, options):
    rng = np.random.default_rng(3)
    gallery, queries = rng.poisson(2, (300, 6)), rng.poisson(2, (90, 6))
    gallery[:100], queries[:30] = gallery[0], queries[0]
    found = S.top_k_similar(vectors(spark, queries, "q"), vectors(spark, gallery, "g"), 10, **options)
    assert {tuple(r) for r in found.collect()} == brute_force(queries, gallery, 10)


@pytest.mark.parametrize("options", FORMS)
def test_gallery_smaller_than_k(spark, options):
    rows = np.array([[1, 0], [0, 3], [5, 5]])
    found = S.top_k_similar(vectors(spark, rows, "q"), vectors(spark, rows, "g"), 10, **options).collect()
    assert len(found) == 9 and {tuple(r) for r in found} == brute_force(rows, rows, 10)


@pytest.mark.parametrize("options", FORMS)
def test_distance_beyond_32_bits(spark, options):
    far = np.array([[60_000, 0], [0, 0]])
    found = S.nearest(vectors(spark, far[:1], "q"), vectors(spark, far[1:], "g"), **options).first()
    assert found.distance == 3_600_000_000
    huge = np.array([[1_000_000_000, 7], [-1_000_000_000, 5]])
    assert squared_distances(huge[:1].astype(float), huge[1:].astype(float))[0, 0] == 4 * 10**18 + 4


@pytest.mark.parametrize("options", FORMS)
def test_all_matches_within_a_radius(spark, options):
    rng = np.random.default_rng(4)
    gallery, queries = rng.poisson(2, (200, 5)), rng.poisson(2, (40, 5))
    gallery[:70] = gallery[0]
    g = vectors(spark, gallery, "g")
    found = S.all_matches(vectors(spark, queries, "q"), g, 12, **options)
    members = found.join(S.copies_of(g), "match").select("query", "distance", "image")
    d = ((queries[:, None] - gallery[None]) ** 2).sum(axis=2)
    want = {(f"q{i}", int(d[i, j]), f"g{j}") for i, j in zip(*np.nonzero(d <= 12))}
    assert {tuple(r) for r in members.collect()} == want
    assert found.agg(F.sum("copies")).first()[0] == len(want)


@pytest.mark.parametrize("options", FORMS)
def test_empty_sides(spark, options):
    some, none = vectors(spark, np.array([[1, 2]]), "q"), vectors(spark, np.zeros((0, 2)), "g")
    assert S.top_k_similar(some, none, 3, **options).count() == 0
    assert S.top_k_similar(none, some, 3, **options).count() == 0


def test_a_prepared_gallery_serves_several_searches(spark):
    rng = np.random.default_rng(6)
    gallery, queries = rng.poisson(2, (120, 4)), rng.poisson(2, (30, 4))
    prepared = S.Gallery(vectors(spark, gallery, "g"), 5)
    for options in FORMS:
        for k in (5, 2):
            found = S.top_k_similar(vectors(spark, queries, "q"), prepared, k, **options)
            assert {tuple(r) for r in found.collect()} == brute_force(queries, gallery, k)
    with pytest.raises(ValueError):
        S.top_k_similar(vectors(spark, queries, "q"), prepared, 6)


def test_float_vectors(spark):
    rng = np.random.default_rng(7)
    gallery, queries = rng.normal(size=(80, 3)), rng.normal(size=(20, 3))

    def frame(rows, prefix):
        data = [(f"{prefix}{i}", row.tolist()) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, "image_name string, histogram array<double>")

    d = ((queries[:, None] - gallery[None]) ** 2).sum(axis=2)
    want = {f"q{i}": [f"g{j}" for j in np.argsort(row)[:4]] for i, row in enumerate(d)}
    for options in FORMS:
        got = {}
        for r in S.top_k_similar(frame(queries, "q"), frame(gallery, "g"), 4, **options).orderBy("rank").collect():
            got.setdefault(r.query, []).append(r.match)
        assert got == want


def test_pairwise_distance(spark):
    rows = vectors(spark, np.array([[1, 2], [4, 6]]), "g")
    pairs = spark.createDataFrame([("g0", "g1"), ("g1", "g0"), ("g0", "g0")], "query string, match string")
    found = {(r.query, r.match): r.distance for r in S.pairwise_distance(pairs, rows, rows).collect()}
    assert found == {("g0", "g1"): 25, ("g1", "g0"): 25, ("g0", "g0"): 0}


def test_squared_distance_is_64_bit(spark):
    row = spark.range(1).select(
        squared_distance(F.array(F.lit(60_000)), F.array(F.lit(-60_000))).alias("d")
    ).first()
    assert row.d == 120_000**2


def test_wide_and_back(spark):
    matches = spark.createDataFrame(
        [("q", 1, "a#b.png", 0), ("q", 2, "c", 7), ("r", 1, "d", 3)], "query string, rank int, match string, distance long"
    )
    wide = S.matches_wide(matches, 3)
    assert wide.columns == ["query", "image_1", "image_2", "image_3"]
    assert sorted(map(tuple, S.matches_long(wide, 3).collect())) == sorted(map(tuple, matches.collect()))


def test_expanded_match_of_a_missing_image_keeps_its_row(spark):
    matches = spark.createDataFrame([("q", 1, "gone", 5)], "query string, rank int, match string, distance long")
    images = spark.createDataFrame([("q", bytearray(b"x"))], "image_name string, content binary")
    rows = {r.rank: r for r in S.expand_matches(S.matches_wide(matches, 2), images, 2).collect()}
    assert rows[0].match == "q" and bytes(rows[0].content) == b"x"
    assert rows[1].match == "gone" and rows[1].content is None


def test_reshape_drops_a_remainder(spark):
    df = spark.createDataFrame([(list(map(float, range(7))),), ([1.0],), (None,)], "a array<double>")
    got = [r[0] for r in df.select(reshape_rows(F.col("a"), 3)).collect()]
    assert got == [[[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]], [], None]


def test_concat_features(spark):
    df = spark.createDataFrame(
        [([[1.0]], [[2.0]]), (None, [[2.0]]), (None, None)], "s array<array<double>>, h array<array<double>>"
    )
    got = [r[0] for r in df.select(concat_features(F.col("s"), F.col("h"))).collect()]
    assert got == [[[1.0], [2.0]], [[2.0]], None]


# -- codebook --------------------------------------------------------------------


def test_training_separates_two_groups_and_reloads(spark, folder):
    points = [(0.0,) * 3, (0.1,) * 3, (0.2,) * 3, (9.0,) * 3, (9.1,) * 3, (9.2,) * 3]
    df = spark.createDataFrame([(list(p),) for p in points], "descriptor array<double>")
    C.save_codebook(C.train_codebook(df, 2), folder + "/m")
    centers = C.centers_table(spark, C.load_codebook(folder + "/m"))
    got = sorted(round(r.center[0], 6) for r in centers.collect())
    assert got == [0.1, 9.1]
    sizes = C.assign(df, centers).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [3, 3]


def test_fewer_centres_than_asked_for(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([5.0, 5.0],)] * 3, "descriptor array<double>")
    centers = C.centers_table(spark, C.train_codebook(df, 7, runs=1))
    n = centers.count()
    assert n == 2
    images = spark.createDataFrame([("a", [[1.0, 1.0], [5.0, 5.0], [5.0, 5.0]])], "image_name string, f array<array<float>>")
    assert sorted(C.quantise(images, centers, "f").first().histogram) == [1, 2]


def test_cluster_table_and_held_out_rows(spark):
    rows = spark.createDataFrame([(float(i % 2) * 50, float(i)) for i in range(10)], "a double, b double")
    model, found = C.cluster_table(rows, ["a", "b"], 2)
    assert len(model.clusterCenters()) == 2 and found.columns == ["a", "b", "cluster"]
    centers = C.centers_table(spark, model)
    held_out = spark.createDataFrame([([50.0, 5.0],), ([0.0, 4.0],)], "descriptor array<double>")
    assert len({r.cluster for r in C.assign(held_out, centers).collect()}) == 2


def images_and_centers(spark, n_centers=9):
    rng = np.random.default_rng(5)
    images = [(f"i{n}", rng.integers(0, 50, (n % 4, 4)).astype(float).tolist()) for n in range(12)] + [("none", None)]
    df = spark.createDataFrame(images, "image_name string, f array<array<float>>")
    centers = rng.integers(0, 50, (n_centers, 4)).astype(float)
    centers[5] = centers[2]  # a tie: the lower id wins
    table = spark.createDataFrame(list(enumerate(centers.tolist())), "center_id int, center array<double>")
    want = {}
    for name, points in images:
        h = [0] * n_centers
        for p in points or []:
            h[int(((centers - p) ** 2).sum(axis=1).argmin())] += 1
        want[name] = h
    return df, table, want


@pytest.mark.parametrize("max_bytes", [C.MAX_CENTER_BYTES, 2 * 8 * 4])
def test_histograms_by_row_and_by_group(spark, max_bytes):
    """One piece of the codebook, or many."""
    df, centers, want = images_and_centers(spark)
    filled = {name: h for name, h in want.items() if sum(h)}
    by_row = C.quantise(df, centers, "f", max_bytes=max_bytes).collect()
    assert {r.image_name: list(r.histogram) for r in by_row} == filled
    zero = C.quantise(df, centers, "f", empty="zero", max_bytes=max_bytes).collect()
    assert {r.image_name: list(r.histogram) for r in zero} == want
    rows = C.assign(C.explode_descriptors(df, "f"), centers, max_bytes=max_bytes)
    by_group = C.histogram(rows, 9).collect()
    assert {r.image_name: list(r.histogram) for r in by_group} == filled


def test_a_codebook_too_large_to_share_is_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_SHARED_BYTES", 8)
    df, centers, want = images_and_centers(spark)
    rows = C.explode_descriptors(df, "f")
    by_group = C.histogram(C.assign(rows, centers, row_key=["image_name", "pos"]), 9).collect()
    assert {r.image_name: list(r.histogram) for r in by_group} == {n: h for n, h in want.items() if sum(h)}
    numbered = C.assign(rows, centers)
    monkeypatch.undo()
    assert sorted(map(str, numbered.collect())) == sorted(map(str, C.assign(rows, centers).collect()))


@pytest.mark.parametrize("empty", ["drop", "zero"])
def test_quantise_is_the_same_at_every_codebook_size(spark, monkeypatch, empty):
    df, centers, _ = images_and_centers(spark)
    shared = C.quantise(df, centers, "f", empty=empty)
    monkeypatch.setattr(C, "MAX_SHARED_BYTES", 8)
    joined = C.quantise(df, centers, "f", empty=empty)
    assert joined.columns == shared.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, shared.collect()))


def test_cluster_table_keeps_incomplete_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 2 * 10), 1.0) for i in range(7)] + [(7, None, 1.0)], "id int, a double, b double")
    _, clustered = C.cluster_table(rows, ["a", "b"], 2, runs=1)
    found = {r.id: r.cluster for r in clustered.collect()}
    assert len(found) == 8 and found[7] is None and None not in [found[i] for i in range(7)]


def test_histogram_sums_to_descriptors(spark):
    df, centers, _ = images_and_centers(spark)
    for row in C.quantise(df, centers, "f").collect():
        assert sum(row.histogram) == len(row.f)


# -- kernels ---------------------------------------------------------------------------


@given(st.integers(1, 30), st.integers(1, 20), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_kernels_against_direct_sums(n, m, k, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, (n, 3)).astype(float), rng.integers(0, 4, (m, 3)).astype(float)
    direct = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    d = squared_distances(a, b)
    assert (d == direct).all()
    rows, cols = smallest_per_row(d, k)
    want = [(i, j) for i in range(n) for j in sorted(range(m), key=lambda j: (direct[i, j], j))[:k]]
    assert list(zip(rows, cols)) == want
    index, distance = nearest_row(a, b)
    assert (index == direct.argmin(axis=1)).all() and (distance == direct.min(axis=1)).all()


def test_nearest_row_settles_close_runners_up():
    """Distances that the matrix product alone would round to the wrong order."""
    base = 1e6
    points = np.array([[base, base]])
    centers = np.array([[base + 2e-3, base], [base + 1e-3, base]])
    assert nearest_row(points, centers)[0][0] == 1


def test_float_vectors_far_from_zero_keep_their_order(spark):
    """The nearer of two rows that an expanded square tells apart no more."""
    gallery = spark.createDataFrame([("a", [1e6 + 2e-3, 1e6]), ("b", [1e6, 1e6])], "image_name string, histogram array<double>")
    queries = spark.createDataFrame([("q", [1e6, 1e6])], "image_name string, histogram array<double>")
    for options in FORMS:
        found = S.top_k_similar(queries, gallery, 2, **options).orderBy("rank").collect()
        assert [r.match for r in found] == ["b", "a"] and found[0].distance == 0.0 and found[1].distance > 0


def test_ragged_vectors_are_refused():
    with pytest.raises(ValueError, match="different lengths"):
        to_matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0]]))


@pytest.mark.parametrize("broadcast", [4096, 0])
def test_added_images_are_found_like_those_of_one_gallery(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "MOST_ADDITIONS", 2)
    rng = np.random.default_rng(8)
    rows = [(f"i{n:03}", rng.integers(0, 6, 5).tolist()) for n in range(240)]
    schema = "image_name string, histogram array<int>"
    frame = spark.createDataFrame(rows, schema)
    queries = frame.limit(60)
    gallery = S.Gallery(frame.filter("image_name < 'i100'"), 4)

    def same(known):
        found = S.top_k_similar(queries, gallery, 4, broadcast_queries=broadcast, tile_rows=16)
        want = S.top_k_similar(queries, known, 4)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))

    same(frame.filter("image_name < 'i100'"))
    for low, high in (("i100", "i150"), ("i140", "i200"), ("i200", "i240"), ("i150", "i240")):
        gallery = gallery.added(frame.filter(f"image_name >= '{low}' AND image_name < '{high}'"))
        same(frame.filter(f"image_name < '{max(high, 'i200') if low == 'i150' else high}'"))
    # A name that is there with another vector takes the new one.
    changed = spark.createDataFrame([("i003", [9, 9, 9, 9, 9]), ("new", [0, 0, 0, 0, 0])], schema)
    gallery = gallery.added(changed)
    same(frame.filter("image_name <> 'i003'").union(changed))


def test_routing_needs_no_matrix_of_all_pivots(monkeypatch):
    """Twenty thousand pivots and a small block of queries: distances between the pivots of the block and all, no more."""
    asked = []
    real = S.squared_distances

    def counting(a, b):
        asked.append(len(a) * len(b))
        return real(a, b)

    monkeypatch.setattr(S, "squared_distances", counting)
    rng = np.random.default_rng(3)
    pivots = rng.random((20_000, 4))
    cells = {"cell": list(range(20_000)), "n": [1] * 20_000, "low": [0.0] * 20_000, "high": [0.01] * 20_000}

    class Plan:
        value = pivots, cells

    batch = pa.RecordBatch.from_pydict({"query": ["a", "b"], "vector": rng.random((2, 4)).tolist(), "bound": [1e-4, 1e-4]})
    list(S._other_cells(Plan, True)([batch]))
    assert max(asked) <= 2 * 20_000


def test_routing_holds_one_bound_of_cells_in_all():
    """the tables of a block of queries together, not each of them, stay within the bound."""
    rng = np.random.default_rng(3)
    pivots, queries = rng.normal(size=(800, 8)), rng.normal(size=(6000, 8))
    cells = {"cell": list(range(800)), "n": [9] * 800, "low": [0.0] * 800, "high": [2.0] * 800}
    plan = type("Plan", (), {"value": (pivots, cells)})
    columns = [pa.array(range(len(queries))), pa.array(list(queries)), pa.array(np.full(len(queries), 0.5))]
    batch = pa.RecordBatch.from_arrays(columns, ["query", "vector", "bound"])
    tracemalloc.start()
    try:
        found = {(q, c) for part in S._other_cells(plan, False)([batch]) for q, c in zip(part.column("query").to_pylist(), part.column("cell").to_pylist())}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    home = ((queries[:50, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert {(q, int(c)) for q, c in enumerate(home)} <= found
    assert peak < 150e6
