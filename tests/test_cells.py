import pytest
from pyspark.sql import functions as F

from retinue.sinks import cells as cell_sink
from retinue.sinks.cells import CellTable, upsert_cells
from retinue.sources import tables as T

GROUPS = {"content": "path string, content binary", "histogram": "histogram array<int>"}


@pytest.fixture(params=[cell_sink.BROADCAST_BYTES, 0], ids=["few", "many"])
def updates(request, monkeypatch):
    """Both physical forms of the upsert."""
    monkeypatch.setattr(cell_sink, "BROADCAST_BYTES", request.param)


def test_upsert_overwrites_supplied_cells_only(spark, updates):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, s string")
    news = spark.createDataFrame([("a", None, "y"), ("c", 5, None), ("d", None, None)], "k string, n int, s string")
    once = upsert_cells(base, news, "k")
    want = [("a", 1, "y"), ("b", 2, None), ("c", 5, None)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, upsert_cells(once, news, "k").collect())) == want


def test_upsert_of_several_updates_takes_the_last_of_each_cell(spark, updates):
    base = spark.createDataFrame([("a", 1, "x")], "k string, n int, s string")
    news = spark.createDataFrame(
        [("a", 1, 7, None), ("a", 3, None, "z"), ("a", 2, 8, "y")], "k string, at int, n int, s string"
    )
    assert [tuple(r) for r in upsert_cells(base, news, "k", order="at").collect()] == [("a", 8, "z")]


def test_upsert_adds_a_new_column(spark, updates):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    news = spark.createDataFrame([("b", 9.0)], "k string, score double")
    assert sorted(map(tuple, upsert_cells(base, news, "k").collect())) == [("a", 1, None), ("b", 2, 9.0)]


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "image_name string, path string, histogram array<int>")


def test_cell_table_put_scan_compact(spark, folder):
    store = CellTable(spark, folder + "/t", GROUPS)
    assert store.scan().count() == 0
    store.put(cells(spark, ("a", "/a", None), ("b", "/b", [1, 2]), ("empty", None, None)))
    store.put(cells(spark, ("a", None, [3, 4]), ("b", "/b2", None)))

    def content():
        return {r.image_name: (r.path, r.histogram) for r in store.scan(["path", "histogram"]).collect()}

    want = {"a": ("/a", [3, 4]), "b": ("/b2", [1, 2])}
    assert content() == want
    store.compact()
    assert content() == want
    assert [p.base for p in store.manifest().parts if p.group == "content"] == [True]
    assert [r.image_name for r in store.scan(["content"]).collect()] == []
    store.put(cells(spark, ("c", None, [9])))
    assert content() == {**want, "c": (None, [9])}


def test_consecutive_puts_around_a_compaction_lose_nothing(spark, folder):
    store = CellTable(spark, folder + "/t", GROUPS)
    want = {}
    for n in range(8):
        store.put(cells(spark, (f"k{n}", f"/{n}", None), ("all", f"/{n}", None)), put_id=n)
        want |= {f"k{n}": f"/{n}", "all": f"/{n}"}
        if n in (2, 3, 6):
            store.compact()
        assert {r.image_name: r.path for r in store.scan(["path"]).collect()} == want
    # A replayed write, one of an older clock, and a part of a failed write change nothing that is newer.
    store.put(cells(spark, ("k6", "/6", None), ("all", "/6", None)), put_id=6)
    store.put(cells(spark, ("late", "/l", None), ("all", "/old", None)), put_id=-5)
    cells(spark, ("ghost", "/g", None)).write.parquet(f"{folder}/t/data/content/base-99-x")
    want["late"] = "/l"
    assert {r.image_name: r.path for r in store.scan(["path"]).collect()} == want
    assert sum(p.base for p in store.manifest().parts if p.group == "content") == 1
    assert store.remove_unused() == 0 and store.remove_unused(0) == 1
    assert {r.image_name: r.path for r in store.scan(["path"]).collect()} == want


def test_a_put_computes_its_input_once(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    store = CellTable(spark, folder + "/t", GROUPS)
    store.put(cells(spark, *((f"k{i}", "/p", [1]) for i in range(20))).withColumn("path", counted("path")))
    assert seen.value == 20 and store.scan(["path", "histogram"]).count() == 20


def test_repeated_put_changes_nothing(spark, folder):
    store = CellTable(spark, folder + "/t", GROUPS)
    rows = cells(spark, ("a", "/a", [1]))
    for put_id in (7, 7, None):
        store.put(rows, put_id=put_id)
    assert [(r.image_name, r.path, r.histogram) for r in store.scan(["path", "histogram"]).collect()] == [("a", "/a", [1])]


def test_scan_reads_only_the_asked_group(spark, folder):
    store = CellTable(spark, folder + "/t", GROUPS)
    store.put(cells(spark, ("a", "/a", [1])))
    files = store.scan(["histogram"]).inputFiles()
    assert files and all("/histogram/" in name for name in files)


def test_scan_cells_leaves_out_rows_without_any(spark):
    df = cells(spark, ("a", None, None), ("b", "/b", None), ("c", None, [1]))
    assert sorted(r.image_name for r in T.scan_cells(df, ["path", "histogram"]).collect()) == ["b", "c"]
    assert [r.image_name for r in T.scan_cells(df, ["path"]).collect()] == ["b"]
    assert [r.image_name for r in T.drop_missing(df, ["histogram"]).collect()] == ["c"]


@pytest.mark.parametrize("bound", [T.BROADCAST_KEYS, 1])
def test_multi_get_of_a_missing_key(spark, monkeypatch, bound):
    monkeypatch.setattr(T, "BROADCAST_KEYS", bound)
    df = cells(spark, ("a", "/a", None), ("b", "/b", None))
    keys = spark.createDataFrame([("a",), ("zz",), ("a",)], "image_name string")
    assert sorted((r.image_name, r.path) for r in T.multi_get(df, keys).collect()) == [("a", "/a"), ("zz", None)]


def test_point_lookup_is_pushed_down(spark, folder):
    cells(spark, ("a", "/a", None)).write.parquet(folder + "/p")
    found = T.get_row(spark.read.parquet(folder + "/p"), "a")
    assert "EqualTo(image_name,a)" in found._jdf.queryExecution().toString() and found.count() == 1


def test_sql_over_a_view(spark):
    info = spark.createDataFrame([(1, "n", "30")], "id int, name string, age string")
    assert T.sql_query(spark, "select * from info", info=info).collect() == info.collect()


def test_table_life(spark, folder):
    name = "life_of_a_table"
    T.drop_table(spark, name)
    assert not T.table_exists(spark, name)
    for _ in range(2):
        T.ensure_table(spark, name, "k string, v int", folder + "/life")
    assert T.table_exists(spark, name) and spark.table(name).count() == 0
    T.drop_table(spark, name)
    assert not T.table_exists(spark, name)


def rows_read(df):
    """The rows of a frame, and how many rows its file scans gave out."""
    rows = df.collect()

    def read(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return read(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return read(node.plan())
        if name == "FileSourceScanExec":
            return node.metrics().apply("numOutputRows").value()
        return sum(read(node.children().apply(n)) for n in range(node.children().size()))

    return rows, read(df._jdf.queryExecution().executedPlan())


def big(spark, n, seed=0):
    name = F.concat(F.lit("k"), F.col("id")).alias("image_name")
    content = F.encode(F.repeat(F.lit("x"), 50), "UTF-8").alias("content")
    return spark.range(n).select(name, F.lit("/p").alias("path"), content, F.array(F.col("id").cast("int") + seed).alias("histogram"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_reads_a_small_share_of_the_rows(spark, folder):
    store = CellTable(spark, folder + "/t", GROUPS, buckets=16)
    store.put(big(spark, 8000))
    stored = 2 * 8000  # both groups
    rows, read = rows_read(store.get("k77", ["histogram"]))
    assert [(r.image_name, r.histogram) for r in rows] == [("k77", [77])] and 0 < read <= 2 * 8000 / 16
    rows, read = rows_read(store.get("k123", ["path", "histogram"]))
    assert rows[0].path == "/p" and rows[0].histogram == [123] and read <= 2 * stored / 16
    # A key within the range of the stored ones that is not there: its bloom filter says so.
    rows, read = rows_read(store.get("k5555x", ["histogram"]))
    assert rows == [] and read == 0
    store.put(big(spark, 200, seed=5))
    assert [r.histogram for r in store.get("k77", ["histogram"]).collect()] == [[82]]
    assert store.get("k7").collect()[0].path == "/p" and CellTable(spark, folder + "/none", GROUPS).get("k7").collect() == []


@pytest.mark.parametrize("puts", [1, 3])
def test_scans_of_several_groups_move_no_cells(spark, folder, puts):
    groups = {**GROUPS, "label": "label string"}
    store = CellTable(spark, folder + "/t", groups, buckets=8)
    for n in range(puts):
        store.put(big(spark, 500 + n, seed=n).withColumn("label", F.lit("x")))
    two, three = store.scan(["content", "histogram"]), store.scan()
    assert two.count() == three.count() == 500 + puts - 1
    assert "Exchange" not in plan_of(store.scan(["content", "histogram"]))
    moved = [line for line in plan_of(store.scan()).splitlines() if "Exchange" in line]
    assert all("content" not in line and "histogram" not in line for line in moved)
    store.compact()
    assert "Exchange" not in plan_of(store.scan(["content", "histogram"])) and store.scan().count() == 500 + puts - 1


def test_a_write_counts_in_all_groups_or_none(spark, folder, monkeypatch):
    store = CellTable(spark, folder + "/t", GROUPS)
    store.put(cells(spark, ("a", "/a", [1])), put_id=1)
    write = CellTable._write

    def fail(self, rows, group, *args, **kwargs):
        if group == "histogram":
            raise OSError("disk lost")
        return write(self, rows, group, *args, **kwargs)

    monkeypatch.setattr(CellTable, "_write", fail)
    with pytest.raises(OSError):
        store.put(cells(spark, ("a", "/new", [2]), ("b", "/b", [3])), put_id=2)
    monkeypatch.undo()
    assert [(r.image_name, r.path, r.histogram) for r in store.scan(["path", "histogram"]).collect()] == [("a", "/a", [1])]
    # The write is done again after the failure, and once more by a replay.
    for _ in range(2):
        store.put(cells(spark, ("a", "/new", [2]), ("b", "/b", [3])), put_id=2)
    assert sorted((r.image_name, r.path, r.histogram) for r in store.scan(["path", "histogram"]).collect()) == [("a", "/new", [2]), ("b", "/b", [3])]


def test_readers_keep_their_state(spark, folder):
    store = CellTable(spark, folder + "/t", GROUPS)
    store.put(cells(spark, ("a", "/a", None)), put_id=1)
    store.put(cells(spark, ("b", "/b", None)), put_id=2)
    before, state = store.scan(["path"]), store.manifest()
    store.put(cells(spark, ("a", "/later", None)), put_id=3)
    store.compact()
    assert {r.image_name: r.path for r in before.collect()} == {"a": "/a", "b": "/b"}
    assert {r.image_name: r.path for r in store.scan(["path"], state.parts).collect()} == {"a": "/a", "b": "/b"}
    assert {r.image_name: r.path for r in store.scan(["path"]).collect()} == {"a": "/later", "b": "/b"}


def test_second_writer_rebases_or_fails(spark, folder, monkeypatch):
    store, other = (CellTable(spark, folder + "/t", GROUPS) for _ in range(2))
    store.put(cells(spark, ("a", "/a", None)), put_id=1)
    store.put(cells(spark, ("b", "/b", None)), put_id=2)
    write = CellTable._write

    def during(action):
        """Let another writer act while this one writes its base."""

        def run(self, rows, group, put, base, moved=False):
            part = write(self, rows, group, put, base, moved)
            if base:
                monkeypatch.setattr(CellTable, "_write", write)
                action()
            return part

        monkeypatch.setattr(CellTable, "_write", run)

    during(lambda: other.put(cells(spark, ("c", "/c", None)), put_id=3))
    store.compact()
    assert {r.image_name: r.path for r in store.scan(["path"]).collect()} == {"a": "/a", "b": "/b", "c": "/c"}
    assert sorted((p.put, p.base) for p in store.manifest().parts if p.group == "content") == [(2, True), (3, False)]

    during(lambda: other.put(cells(spark, ("c", "/c2", None)), put_id=3))
    with pytest.raises(cell_sink.ConcurrentChange):
        store.compact()
    assert {r.image_name: r.path for r in store.scan(["path"]).collect()} == {"a": "/a", "b": "/b", "c": "/c2"}

    # Two writers that meet at one number: both writes stay.
    create, seen = cell_sink._create_text, []

    def meet(session, path, text):
        if "_commits" in path and not seen:
            seen.append(path)
            monkeypatch.setattr(cell_sink, "_create_text", create)
            other.put(cells(spark, ("d", "/d", None)), put_id=4)
        return create(session, path, text)

    monkeypatch.setattr(cell_sink, "_create_text", meet)
    store.put(cells(spark, ("e", "/e", None)), put_id=5)
    assert {"d", "e"} <= {r.image_name for r in store.scan(["path"]).collect()}


def test_descriptor(spark, folder):
    root = folder + "/t"
    assert not CellTable.exists(spark, root)
    CellTable.drop(spark, root)
    store = CellTable(spark, root, {"a": "x int, y map<string,array<double>>", "b": "z struct<p:int,q:string>"}, key="id", buckets=4)
    store.put(spark.createDataFrame([("k", 1)], "id string, x int"))
    again = CellTable.open(spark, root)
    assert again.schemas == store.schemas and (again.key, again.buckets) == ("id", 4)
    assert [(r.id, r.x) for r in again.scan(["x"]).collect()] == [("k", 1)]
    for groups, key in (({"a": "x int"}, "id"), ({"a": "x int, y map<string,array<double>>", "b": "z struct<p:int,q:string>"}, "k")):
        with pytest.raises(ValueError):
            CellTable(spark, root, groups, key)
    CellTable.drop(spark, root)
    assert not CellTable.exists(spark, root)
    with pytest.raises(FileNotFoundError):
        CellTable.open(spark, root)
