import numpy as np
import pytest
from pyspark.sql import functions as F

from retinue.operators import codebook as C
from retinue.operators import features as X
from retinue.operators.similarity import top_k_similar
from retinue.plans import streams as plans
from retinue.plans.derived import decode_raw, encode_raw
from retinue.sinks.cells import CellTable
from retinue.sources import streams
from retinue.streaming import batches, counters, matching
from tests.test_images import bright_cells, picture

LINE = 'ip{} - - [d z] "GET / H" 200 1 "page{}" "agent"'


def publish(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_counts_are_per_batch_and_counters_run_on(spark, folder):
    source, schema = folder + "/words", "value string"
    publish(spark, source, [("a b a",)], schema)
    publish(spark, source, [("a",)], schema)
    lines = streams.file_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    batches.word_count_stream(lines, folder + "/out", folder + "/c1", available_now=True).awaitTermination()
    got = spark.read.parquet(folder + "/out").collect()
    assert sorted((r.batch, r.word, r.cnt) for r in got) == [(0, "a", 2), (0, "b", 1), (1, "a", 1)]

    words = lines.select(F.explode(F.split("value", " ")).alias("key"))
    table = CellTable(spark, folder + "/counters", {"count": "value long"}, "key")

    def run():
        counters.running_counter_stream(words, table, folder + "/c2", available_now=True).awaitTermination()
        return {r.key: r.value for r in table.scan().collect()}

    assert run() == {"a": 3, "b": 1}
    publish(spark, source, [("b c",)], schema)
    assert run() == {"a": 3, "b": 2, "c": 1}


def test_log_stream_text_and_rejects(spark, folder):
    source = folder + "/lines"
    publish(spark, source, [(LINE.format(1, 1),), (LINE.format(1, 2),), ("short",)], "value string")
    lines = streams.file_stream(spark, source, spark.read.parquet(source).schema)
    batches.log_text_stream(lines, folder + "/text", folder + "/c", available_now=True).awaitTermination()
    pages = [r.value for r in spark.read.text(folder + "/text/pageCounts-0").collect()]
    assert sorted(pages) == ['(1,"page1")', '(1,"page2")']
    assert [r.value for r in spark.read.text(folder + "/text/ipCounts-0").collect()] == ["(2,ip1)"]
    assert [r.value for r in spark.read.text(folder + "/text/agentCounts-0").collect()] == ['("agent",2)']


def test_a_replayed_batch_replaces_its_output(spark, folder):
    source = folder + "/lines"
    publish(spark, source, [("a",)], "value string")
    stream = streams.file_stream(spark, source, spark.read.parquet(source).schema)
    for attempt in ("c1", "c2"):  # a fresh checkpoint makes batch 0 run again
        batches.word_count_stream(stream, folder + "/out", f"{folder}/{attempt}", available_now=True).awaitTermination()
    assert [(r.word, r.cnt) for r in spark.read.parquet(folder + "/out").collect()] == [("a", 1)]


def test_empty_batches_are_skipped(spark, folder):
    source = folder + "/none"
    publish(spark, source, [("a",)], "value string")
    stream = streams.file_stream(spark, source, spark.read.parquet(source).schema).where("value = 'zzz'")
    seen = []
    batches.run_per_batch(stream, lambda df, i: seen.append(i), folder + "/c", available_now=True, keep=True).awaitTermination()
    assert seen == []


def test_image_stream_equals_batch_and_stores_images(spark, folder):
    files = {f"p{i}": encode_raw(picture(i)) for i in range(6)} | {"dark": encode_raw(np.full((24, 32), 7, np.uint8))}
    rows = [(name, bytearray(content)) for name, content in files.items()]
    images = spark.createDataFrame(rows, "image_name string, content binary")
    images = X.extract_features(images, bright_cells, source="content", decoder=decode_raw).cache()
    model = C.train_codebook(C.explode_descriptors(images, "features"), 6, runs=1)
    centers = C.centers_table(spark, model)
    gallery = C.histogram_job(images, "features", centers)
    assert gallery.count() == 6  # the dark picture has no cell in the batch

    publish(spark, folder + "/topic", rows + rows[:1], streams.MESSAGE)
    stream = streams.file_stream(spark, folder + "/topic", streams.MESSAGE)
    store = X.image_table(spark, folder + "/store")
    prepared = spark.sparkContext.accumulator(0)

    def counting(pixels):
        prepared.add(1)
        return bright_cells(pixels)

    matching.match_image_stream(
        stream, gallery, centers, folder + "/out", folder + "/c", lambda batch: matching.received_images(batch, counting, decode_raw),
        k=4, store=store, available_now=True,
    ).awaitTermination()
    got = {(r.query, r.rank, r.match, r.distance) for r in spark.read.parquet(folder + "/out/matches").collect()}
    queries = C.quantise(images, centers, "features", empty="zero")
    assert got == {tuple(r) for r in top_k_similar(queries, gallery, 4).collect()}
    assert ("p3", 1, "p3", 0) in got
    assert {q for q, *_ in got} == set(files)  # the dark picture is matched in the stream
    wide = {r.query: r.image_1 for r in spark.read.parquet(folder + "/out/wide").collect()}
    assert wide["p3"] == "p3#0"
    assert spark.read.text(folder + "/out/log").count() == 7
    stored = {r.image_name: r for r in store.scan(["content", "features", "histogram"]).collect()}
    assert bytes(stored["dark"].content) == files["dark"]
    assert stored["dark"].features is None and sum(stored["dark"].histogram) == 0
    assert prepared.value == 7  # what arrives twice in a batch is described once


def test_counters_stay_folded_over_many_batches(spark, folder, monkeypatch):
    monkeypatch.setattr(counters, "COMPACT_EVERY", 4)
    source = folder + "/words"
    for _ in range(10):
        publish(spark, source, [("a",)], "key string")
    words = streams.file_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    table = CellTable(spark, folder + "/counters", {"count": "value long"}, "key")
    counters.running_counter_stream(words, table, folder + "/c", available_now=True).awaitTermination()
    assert [(r.key, r.value) for r in table.scan().collect()] == [("a", 10)]
    assert len(table.manifest().parts) <= 4


def test_stream_can_drop_images_without_features(spark, folder):
    schema = "image_name string, features array<array<float>>"
    publish(spark, folder + "/t", [("a", [[1.0]]), ("none", None)], schema)
    stream = streams.file_stream(spark, folder + "/t", spark.read.parquet(folder + "/t").schema)
    centers = spark.createDataFrame([(0, [1.0]), (1, [9.0])], "center_id int, center array<double>")
    gallery = spark.createDataFrame([("g", [1, 0])], "image_name string, histogram array<int>")
    matching.match_image_stream(
        stream, gallery, centers, folder + "/o", folder + "/c", lambda df: df, empty="drop", available_now=True
    ).awaitTermination()
    assert [r.query for r in spark.read.parquet(folder + "/o/matches").collect()] == ["a"]


def test_console_writer_is_ready_to_start(spark, folder):
    publish(spark, folder + "/t", [("a",)], "value string")
    stream = streams.file_stream(spark, folder + "/t", spark.read.parquet(folder + "/t").schema)
    batches.show_batch(stream, 10).trigger(availableNow=True).option("checkpointLocation", folder + "/c").start().awaitTermination()



def test_different_images_under_one_key_all_stay(spark, folder):
    """A batch drops repeated messages by key and content, and repeated names after the preparation only."""
    rows = [("cam", b"1"), ("cam", b"2"), ("cam", b"2"), (None, b"3"), (None, b"4"), (None, b"4")]
    publish(spark, folder + "/t", [(k, bytearray(v)) for k, v in rows], streams.MESSAGE)
    stream = streams.file_stream(spark, folder + "/t", streams.MESSAGE)
    centers = spark.createDataFrame([(0, [1.0]), (1, [9.0])], "center_id int, center array<double>")
    gallery = spark.createDataFrame([("g", [1, 0])], "image_name string, histogram array<int>")

    def prepare(batch):
        value = F.decode("value", "UTF-8")
        name = F.when(value == "1", "one").when(value == "4", None).otherwise(F.concat(F.lit("n"), value)).alias("image_name")
        twice = F.explode(F.when(value == "1", F.array(F.lit(1.0), F.lit(9.0))).otherwise(F.array(F.lit(1.0)))).alias("x")
        return batch.select(name, twice).select("image_name", F.array(F.array(F.col("x").cast("float"))).alias("features"))

    matching.match_image_stream(stream, gallery, centers, folder + "/o", folder + "/c", prepare, available_now=True).awaitTermination()
    found = sorted((r.query or "", r.match, r.distance) for r in spark.read.parquet(folder + "/o/matches").collect())
    assert found == [("", "g", 0), ("n2", "g", 0), ("n3", "g", 0), ("one", "g", 2)]


def test_a_growing_gallery_needs_a_store(spark, folder):
    centers = spark.createDataFrame([(0, [1.0])], "center_id int, center array<double>")
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        matching.match_image_stream(stream, None, centers, folder, folder + "/c", lambda b: b, grow=True)
    with pytest.raises(ValueError):
        streams.merged_stream({})


def test_rejects_of_a_batch_are_counted_with_its_clicks(spark, folder):
    rows = [('{"uid":"a","click_count":2}',), ('{"uid":"a","click_count":3}',), ('{"uid":',), ("{}",), (None,)]
    publish(spark, folder + "/t", rows, "value string")
    stream = streams.file_stream(spark, folder + "/t", spark.read.parquet(folder + "/t").schema)
    batches.click_count_stream(stream, folder + "/o", folder + "/c", rejects=folder + "/r", available_now=True).awaitTermination()
    assert [(r.uid, r.clicks) for r in spark.read.parquet(folder + "/o").collect()] == [("a", 5)]
    assert [(r.received, r.rejected) for r in spark.read.parquet(folder + "/r").collect()] == [(5, 3)]


@pytest.mark.parametrize("parts", [1, 3])
def test_words_of_a_table_in_several_files_are_counted(spark, folder, parts):
    """a table that is a folder of part files, as larger ones are."""
    docs = spark.createDataFrame([(i, f"a b{i}\na") for i in range(6)], "doc_id long, text string")
    docs.repartition(parts).write.parquet(folder + "/documents.parquet")
    docs.write.parquet(folder + "/documents.parquet.old")
    got = {r.word: r.cnt for r in plans.stream_word_count(spark, folder).collect()}
    assert got == {"a": 12, **{f"b{i}": 1 for i in range(6)}}


def test_batches_of_a_table_in_several_files_are_transformed(spark, folder):
    """the same for any transform of its batches."""
    rows = [(c, t, ("user", "bot")[t % 2], "x") for c in range(4) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table.repartition(3).write.parquet(folder + "/conversations.parquet")
    assert {tuple(r) for r in plans.transform_batches(spark, folder).collect()} == {("user", 8), ("bot", 4)}


def test_batches_of_a_table_in_folders_by_a_column_are_transformed(spark, folder):
    """the counted column is in the names of the folders only, one of them for null."""
    rows = [(c, t, ("user", "bot", None)[t % 3], "x") for c in range(4) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    table.write.partitionBy("role").parquet(folder + "/conversations.parquet")
    assert {tuple(r) for r in plans.transform_batches(spark, folder).collect()} == {("user", 8), ("bot", 4), (None, 4)}


def test_a_stream_without_rows_has_an_empty_result(spark, folder):
    """no batch has rows, so none makes the sink; the result keeps its schema."""
    tables = {
        "conversations": "conv_id long, turn long, role string, text string",
        "documents": "doc_id long, text string",
        "events": "event_id long, ts timestamp, user_id long, event_type string, props string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    found = {
        plan: (rows.schema.simpleString(), rows.collect())
        for plan, rows in (
            (plan, getattr(plans, plan)(spark, folder))
            for plan in ("transform_batches", "stream_word_count", "stream_click_counts", "stream_log_counts", "save_text", "stream_topics")
        )
    }
    assert found == {
        "transform_batches": ("struct<role:string,n:bigint>", []),
        "stream_word_count": ("struct<word:string,cnt:bigint>", []),
        "stream_click_counts": ("struct<uid:string,clicks:bigint>", []),
        "stream_log_counts": ("struct<dimension:string,key:string,cnt:bigint>", []),
        "save_text": ("struct<value:string>", []),
        "stream_topics": ("struct<source:string,word:string,cnt:bigint>", []),
    }
    assert [tuple(r) for r in plans.stream_click_rejects(spark, folder).collect()] == [(0, 0)]
