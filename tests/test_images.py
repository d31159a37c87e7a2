import numpy as np
import pytest
from pyspark.sql import functions as F

from retinue.functions.images import encode_png
from retinue.operators import features as X
from retinue.plans.derived import cell_means, decode_raw, encode_raw
from retinue.sinks.messages import file_messages, publish_parquet
from retinue.sources.files import channel_gate, read_binary_files, read_images


def picture(seed, size=(6, 8)):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 255, size), np.ones((4, 4))).astype(np.uint8)


def colour(grey):
    return np.stack([grey] * 3, axis=2)


def bright_cells(pixels):
    """An extractor that finds no point in dark pictures."""
    cells = cell_means(pixels)
    return cells[cells.max(axis=1) > 100]


@pytest.fixture
def pictures(folder):
    grey = picture(1)
    files = {
        "colour.png": encode_png(colour(grey)),
        "grey.png": encode_png(grey),
        "dark.png": encode_png(np.full((8, 8), 9, np.uint8)),
        "four.png": encode_png(np.dstack([colour(grey), grey])),
        "broken.png": b"\x89PNG\r\n\x1a\nbroken",
    }
    for name, content in files.items():
        with open(f"{folder}/{name}", "wb") as out:
            out.write(content)
    return folder


def test_ingest_keeps_every_file_and_nulls_bad_ones(spark, pictures):
    rows = {r.image_name: r for r in X.ingest_images(spark, pictures, bright_cells).collect()}
    assert len(rows) == 5
    assert rows["colour.png"].features == rows["grey.png"].features == cell_means(picture(1)[:, :, None]).tolist()
    assert rows["dark.png"].features is rows["four.png"].features is rows["broken.png"].features is None
    assert bytes(rows["broken.png"].content).endswith(b"broken")


def test_jpeg_in_the_default_path(spark, pictures):
    jvm = spark._jvm
    source = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(pictures + "/colour.png"))
    assert jvm.javax.imageio.ImageIO.write(source, "jpg", jvm.java.io.File(pictures + "/photo.JPEG"))
    rows = {r.image_name: r for r in X.ingest_images(spark, pictures, cell_means).collect()}
    assert len(rows) == 6 and bytes(rows["photo.JPEG"].content)[:2] == b"\xff\xd8"
    assert np.abs(np.array(rows["photo.JPEG"].features) - np.array(rows["colour.png"].features)).mean() < 20


def test_channel_gate_on_files(spark, pictures):
    images = read_images(spark, pictures)
    assert {r.image_name: r.image.nChannels for r in images.collect()} == {"colour.png": 3, "grey.png": 1, "dark.png": 1, "four.png": 4}
    assert {r.image_name for r in channel_gate(images).collect()} == {"colour.png", "grey.png", "dark.png"}
    found = {r.image_name: r.features for r in X.extract_features(images, cell_means).collect()}
    assert found["four.png"] is None and found["grey.png"] is not None


def failing(pixels):
    raise RuntimeError("no features today")


def test_an_error_in_the_extractor_is_seen(spark, pictures):
    with pytest.raises(Exception, match="no features today"):
        X.ingest_images(spark, pictures, failing).collect()


def test_bytes_need_a_decoder(spark):
    rows = spark.createDataFrame([("a", bytearray(encode_raw(picture(2)))), ("b", bytearray(b"junk")), ("c", None)], "image_name string, content binary")
    with pytest.raises(ValueError, match="decoder"):
        X.extract_features(rows, cell_means, source="content")
    found = {r.image_name: r.features for r in X.extract_features(rows, cell_means, source="content", decoder=decode_raw).collect()}
    assert found["a"] == cell_means(picture(2)[:, :, None]).tolist() and found["b"] is found["c"] is None


def test_table_backfill_and_summary(spark, pictures, folder):
    store = X.image_table(spark, folder + "/table")
    store.put(X.ingest_images(spark, pictures, bright_cells))
    assert {r.image_name for r in store.scan(["features"]).collect()} == {"colour.png", "grey.png"}

    def counted(df):
        return df.withColumn("histogram", F.transform("features", lambda row: F.size(row)))

    found = X.backfill_feature(store.scan(["features"]), "features", counted, "histogram")
    store.put(found)
    assert {r.image_name for r in store.scan(["histogram"]).collect()} == {"colour.png", "grey.png"}
    summary = X.feature_summary(store.scan(["features"]), ["features"])
    assert {(r.image_name, r.kind, r.n_cols) for r in summary.collect()} == {(n, "features", 8) for n in ("colour.png", "grey.png")}
    totals = {r.kind: r for r in X.feature_totals(summary).collect()}
    assert totals["features"].images == 2 and totals["features"].descriptors == 12


def test_files_as_messages(spark, pictures, folder):
    publish_parquet(file_messages(read_binary_files(spark, pictures, "*.png")), folder + "/topic")
    rows = spark.read.parquet(folder + "/topic").collect()
    assert {r.key for r in rows} == {"colour.png", "grey.png", "dark.png", "four.png", "broken.png"}


def test_file_bytes_are_not_shuffled(spark, pictures):
    plan = read_binary_files(spark, pictures)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("decoder", [None, "own"])
def test_ingestion_into_the_table_equals_the_joined_rows(spark, pictures, folder, decoder, monkeypatch):
    want = {r.image_name: (bytes(r.content), r.features) for r in X.ingest_images(spark, pictures, cell_means).collect()}
    store = X.image_table(spark, folder + "/table")
    plans = []
    put = type(store).put
    monkeypatch.setattr(type(store), "put", lambda self, rows, *rest, **named: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or put(self, rows, *rest, **named))
    if decoder is None:
        X.ingest_into(store, pictures, cell_means)
        got = {r.image_name: (bytes(r.content), r.features) for r in store.scan(["content", "features"]).collect()}
        assert got == want and all("Join" not in plan and "Exchange" not in plan for plan in plans)
    else:
        X.ingest_into(store, pictures, cell_means, decoder=decode_raw)
        assert {r.image_name for r in store.scan(["content"]).collect()} == set(want) and len(plans) == 1
