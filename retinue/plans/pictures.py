"""Image file and feature queries, over pictures drawn by Spark from the embeddings table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from retinue.functions.images import encode_png
from retinue.operators import codebook, features, similarity
from retinue.plans import derived
from retinue.plans.derived import PIXELS_SQL, WORDS_SQL
from retinue.plans.registry import query, table
from retinue.session import materialise, shared_dir
from retinue.sinks.messages import file_messages, publish_parquet
from retinue.sources.files import channel_gate, read_binary_files, read_images
from retinue.sources.streams import MESSAGE, file_stream
from retinue.streaming import matching


def picture_folder(spark, sf_dir, encode=encode_png) -> str:
    folder = shared_dir(spark, "pictures")
    derived.export_files(derived.pixel_images(spark, sf_dir, encode), folder, ".png")
    return folder


@query("read_binary_files", "SELECT page_id || '.html' AS name, strlen(html) AS length, md5(html) AS digest FROM pages")
def binary_files(spark, sf_dir):
    """Every page written as a file, and read back with its bytes."""
    folder = shared_dir(spark, "pages")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("image_name"), F.encode("html", "UTF-8").alias("content"))
    derived.export_files(pages, folder, ".html")
    return read_binary_files(spark, folder, "*.html").select("name", "length", F.md5("content").alias("digest"))


@query(
    "read_images",
    """SELECT 'img' || CAST(vec_id // 10 AS VARCHAR) || '.png' AS image_name,
              CAST(4 * 2 * count(*) AS INTEGER) AS height, CAST(4 * sum(len(embedding)) // (2 * count(*)) AS INTEGER) AS width,
              CAST(1 AS INTEGER) AS channels
       FROM embeddings GROUP BY vec_id // 10""",
)
def decoded(spark, sf_dir):
    rows = channel_gate(read_images(spark, picture_folder(spark, sf_dir)))
    return rows.select(
        "image_name", F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
    )


def in_some_channels(pixels):
    """Files of 1, 3 or 4 channels, by the first grey level."""
    channels = (1, 3, 4)[int(pixels[0, 0]) % 3]
    return encode_png(pixels[:, :, None].repeat(channels, axis=2))


@query(
    "channel_gate",
    f"""WITH {PIXELS_SQL}
    SELECT image_name || '.png' AS image_name, CAST(CASE v % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END AS INTEGER) AS channels
    FROM descriptors WHERE pos = 0 AND j = 0 AND v % 3 < 2""",
)
def gate(spark, sf_dir):
    """Image files of 1, 3 and 4 channels, of which those of 1 or 3 pass."""
    passed = channel_gate(read_images(spark, picture_folder(spark, sf_dir, in_some_channels)))
    return passed.select("image_name", F.col("image.nChannels").alias("channels"))


@query("publish_files", "SELECT DISTINCT 'img' || CAST(vec_id // 10 AS VARCHAR) || '.png' AS key, true AS whole FROM embeddings")
def publish_files(spark, sf_dir):
    """Every picture file as a message, compared with the bytes it was drawn with."""
    folder, topic = picture_folder(spark, sf_dir), shared_dir(spark, "topic")
    publish_parquet(file_messages(read_binary_files(spark, folder)), topic)
    drawn = derived.pixel_images(spark, sf_dir).select(F.concat("image_name", F.lit(".png")).alias("key"), "content")
    sent = spark.read.schema(MESSAGE).parquet(topic)
    return sent.join(drawn, "key").select("key", (F.col("value") == F.col("content")).alias("whole"))


def totals(rows, feature):
    """``<image_name, n_descriptors, total>``: the number of descriptors and the sum of their values."""
    total = F.aggregate(F.flatten(feature), F.lit(0.0), lambda a, v: a + v.cast("double")).cast("long")
    return rows.select("image_name", F.size(feature).cast("long").alias("n_descriptors"), total.alias("total"))


@query(
    "ingest_images",
    f"""WITH {PIXELS_SQL}
    SELECT image_name || '.png' AS image_name, count(DISTINCT pos) AS n_descriptors, CAST(sum(v) AS BIGINT) AS total
    FROM descriptors GROUP BY image_name""",
)
def ingest_images(spark, sf_dir):
    """Files to image table and back."""
    store = features.image_table(spark, shared_dir(spark, "images"))
    features.ingest_into(store, picture_folder(spark, sf_dir), derived.cell_means)
    return totals(store.scan(["path", "features"]), "features")


@query(
    "extract_features",
    f"""WITH {PIXELS_SQL}
    SELECT image_name, count(DISTINCT pos) AS n_descriptors, CAST(sum(v) AS BIGINT) AS total FROM descriptors GROUP BY image_name""",
)
def extract_features(spark, sf_dir):
    """Descriptors of image messages, by a decoder and an extractor that the caller brings."""
    pictures = derived.pixel_images(spark, sf_dir, derived.encode_raw)
    found = features.extract_features(pictures, derived.cell_means, source="content", decoder=derived.decode_raw)
    return totals(found, "features")


def mean_colour(pixels):
    """One four-value descriptor per image quarter."""
    h, w = pixels.shape[0] // 2, pixels.shape[1] // 2
    quarters = [pixels[a : a + h, b : b + w].reshape(-1) for a in (0, h) for b in (0, w)]
    return [[q.mean(), q.std(), q.min(), q.max()] for q in quarters]


@query(
    "feature_summary",
    """WITH images AS (SELECT 2 * count(*) AS n FROM embeddings GROUP BY vec_id // 10)
    SELECT 'features' AS kind, count(*) AS images, CAST(sum(n) AS BIGINT) AS descriptors, avg(n) AS mean_descriptors FROM images
    UNION ALL SELECT 'colour', count(*), 4 * count(*), 4.0 FROM images""",
)
def feature_summary(spark, sf_dir):
    images = read_images(spark, picture_folder(spark, sf_dir))
    found = features.extract_features(images, derived.cell_means)
    found = features.extract_features(found, mean_colour, "colour")
    return features.feature_totals(features.feature_summary(found, ["features", "colour"]))


def searchable(spark, sf_dir):
    """Described pictures and a codebook of the first picture's descriptors."""
    pictures = derived.pixel_images(spark, sf_dir, derived.encode_raw)
    found = features.extract_features(pictures, derived.cell_means, source="content", decoder=derived.decode_raw)
    found = materialise(found.drop("content"), "features")
    return found, derived.first_words(found, "features")


@query("image_search", f"WITH {WORDS_SQL} SELECT query, rank, match, distance FROM ranked WHERE rank <= 3")
def image_search(spark, sf_dir):
    """Pictures to descriptors, visual words, histograms and the three most similar pictures."""
    found, centers = searchable(spark, sf_dir)
    images = codebook.quantise(found, centers, "features", empty="zero").select("image_name", "histogram")
    images = images.persist(StorageLevel.MEMORY_AND_DISK)
    return similarity.top_k_similar(images, images, 3).withColumn("distance", F.col("distance").cast("long"))


@query("stream_image_match", f"WITH {WORDS_SQL} SELECT query, rank, match, distance FROM ranked WHERE rank <= 3")
def stream_image_match(spark, sf_dir):
    """The whole stream: image bytes arrive, are described, quantised, matched and stored."""
    pictures = derived.pixel_images(spark, sf_dir, derived.encode_raw)
    topic = shared_dir(spark, "topic")
    publish_parquet(pictures.select(F.col("image_name").alias("key"), F.col("content").alias("value")), topic)
    found, centers = searchable(spark, sf_dir)
    gallery = codebook.quantise(found, centers, "features", empty="zero").select("image_name", "histogram")
    out = shared_dir(spark, "matched")
    store = features.image_table(spark, shared_dir(spark, "images"))

    def prepare(messages):
        return matching.received_images(messages, derived.cell_means, derived.decode_raw)

    stream = file_stream(spark, topic, MESSAGE)
    matching.match_image_stream(
        stream, gallery, centers, out, shared_dir(spark, "progress"), prepare, k=3, store=store, available_now=True
    ).awaitTermination()
    stored = store.scan(["content", "histogram"]).where(F.col("content").isNotNull() & F.col("histogram").isNotNull())
    matches = spark.read.parquet(f"{out}/matches").join(stored.select(F.col("image_name").alias("query")), "query")
    return matches.select("query", F.col("rank").cast("int").alias("rank"), "match", F.col("distance").cast("long").alias("distance"))
