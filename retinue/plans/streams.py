"""Streaming queries: the given tables are read as a stream to its end and the sink is read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retinue.operators import codebook
from retinue.plans import derived
from retinue.plans.derived import PAIRS_SQL
from retinue.plans.logs import CLICKS_SQL, LOG_COUNTS_SQL, LOG_SQL, WORDS_SQL, broken_click_message, click_message, log_line, text_lines
from retinue.plans.registry import query, table
from retinue.session import file_system, materialise, shared_dir
from retinue.sinks.cells import CellTable
from retinue.sources.streams import file_stream, merged_stream
from retinue.streaming import batches, counters, matching


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, be it one file or a folder of files, also one with a folder per value of a column."""
    rows, path = table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet"
    files = [file.rsplit("/", 1)[1] for file in rows.inputFiles()]
    # A stream takes a folder or a pattern, not a file; this pattern means the one file. Below a pattern no columns of folders are found.
    return file_stream(spark, f"{sf_dir}/{name}.[p]arquet" if files == [f"{name}.parquet"] else path, rows.schema)


def _sink(spark, out, empty, read=None):
    """What the batches have written to ``out``: nothing, with the schema ``empty``, if none of them had rows."""
    fs, place = file_system(spark, out)
    return (read or spark.read.parquet)(out) if fs.exists(place) else spark.createDataFrame([], empty)


def _finish(spark, start, label, empty, read=None):
    out, checkpoint = shared_dir(spark, label), shared_dir(spark, "progress")
    start(out, checkpoint).awaitTermination()
    return _sink(spark, out, empty, read)


@query("stream_word_count", f"WITH {WORDS_SQL} SELECT word, count(*) AS cnt FROM words GROUP BY word")
def stream_word_count(spark, sf_dir):
    lines = text_lines(table_stream(spark, sf_dir, "documents"))
    rows = _finish(spark, lambda o, c: batches.word_count_stream(lines, o, c, available_now=True), "words", "word string, cnt long")
    return rows.select("word", "cnt")


@query("stream_log_counts", LOG_COUNTS_SQL)
def stream_log_counts(spark, sf_dir):
    lines = table_stream(spark, sf_dir, "events").select(log_line().alias("value"))
    rows = _finish(spark, lambda o, c: batches.log_count_stream(lines, o, c, available_now=True), "logs", "dimension string, key string, cnt long")
    return rows.select("dimension", "key", "cnt")


@query("stream_log_text", f"WITH {LOG_SQL} SELECT '(' || count(*) || ',' || ip || ')' AS value FROM fields GROUP BY ip")
def stream_log_text(spark, sf_dir):
    lines = table_stream(spark, sf_dir, "events").select(log_line().alias("value"))
    return _finish(
        spark,
        lambda o, c: batches.log_text_stream(lines, o, c, available_now=True),
        "logtext",
        "value string",
        lambda out: spark.read.text(f"{out}/ipCounts-*"),
    )


@query("stream_click_counts", CLICKS_SQL)
def stream_click_counts(spark, sf_dir):
    messages = table_stream(spark, sf_dir, "events").select(click_message().alias("value"))
    rows = _finish(spark, lambda o, c: batches.click_count_stream(messages, o, c, available_now=True), "clicks", "uid string, clicks long")
    return rows.select("uid", "clicks")


@query("save_text_per_batch", "SELECT '(' || event_id || ',' || event_type || ')' AS value FROM events")
def save_text(spark, sf_dir):
    rows = table_stream(spark, sf_dir, "events").select("event_id", "event_type")
    return _finish(
        spark,
        lambda o, c: batches.save_text_per_batch(rows, f"{o}/part", c, available_now=True),
        "text",
        "value string",
        lambda out: spark.read.text(f"{out}/part-*"),
    )


@query("write_counts", "SELECT event_type AS key, count(*) AS cnt FROM events GROUP BY event_type")
def write_counts(spark, sf_dir):
    """Per-batch counts put into a counter table."""
    rows = table_stream(spark, sf_dir, "events").select(F.col("event_type").alias("key"))

    def store(out):
        return CellTable(spark, out, {"count": "cnt long"}, "key")

    def count(batch):
        return batch.groupBy("key").agg(F.count("*").alias("cnt"))

    return _finish(
        spark,
        lambda o, c: batches.write_counts(count, rows, store(o), c, available_now=True),
        "counts",
        "key string, cnt long",
        lambda out: store(out).scan(),
    )


@query("running_counters", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS value FROM events GROUP BY user_id")
def running_counters(spark, sf_dir):
    """Cumulative counts over several batches: the events are cut into eight files first."""
    events = materialise(table(spark, sf_dir, "events").select("user_id").repartition(8), "events")
    source = events.inputFiles()[0].rsplit("/", 1)[0]
    stream = file_stream(spark, source, events.schema, files_per_batch=4)

    def store(out):
        return CellTable(spark, out, {"count": "value long"}, "key")

    return _finish(
        spark,
        lambda o, c: counters.running_counter_stream(stream, store(o), c, key="user_id", available_now=True),
        "counters",
        "key string, value long",
        lambda out: store(out).scan(),
    )


def _matched(spark, sf_dir):
    images = materialise(derived.images(spark, sf_dir), "received")
    source = images.inputFiles()[0].rsplit("/", 1)[0]
    stream = file_stream(spark, source, images.schema)
    centers = derived.centers(spark, sf_dir)
    stored = codebook.histogram_job(derived.images(spark, sf_dir), "features", centers)
    return lambda o, c: matching.match_image_stream(
        stream, stored, centers, o, c, prepare=lambda batch: batch, available_now=True
    )


@query("stream_match", f"WITH {PAIRS_SQL} SELECT query, rank, match, distance FROM ranked WHERE rank <= 10")
def stream_match(spark, sf_dir):
    """Images that arrive as messages, matched against the stored gallery."""
    rows = _finish(
        spark,
        _matched(spark, sf_dir),
        "matched",
        "query string, rank int, match string, distance long",
        lambda out: spark.read.parquet(f"{out}/matches"),
    )
    return rows.select("query", "rank", "match", "distance")


@query("match_log", "SELECT DISTINCT 'img' || CAST(vec_id // 10 AS VARCHAR) AS query FROM embeddings")
def match_log(spark, sf_dir):
    """Names in the text log of the matched images."""
    lines = _finish(spark, _matched(spark, sf_dir), "matched", "value string", lambda out: spark.read.text(f"{out}/log"))
    return lines.select(F.split("value", " ")[0].alias("query"))


@query(
    "transform_batches",
    "SELECT role, count(*) AS n FROM conversations GROUP BY role",
)
def transform_batches(spark, sf_dir):
    stream = table_stream(spark, sf_dir, "conversations")

    def count(batch):
        return batch.groupBy("role").agg(F.count("*").alias("n"))

    rows = _finish(
        spark, lambda o, c: batches.transform_batches(stream, count, o, c, available_now=True), "roles", "role string, n long"
    )
    return rows.select("role", "n")


@query("stream_click_rejects", """
SELECT count(*) AS received, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS rejected FROM events""")
def stream_click_rejects(spark, sf_dir):
    """What the click stream received and rejected, over all its batches."""
    events = materialise(table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "props").repartition(6), "events")
    source = events.inputFiles()[0].rsplit("/", 1)[0]
    messages = file_stream(spark, source, events.schema, files_per_batch=2).select(broken_click_message().alias("value"))
    rejects = shared_dir(spark, "rejects")
    rows = _finish(
        spark,
        lambda o, c: batches.click_count_stream(messages, o, c, rejects=rejects, available_now=True),
        "clicks",
        "received long, rejected long",
        lambda out: spark.read.parquet(rejects),
    )
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "rejected")])


@query(
    "stream_topics",
    """SELECT source, word, count(*) AS cnt FROM (
         SELECT 'chat' AS source, unnest(string_split(text, ' ')) AS word FROM conversations
         UNION ALL SELECT 'events', event_type FROM events)
       GROUP BY source, word""",
)
def stream_topics(spark, sf_dir):
    """Three topics as one stream with one checkpoint: one ends early, one has nothing in the first run, one nothing at all."""
    chat = shared_dir(spark, "topic")
    texts = table(spark, sf_dir, "conversations").select(F.col("text").alias("value"))
    texts.limit(0).write.parquet(f"{chat}/0")
    events = materialise(table(spark, sf_dir, "events").select(F.col("event_type").alias("value")).repartition(5), "events")
    silent = materialise(texts.limit(0), "topic")
    out, checkpoint = shared_dir(spark, "topics"), shared_dir(spark, "progress")

    def count(batch):
        words = batch.select("source", F.explode(F.split("value", " ")).alias("word"))
        return words.groupBy("source", "word").agg(F.count("*").alias("cnt"))

    for run in range(2):
        topics = {
            "chat": file_stream(spark, f"{chat}/*", texts.schema),
            "events": file_stream(spark, events.inputFiles()[0].rsplit("/", 1)[0], texts.schema, files_per_batch=2),
            "silent": file_stream(spark, silent.inputFiles()[0].rsplit("/", 1)[0], texts.schema),
        }
        batches.transform_batches(merged_stream(topics), count, out, checkpoint, available_now=True).awaitTermination()
        if run == 0:
            texts.write.parquet(f"{chat}/1")
    rows = _sink(spark, out, "source string, word string, cnt long")
    return rows.groupBy("source", "word").agg(F.sum("cnt").alias("cnt"))


class Interrupted(RuntimeError):
    """Stands for the loss of the driver in the middle of a batch."""


@query(
    "stream_recovery",
    """SELECT sink, key, count(*) AS cnt FROM (
         SELECT 'text' AS sink, event_type AS key FROM events UNION ALL SELECT 'table', event_type FROM events)
       GROUP BY sink, key""",
)
def stream_recovery(spark, sf_dir):
    """A stream that fails between the two sinks of a batch, and goes on from its checkpoint: every row once in both."""
    events = materialise(table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).repartition(6), "events")
    source = events.inputFiles()[0].rsplit("/", 1)[0]
    stream = file_stream(spark, source, events.schema, files_per_batch=2)
    out, checkpoint = shared_dir(spark, "recovery"), shared_dir(spark, "progress")
    fail = [True]

    def save(batch, batch_id):
        batch.write.mode("overwrite").text(f"{out}/text/batch={batch_id}")
        if batch_id == 1 and fail[0]:
            raise Interrupted
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    try:
        batches.run_per_batch(stream, save, checkpoint, available_now=True).awaitTermination()
    except StreamingQueryException:
        fail[0] = False
    assert not fail[0]
    batches.run_per_batch(stream, save, checkpoint, available_now=True).awaitTermination()
    text = spark.read.text(f"{out}/text").select(F.lit("text").alias("sink"), F.col("value").alias("key"))
    rows = text.union(spark.read.parquet(f"{out}/table").select(F.lit("table"), "key"))
    return rows.groupBy("sink", "key").agg(F.count("*").alias("cnt"))


GROWING_SQL = PAIRS_SQL.split("ranked AS")[0].rstrip().rstrip(",") + """,
numbered AS (SELECT *, CAST(substr(query, 4) AS BIGINT) % 3 AS q, CAST(substr(match, 4) AS BIGINT) % 3 AS g FROM pairs)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, match) AS INTEGER) AS rank, match, distance
FROM numbered WHERE g < q QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, match) <= 10"""


@query("stream_growing_gallery", f"WITH {GROWING_SQL}")
def stream_growing_gallery(spark, sf_dir):
    """Images in three batches, each matched with those that the batches before it stored; the second batch fails once."""
    images = materialise(derived.images(spark, sf_dir), "received")
    third = F.substring("image_name", 4, 9).cast("long") % 3
    source = shared_dir(spark, "topic")
    for n in range(3):
        # One file each, in this order.
        images.filter(third == n).coalesce(1).write.parquet(f"{source}/{n}")
    out, checkpoint = shared_dir(spark, "matched"), shared_dir(spark, "progress")
    store = CellTable(spark, shared_dir(spark, "store"), {"histogram": "histogram array<int>"})
    centers = derived.centers(spark, sf_dir)
    fail = [True]

    def prepare(batch):
        if fail[0] and len(store.manifest().parts) == 1:
            # The batch is lost when its matches are written and its images are stored.
            put = store.put

            def lose(*args, **kwargs):
                put(*args, **kwargs)
                raise Interrupted

            store.put = lose
        return batch

    def run():
        stream = file_stream(spark, f"{source}/*", images.schema, files_per_batch=1)
        matching.match_image_stream(
            stream, None, centers, out, checkpoint, prepare, store=store, grow=True, available_now=True
        ).awaitTermination()

    try:
        run()
    except StreamingQueryException:
        fail[0] = False
        del store.put
    assert not fail[0]
    run()
    return spark.read.parquet(f"{out}/matches").select("query", "rank", "match", "distance")
