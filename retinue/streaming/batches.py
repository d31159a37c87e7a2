"""Per-batch streaming: each batch is a frame of its own, nothing is carried over.

Every sink writes below a folder named by the batch, in overwrite mode, so a
batch that is replayed after a failure replaces its own earlier output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retinue.operators.counts import click_counts, log_counts, parse_clicks, reject_row, word_counts
from retinue.sinks.cells import CellTable
from retinue.sinks.messages import save_text

BatchAction = Callable[[DataFrame, int], None]


def run_per_batch(
    stream: DataFrame,
    action: BatchAction,
    checkpoint: str,
    interval: str | None = None,
    available_now: bool = False,
    keep: bool = False,
) -> StreamingQuery:
    """Start ``action(batch, batch_id)`` for every batch that has rows.

    ``interval`` is a fixed batch interval such as "800 milliseconds";
    ``available_now`` processes what is there and stops. ``keep`` persists the
    batch while the action runs, for actions that read it several times.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        frame = batch.persist(StorageLevel.MEMORY_AND_DISK) if keep else batch
        try:
            if not frame.isEmpty():
                action(frame, batch_id)
        finally:
            if keep:
                frame.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def transform_batches(
    stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Any batch transform; results go to ``out/batch=<id>`` as Parquet."""
    return run_per_batch(
        stream,
        lambda batch, batch_id: fn(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}"),
        checkpoint,
        **trigger,
    )


def word_count_stream(lines: DataFrame, out: str, checkpoint: str, col: str = "value", **trigger) -> StreamingQuery:
    """``<word, cnt>`` of every batch."""
    return transform_batches(lines, lambda batch: word_counts(batch, col), out, checkpoint, **trigger)


def log_count_stream(lines: DataFrame, out: str, checkpoint: str, col: str = "value", **trigger) -> StreamingQuery:
    """``<dimension, key, cnt>`` of every batch: ip, page, agent, rejected."""
    return transform_batches(lines, lambda batch: log_counts(batch, col), out, checkpoint, **trigger)


def click_count_stream(
    messages: DataFrame, out: str, checkpoint: str, rejects: str | None = None, **trigger
) -> StreamingQuery:
    """``<uid, clicks>`` of every batch of JSON click messages.

    ``rejects`` names a folder for ``<received, rejected>`` of every batch, which
    the pass that counts the clicks has counted too.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counts = click_counts(parse_clicks(batch), rejects=seen if rejects else None)
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if rejects:
            reject_row(batch.sparkSession, seen).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return run_per_batch(messages, save, checkpoint, **trigger)


def save_text_per_batch(stream: DataFrame, prefix: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rows of every batch as text lines in ``<prefix>-<batch_id>``."""
    return run_per_batch(
        stream, lambda batch, batch_id: save_text(batch, f"{prefix}-{batch_id}"), checkpoint, **trigger
    )


def log_text_stream(lines: DataFrame, prefix: str, checkpoint: str, col: str = "value", **trigger) -> StreamingQuery:
    """Text files ``<prefix>/<ip|page|agent>Counts-<batch_id>``, ascending by count for ip and page."""

    def save(batch: DataFrame, batch_id: int) -> None:
        counts = log_counts(batch, col).persist(StorageLevel.MEMORY_AND_DISK)
        for name in ("ip", "page"):
            rows = counts.where(F.col("dimension") == name).select("cnt", "key").orderBy("cnt", "key")
            save_text(rows, f"{prefix}/{name}Counts-{batch_id}")
        save_text(counts.where(F.col("dimension") == "agent").select("key", "cnt"), f"{prefix}/agentCounts-{batch_id}")
        counts.unpersist()

    return run_per_batch(lines, save, checkpoint, **trigger)


def write_counts(
    counts: Callable[[DataFrame], DataFrame], stream: DataFrame, table: CellTable, checkpoint: str, **trigger
) -> StreamingQuery:
    """The (key, count) rows of each batch into a counter table, keyed by the token."""
    return run_per_batch(stream, lambda batch, _: table.put(counts(batch)) and None, checkpoint, **trigger)


def show_batch(stream: DataFrame, n: int = 10, interval: str | None = None):
    """Print the first rows of each batch; returns the writer, ready to start."""
    writer = stream.writeStream.format("console").option("numRows", n).option("truncate", False)
    return writer.trigger(processingTime=interval) if interval else writer
