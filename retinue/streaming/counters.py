"""Running counters: counts that accumulate over the life of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retinue.sinks.cells import CellTable

#: Batches after which the writes of a stream are folded.
COMPACT_EVERY = 50


def running_counts(stream: DataFrame, key: str = "key", row: str = "Counter", delta: str | None = None) -> DataFrame:
    """Stateful ``<row, key, value>``: cumulative count (or sum of ``delta``) per key.

    The state is one number per key; each batch is summed before it is
    shuffled, so a dominant key costs one row per task.
    """
    amount = F.count("*") if delta is None else F.sum(F.col(delta).cast("long"))
    counts = stream.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(amount.alias("value"))
    return counts.select(F.lit(row).alias("row"), "key", "value")


def running_counter_stream(
    stream: DataFrame,
    table: CellTable,
    checkpoint: str,
    key: str = "key",
    row: str = "Counter",
    delta: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep the running counts in ``table`` (key column ``key``, cell ``value``).

    Absolute values are written, so a replayed batch counts once.
    """
    counts = running_counts(stream, key, row, delta).select(F.col("key").cast("string"), "value")

    def save(batch: DataFrame, batch_id: int) -> None:
        # Ordered by the batch, not by a clock; the stream owns the table.
        table.put(batch, put_id=batch_id)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            table.compact()

    return _update_mode(counts, save, checkpoint, **trigger)


def _update_mode(counts: DataFrame, save, checkpoint: str, interval: str | None = None, available_now: bool = False):
    writer = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()
