"""Reads of keyed tables whose cells may be absent (null), and the SQL catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys sent to the table instead of being shuffled, at most.
BROADCAST_KEYS = 100_000


def scan_cells(table: DataFrame, cols: list[str], key: str = "image_name") -> DataFrame:
    """Key and the requested cells; a row that has none of them is not returned."""
    present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    return table.select(key, *cols).where(present)


def scan_table(table: DataFrame, key: str = "image_name") -> DataFrame:
    """All rows that have at least one cell besides the key."""
    return scan_cells(table, [c for c in table.columns if c != key], key)


def get_row(table: DataFrame, value, key: str = "image_name") -> DataFrame:
    """Point lookup; the comparison is pushed to the file scan."""
    return table.where(F.col(key) == F.lit(value))


def drop_missing(table: DataFrame, cols: list[str]) -> DataFrame:
    return table.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def count_rows(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def multi_get(table: DataFrame, keys: DataFrame, key: str = "image_name") -> DataFrame:
    """Rows of a list of keys; a key without a row comes back with null cells.

    A short list is broadcast to the table after its size was checked; a long
    one is joined on the key.
    """
    asked = keys.select(key).distinct()
    if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        found = table.join(F.broadcast(asked), key, "left_semi")
    else:
        found = table.join(asked, key, "left_semi")
    return asked.join(found, key, "left").select(table.columns)


def sql_query(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL text over the session catalog; ``tables`` are registered as views first."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return spark.sql(text)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    num_partitions: int | None = None,
    **properties: str,
) -> DataFrame:
    """Table (or ``(select ...) t``) of another database, read in parallel ranges if asked."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if partition_column:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", num_partitions)
        )
    return reader.load()


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def ensure_table(spark: SparkSession, name: str, columns: str, location: str | None = None) -> None:
    """Create the table unless it exists."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
