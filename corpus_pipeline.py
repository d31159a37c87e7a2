"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retinue.llm import exact_dedup, near_dedup, packing, pii, quality
from retinue.llm.spread import spread_join, unused, without
from retinue.session import materialise, ship_package

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees learn from the ``labels`` table."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_filter(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts, whatever its ``doc_id``."""
    ship_package(spark)
    numbered, row = _numbered(docs)
    return _kept(numbered, exact_dedup.exact_duplicates(numbered, row=row).filter("NOT kept"), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: that of the smallest ``doc_id``, null after all others."""
    ship_package(spark)
    numbered, row = _numbered(docs)
    # Every row is a document of its own, so null and repeated ids are compared like others.
    found = near_dedup.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    found = materialise(found.select(F.col("doc_id").alias(row), "component_id"), "near-decided")
    sizes = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = materialise(sizes, "near-groups")
    members = spread_join(found, sizes, "component_id", [row], sizes=sizes).select(row, "component_id")
    members = materialise(members.join(numbered.select(row, "doc_id"), row), "near-grouped")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", row))[row].alias("keep_row"))
    decided = spread_join(members, best, "component_id", [row], sizes=sizes)
    return _kept(numbered, decided.filter(F.col(row) != F.col("keep_row")), row)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the name of that column, which no other has.

    Written, so that every later reading sees the same numbers.
    """
    row = unused([*docs.columns, *TAKEN], "_row_number")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _kept(numbered: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """Rows whose number is not in ``gone``, without the numbers."""
    return without(numbered, materialise(gone.select(row), "decided"), row).drop(row)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts replaced by its kind."""
    ship_package(spark)
    return pii.redact_texts(docs, pii.train(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, with their token ids."""
    ship_package(spark)
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added)


#: Names that the stages give to columns beside the number of a row.
TAKEN = ("keep_row", "component_id")

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

#: Boosted trees and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
