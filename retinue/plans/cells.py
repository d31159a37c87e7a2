"""Queries over keyed tables with absent cells: scans, lookups, writes, SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retinue.functions.strings import bytes_to_text, decode_base64, encode_base64, epoch_millis, file_name
from retinue.functions.text import tokenize
from retinue.operators.features import backfill_feature
from retinue.plans.registry import query, table
from retinue.sinks.cells import CellTable, upsert_cells
from retinue.session import shared_dir
from retinue.sources import tables as T
from retinue.sources.files import read_lines

WIDE_SQL = """wide AS (
  SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def wide(spark, sf_dir):
    """Documents with label cells that many of them lack."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(
    "scan_cells",
    f"WITH {WIDE_SQL} SELECT doc_id, quality, toxic FROM wide WHERE quality IS NOT NULL OR toxic IS NOT NULL",
)
def scan_cells(spark, sf_dir):
    return T.scan_cells(wide(spark, sf_dir), ["quality", "toxic"], "doc_id")


@query("scan_table", f"WITH {WIDE_SQL} SELECT * FROM wide")
def scan_table(spark, sf_dir):
    return T.scan_table(wide(spark, sf_dir), "doc_id")


@query("drop_missing", f"WITH {WIDE_SQL} SELECT doc_id, lang, quality FROM wide WHERE quality IS NOT NULL")
def drop_missing(spark, sf_dir):
    return T.drop_missing(wide(spark, sf_dir), ["quality"]).select("doc_id", "lang", "quality")


@query("get_row", "SELECT doc_id, text, lang FROM documents WHERE doc_id = 42")
def get_row(spark, sf_dir):
    return T.get_row(table(spark, sf_dir, "documents"), 42, "doc_id").select("doc_id", "text", "lang")


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf_dir):
    return T.count_rows(table(spark, sf_dir, "lineitem"))


@query(
    "multi_get",
    """SELECT k.doc_id, d.lang, d.n_chars
       FROM (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels) k LEFT JOIN documents d USING (doc_id)""",
)
def multi_get(spark, sf_dir):
    """Keys of which some have no row."""
    keys = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return T.multi_get(documents, keys, "doc_id")


UPSERT_SQL = """
WITH news AS (
  SELECT * FROM (SELECT doc_id + 50 AS doc_id, CASE WHEN toxic = 1 THEN 'flagged' END AS source,
                        CASE WHEN quality = 1 THEN quality END AS quality FROM labels)
  WHERE source IS NOT NULL OR quality IS NOT NULL)
SELECT coalesce(d.doc_id, u.doc_id) AS doc_id, d.lang, coalesce(u.source, d.source) AS source, u.quality
FROM documents d FULL OUTER JOIN news u ON d.doc_id = u.doc_id"""


def label_cells(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 50).alias("doc_id"),
        F.when(F.col("toxic") == 1, F.lit("flagged")).alias("source"),
        F.when(F.col("quality") == 1, F.col("quality")).alias("quality"),
    )


@query("upsert_cells", UPSERT_SQL)
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return upsert_cells(base, label_cells(spark, sf_dir), "doc_id")


@query("cell_table", UPSERT_SQL)
def cell_table(spark, sf_dir):
    """The same through a stored table: two writes, then a read of the latest cells."""
    store = CellTable(
        spark, shared_dir(spark, "cells"), {"origin": "lang string, source string", "label": "quality int"}, "doc_id"
    )
    key = F.col("doc_id").cast("string").alias("doc_id")
    store.put(table(spark, sf_dir, "documents").select(key, "lang", "source"))
    store.put(label_cells(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))
    return store.scan().withColumn("doc_id", F.col("doc_id").cast("long"))


@query("cell_table_compacted", UPSERT_SQL)
def cell_table_compacted(spark, sf_dir):
    """Numbered writes with a compaction between them and one after: the same cells as without."""
    groups = {"origin": "lang string, source string", "label": "quality int"}
    store = CellTable(spark, shared_dir(spark, "cells"), groups, "doc_id")
    key = F.col("doc_id").cast("string").alias("doc_id")
    documents = table(spark, sf_dir, "documents").select(key, "lang", "source")
    store.put(documents.filter("doc_id % 2 = 0"), put_id=0)
    store.put(documents.filter("doc_id % 2 = 1"), put_id=1)
    store.compact()
    store.put(label_cells(spark, sf_dir).withColumn("doc_id", key), put_id=2)
    store.compact()
    return store.scan().withColumn("doc_id", F.col("doc_id").cast("long"))


@query("cell_table_lookup", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id = 42")
def cell_table_lookup(spark, sf_dir):
    """One row of a stored table by its key: one bucket of each group, skipped by bloom filters where it cannot be."""
    groups = {"content": "text string, lang string", "label": "quality int"}
    store = CellTable(spark, shared_dir(spark, "cells"), groups, "doc_id")
    key = F.col("doc_id").cast("string").alias("doc_id")
    store.put(table(spark, sf_dir, "documents").select(key, "text", "lang"))
    store.put(table(spark, sf_dir, "labels").select(key, "quality"))
    return store.get("42")


@query(
    "cell_table_reopened",
    """SELECT CAST(l.doc_id AS VARCHAR) AS doc_id, d.lang, CASE WHEN l.toxic = 1 THEN 'flagged' ELSE d.source END AS source,
              l.quality FROM labels l JOIN documents d USING (doc_id)""",
)
def cell_table_reopened(spark, sf_dir):
    """A table opened by its folder: a write that was made again, a compaction, and a state kept across a later write."""
    root = shared_dir(spark, "cells")
    store = CellTable(spark, root, {"origin": "lang string, source string", "label": "quality int"}, "doc_id")
    key = F.col("doc_id").cast("string").alias("doc_id")
    labels = table(spark, sf_dir, "labels")
    known = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi")
    for _ in range(2):
        store.put(known.select(key, "lang", "source"), put_id=1)
    again = CellTable.open(spark, root)
    again.put(labels.select(key, "quality", F.when(F.col("toxic") == 1, F.lit("flagged")).alias("source")), put_id=2)
    again.compact()
    kept = again.scan()
    again.put(labels.select(key, F.lit(9).alias("quality")), put_id=3)
    return kept


TOKEN_SQL = r"'[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]'"


@query(
    "backfill_feature",
    f"""SELECT * FROM (SELECT conv_id || '-' || turn AS image_name,
                              CAST(len(regexp_extract_all(text, {TOKEN_SQL}, 0)) AS INTEGER) AS n_tokens
                       FROM conversations WHERE role = 'user')
        WHERE n_tokens > 20""",
)
def backfill(spark, sf_dir):
    """A cell computed from a stored cell; turns without that cell, or without a value, write nothing."""
    stored = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("image_name"),
        F.when(F.col("role") == "user", F.col("text")).alias("text"),
    )
    size = F.size(tokenize(F.col("text")))
    return backfill_feature(stored, "text", lambda df: df.withColumn("n_tokens", F.when(size > 20, size)), "n_tokens")


@query("ensure_table", "SELECT r_regionkey, r_name FROM region")
def ensure_table(spark, sf_dir):
    """Create twice, write, drop the catalog entry; the rows stay in the shared folder."""
    name, place = f"regions_{uuid.uuid4().hex}", shared_dir(spark, "regions")
    for _ in range(2):
        T.ensure_table(spark, name, "r_regionkey int, r_name string", place)
    assert T.table_exists(spark, name)
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.insertInto(name)
    T.drop_table(spark, name)
    assert not T.table_exists(spark, name)
    return spark.read.parquet(place)


SQL_TEXT = """
SELECT r.r_name, n.n_name, count(*) AS customers, CAST(sum(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_debt
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name"""


@query("sql_query", SQL_TEXT)
def sql_query(spark, sf_dir):
    names = ("customer", "nation", "region")
    return T.sql_query(spark, SQL_TEXT, **{name: table(spark, sf_dir, name) for name in names})


@query(
    "base64_roundtrip",
    "SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents",
)
def base64_roundtrip(spark, sf_dir):
    encoded = encode_base64(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_replace(encoded, r"[\r\n]", "").alias("encoded"),
        bytes_to_text(decode_base64(encoded)).alias("decoded"),
    )


@query("bytes_to_text", "SELECT conv_id, turn, text FROM conversations")
def bytes_as_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content"))
    return rows.select("conv_id", "turn", bytes_to_text(F.col("content")).alias("text"))


@query("epoch_millis", "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def millis(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", epoch_millis(F.col("ts").cast("timestamp")).alias("millis"))


@query("read_lines", "SELECT url AS value FROM pages")
def lines(spark, sf_dir):
    """Page addresses written as text and read back line by line."""
    path = shared_dir(spark, "lines")
    table(spark, sf_dir, "pages").select("url").write.text(path)
    return read_lines(spark, path)


@query("file_name", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", file_name(F.col("url")).alias("name"))
