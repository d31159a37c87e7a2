"""Registered queries of the training-text operators, with their SQL oracles where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retinue.llm import (
    deleted_interpolation,
    exact_dedup,
    line_spread,
    near_dedup,
    packing,
    pieces,
    pii,
    preferences,
    quality,
    resampling,
    toxicity,
    url_lists,
    vector_codes,
)

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXACT_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT text_sha256, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM texts GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM texts JOIN groups USING (text_sha256)
"""


@query("op3_exact_dedup", EXACT_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""


@query("op8_minhash_near_dedup", NEAR_SQL)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_quality_trees")
def op10_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op2_candidate_boosting")
def op2_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.train(docs)).drop("redacted")


@query("op7_order_packing")
def op7_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), ranks, added)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op4_deleted_interpolation")
def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.scores(table(spark, sf_dir, "documents"))


@query("op6_piece_backtracking")
def op6_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


PREFERENCE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, 'c' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, 'r', turn, role,
         CASE WHEN turn > conv_id % 3 AND role = 'assistant' THEN 'Sorry. ' || text ELSE text END
  FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn >= 6)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS p,
         '<|' || coalesce(role, '') || '|>' || chr(10) AS header,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered
  FROM turns),
prefixes AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
         min(CASE WHEN c.p IS NULL OR r.p IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text
                  THEN coalesce(c.p, r.p) END) AS differs, count(*) AS n
  FROM (FROM placed WHERE side = 'c') c FULL JOIN (FROM placed WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.p = r.p
  GROUP BY 1),
split AS (
  SELECT placed.*, coalesce(differs - 1, n) AS n_prompt_turns,
         sum(CASE WHEN p > coalesce(differs - 1, n) THEN length(rendered) ELSE 0 END)
           OVER (PARTITION BY pair_id, side ORDER BY p) AS stop
  FROM placed JOIN prefixes USING (pair_id))
SELECT pair_id, CAST(any_value(n_prompt_turns) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(rendered, '' ORDER BY p) FILTER (WHERE side = 'c' AND p <= n_prompt_turns), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY p) FILTER (WHERE side = 'c' AND p > n_prompt_turns), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY p) FILTER (WHERE side = 'r' AND p > n_prompt_turns), '') AS rejected,
       coalesce(string_agg((stop - length(rendered) + length(header)) || ':' || (stop - 1), ',' ORDER BY p)
         FILTER (WHERE side = 'c' AND p > n_prompt_turns AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((stop - length(rendered) + length(header)) || ':' || (stop - 1), ',' ORDER BY p)
         FILTER (WHERE side = 'r' AND p > n_prompt_turns AND role = 'assistant'), '') AS rejected_mask
FROM split GROUP BY pair_id
"""


@query("op1_preference_pairs", PREFERENCE_SQL)
def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen one; the rejected one goes on differently after the first turns or ends earlier."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "pair_id")
    worse = (F.col("turn") > F.col("pair_id") % 3) & (F.col("role") == "assistant")
    rejected = turns.filter("NOT (pair_id % 4 = 0 AND turn >= 6)")
    rejected = rejected.withColumn("text", F.when(worse, F.concat(F.lit("Sorry. "), "text")).otherwise(F.col("text")))
    pairs = preferences.format_preferences(turns, rejected)
    for mask in ("chosen_mask", "rejected_mask"):
        pairs = pairs.withColumn(mask, F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ","))
    return pairs


#: Begin and length in seconds of the year in which the derived list and captures lie.
YEAR, SECONDS = 1_704_067_200, 31_536_000
URL_SQL = rf"""
WITH captures AS (
  SELECT page_id, url, {YEAR} + page_id * 475140 % {SECONDS} AS fetched,
         lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
named AS (
  SELECT key, level, CAST('0x' || substr(md5(key), 1, 4) AS BIGINT) AS k
  FROM (SELECT DISTINCT host AS key, 'host' AS level FROM captures
        UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.'), 'domain' FROM captures)),
entries AS (
  SELECT key, {YEAR} + k * 480 AS time, 'block' AS action FROM named WHERE level = 'domain' OR k % 3 = 0
  UNION ALL SELECT key, {YEAR} + k * 480 + 5184000, 'remove' FROM named WHERE level = 'domain' OR k % 6 = 0
  UNION ALL SELECT key, {YEAR} + k * 240, 'allow' FROM named WHERE level = 'host' AND k % 5 = 0
  UNION ALL SELECT host || path, {YEAR} + page_id * 6283740 % {SECONDS}, 'block' FROM captures WHERE page_id % 50 = 0),
changes AS (
  SELECT key, time, first(action ORDER BY CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS action
  FROM entries GROUP BY key, time),
intervals AS (
  SELECT key, action, time AS valid_from, lead(time) OVER (PARTITION BY key ORDER BY time) AS valid_to FROM changes),
found AS (
  SELECT c.page_id, i.key, i.action, i.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.key) DESC) AS n, count(*) OVER (PARTITION BY c.page_id) AS n_active
  FROM captures c JOIN intervals i
    ON i.action <> 'remove' AND i.valid_from <= c.fetched AND (i.valid_to IS NULL OR c.fetched < i.valid_to)
   AND (i.key = c.host || c.path
        OR ((i.key = c.host OR ends_with(c.host, '.' || i.key)) AND (contains(i.key, '.') OR i.key = c.host))))
SELECT c.page_id, c.url, c.fetched, CAST(1 AS BIGINT) AS n_rows, coalesce(f.n_active, 0) AS n_active,
       f.key, f.action, f.valid_from, f.action IS DISTINCT FROM 'block' AS kept
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id AND f.n = 1
"""


@query("op5_url_list_intervals", URL_SQL)
def op5_url_list_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture within a year, against a list with changes of its hosts, domains and some addresses."""
    fetched = (F.lit(YEAR) + F.col("page_id") * 475140 % SECONDS).alias("fetched")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched)
    hosts = captures.select(url_lists.host_of(F.col("url")).alias("key")).distinct()
    domains = hosts.select(F.array_join(F.slice(F.split("key", r"\."), F.greatest(-F.size(F.split("key", r"\.")), F.lit(-2)), 2), ".").alias("key"))
    named = hosts.withColumn("level", F.lit("host")).union(domains.distinct().withColumn("level", F.lit("domain")))
    named = named.withColumn("k", F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("long"))
    changes = [
        ("level = 'domain' OR k % 3 = 0", F.col("k") * 480, "block"),
        ("level = 'domain' OR k % 6 = 0", F.col("k") * 480 + 5_184_000, "remove"),
        ("level = 'host' AND k % 5 = 0", F.col("k") * 240, "allow"),
    ]
    entries = [named.filter(which).select("key", (F.lit(YEAR) + at).alias("time"), F.lit(action).alias("action")) for which, at, action in changes]
    time = (F.lit(YEAR) + F.col("page_id") * 6283740 % SECONDS).alias("time")
    addresses = captures.filter("page_id % 50 = 0").select(url_lists.address_of(F.col("url")).alias("key"), time, F.lit("block").alias("action"))
    dated = entries[0].union(entries[1]).union(entries[2]).union(addresses)
    return url_lists.filter_captures(captures, dated)


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS source, p, parts[p] AS line,
         regexp_full_match(parts[p], '[\x20\x09\x0B-\x0D]*') AS blank
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS p
        FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (SELECT line FROM lines WHERE NOT blank GROUP BY line HAVING count(DISTINCT source) >= 5)
SELECT l.doc_id, count(*) FILTER (WHERE NOT blank) AS n_lines, count(s.line) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY p) FILTER (WHERE s.line IS NULL), '')) AS text_sha256
FROM lines l LEFT JOIN shared s ON s.line = l.line AND NOT blank
GROUP BY l.doc_id
"""


@query("op9_line_site_spread", LINES_SQL)
def op9_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.remove_shared_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def _codes_sql() -> str:
    """The same four rounds written out, with all distances."""
    tables = ["""
v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT vec_id, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS w, list_inner_product(w, w) AS n
  FROM v, (SELECT unnest(range(4)) AS p)),
c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w AS c FROM s
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)"""]
    for n in range(5):
        tables.append(f"""
a{n} AS MATERIALIZED (
  SELECT vec_id, p, any_value(w) AS w, min(CAST(s.n - 2 * list_inner_product(w, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS best
  FROM s JOIN c{n} USING (p) GROUP BY vec_id, p)""")
        if n < 4:
            tables.append(f"""
u{n} AS (
  SELECT p, e, list(m ORDER BY j) AS m
  FROM (SELECT p, e, j, floor(sum(x) / count(*)) AS m
        FROM (SELECT p, best % 256 AS e, unnest(w) AS x, unnest(range(len(w))) AS j FROM a{n}) GROUP BY p, e, j)
  GROUP BY p, e),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m, c.c) AS c FROM c{n} c LEFT JOIN u{n} USING (p, e))""")
    return "WITH" + ",".join(tables) + """,
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM a4 GROUP BY vec_id),
book AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS j FROM c4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), book
"""


@query("op13_norm_of_sum_codes", _codes_sql())
def op13_norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    text = vector_codes.digest_text(books) if books else ""
    digest = hashlib.sha256(text.encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


RESAMPLE_SQL = r"""
WITH bits AS (
  SELECT v, list_reduce([v] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
  FROM (SELECT unnest(range(256)) AS v)),
shifts AS MATERIALIZED (SELECT list(r ORDER BY v) AS t FROM bits),
runs AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
features AS MATERIALIZED (
  SELECT kind, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM runs),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)),
                            lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM features), shifts),
hits AS MATERIALIZED (SELECT kind, id, bucket FROM features JOIN coded USING (f)),
counts AS (
  SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t
  FROM (SELECT unnest(range(10000)) AS b)
  LEFT JOIN (SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM hits GROUP BY bucket)
    ON b = bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM counts),
weights AS (
  SELECT id, count(*) AS n_features, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM hits JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM runs LEFT JOIN weights USING (id) WHERE kind = 'd'),
places AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank
FROM places
"""


@query("op11_target_resampling", RESAMPLE_SQL)
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.drop("n_words")


@query("op12_subsequence_toxicity")
def op12_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
