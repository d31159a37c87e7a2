"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retinue.functions import text as X
from retinue.operators import text as O
from retinue.plans.registry import query, table
from retinue.session import spread

SPACE = r"'^\s+|\s+$'"
TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}\s]', 0)"
SENTENCES = (
    "list_filter(list_transform(regexp_extract_all({0}, '[^.!?]+[.!?]*|[.!?]+', 0), "
    f"lambda s: regexp_replace(s, {SPACE}, '', 'g')), lambda s: s <> '')"
)
CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
BREAK = "\x1f"


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))


def joined(array, name):
    return F.array_join(array, BREAK).alias(name)


@query("clean_xml", f"SELECT page_id, {CLEAN.format('html')} AS text FROM pages")
def clean_xml(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.clean_xml(F.col("text")).alias("text"))


@query("tokenize", f"SELECT doc_id, array_to_string({TOKENS.format('text')}, chr(31)) AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(X.tokenize(F.col("text")), "tokens"))


@query("ssplit", f"SELECT doc_id, array_to_string({SENTENCES.format('text')}, chr(31)) AS sentences FROM documents")
def ssplit(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", joined(X.ssplit(F.col("text")), "sentences"))


@query(
    "explode_sentences",
    f"""SELECT page_id, CAST(unnest(range(0, len(s))) AS INTEGER) AS pos, unnest(s) AS sentence
        FROM (SELECT page_id, {SENTENCES.format(CLEAN.format('html'))} AS s FROM pages)""",
)
def explode_sentences(spark, sf_dir):
    return O.explode_sentences(pages(spark, sf_dir))


def tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "text", X.tokenize(F.col("text")).alias("tokens"))


def benchmark_words(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.explode(X.tokenize(F.col("text"))).alias("word"))
    return rows.distinct()


WORDS_SQL = f"words AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS word FROM benchmark)"


def lookup_sql(lexicon: str, fallback: str, name: str) -> str:
    return f"""WITH {WORDS_SQL}, lexicon AS ({lexicon}),
    each AS (SELECT doc_id, unnest(t) AS word, unnest(range(0, len(t))) AS pos
             FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents))
    SELECT d.doc_id, coalesce(v, '') AS {name} FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(coalesce(value, {fallback}), chr(31) ORDER BY pos) AS v
      FROM each LEFT JOIN lexicon USING (word) GROUP BY doc_id) USING (doc_id)"""


LEMMA_SQL = "SELECT word, left(word, length(word) - 1) AS value FROM words WHERE length(word) > 3 AND word LIKE '%s'"


def plural_lexicon(spark, sf_dir):
    words = benchmark_words(spark, sf_dir).where((F.length("word") > 3) & F.col("word").endswith("s"))
    return words.select("word", F.expr("left(word, length(word) - 1)").alias("value"))


@query("lemma", lookup_sql(LEMMA_SQL, "word", "lemmas"))
def lemma(spark, sf_dir):
    found = O.lemma(tokens(spark, sf_dir), plural_lexicon(spark, sf_dir))
    return found.select("doc_id", joined("lemmas", "lemmas"))


@query("lemma_large_lexicon", lookup_sql(LEMMA_SQL, "word", "lemmas"))
def lemma_large_lexicon(spark, sf_dir):
    """The form that a lexicon over the broadcast bound takes."""
    lexicon = plural_lexicon(spark, sf_dir)
    found = O.lemma(tokens(spark, sf_dir), lexicon, row_key="doc_id", broadcast_words=0)
    return found.select("doc_id", joined("lemmas", "lemmas"))


@query(
    "pos_tags",
    lookup_sql(
        """SELECT word, CASE WHEN word LIKE '%ly' THEN 'RB' WHEN word LIKE '%ing' THEN 'VBG'
                             WHEN word IN ('.', ',') THEN word END AS value
           FROM words WHERE word LIKE '%ly' OR word LIKE '%ing' OR word IN ('.', ',')""",
        "'NN'",
        "pos",
    ),
)
def pos_tags(spark, sf_dir):
    word = F.col("word")
    tag = F.when(word.endswith("ly"), "RB").when(word.endswith("ing"), "VBG").when(word.isin(".", ","), word)
    lexicon = benchmark_words(spark, sf_dir).select("word", tag.alias("value")).where(F.col("value").isNotNull())
    return O.pos_tags(tokens(spark, sf_dir), lexicon).select("doc_id", joined("pos", "pos"))


@query(
    "ner_tags",
    lookup_sql("SELECT word, 'MISC' AS value FROM words WHERE regexp_matches(word, '^[A-Z]')", "'O'", "ner"),
)
def ner_tags(spark, sf_dir):
    gazetteer = benchmark_words(spark, sf_dir).where(F.col("word").rlike("^[A-Z]")).select("word", F.lit("MISC").alias("value"))
    return O.ner_tags(tokens(spark, sf_dir), gazetteer).select("doc_id", joined("ner", "ner"))


@query(
    "sentiment",
    f"""WITH {WORDS_SQL},
    lexicon AS (SELECT DISTINCT lower(word) AS word, length(word) % 5 - 2 AS score FROM words WHERE length(word) > 2),
    firsts AS (SELECT doc_id, {SENTENCES.format('text')}[1] AS s FROM documents),
    each AS (SELECT doc_id, lower(unnest({TOKENS.format('s')})) AS word FROM firsts),
    means AS (SELECT doc_id, sum(score) AS total, count(score) AS n FROM each JOIN lexicon USING (word) GROUP BY doc_id)
    SELECT d.doc_id, CAST(CASE WHEN n > 0 THEN greatest(0, least(4, floor((2 * total + 5 * n) / (2.0 * n)))) ELSE 2 END AS INTEGER)
           AS sentiment
    FROM documents d LEFT JOIN means USING (doc_id)""",
)
def sentiment(spark, sf_dir):
    """Scores by word length, for want of a given sentiment lexicon."""
    words = benchmark_words(spark, sf_dir).where(F.length("word") > 2)
    lexicon = words.select(F.lower("word").alias("word"), (F.length("word") % 5 - 2).alias("value"))
    return O.sentiment(documents(spark, sf_dir), lexicon).select("doc_id", "sentiment")


def length_annotator():
    """A stand-in for a model: what it costs to build is paid once per worker."""

    def run(batch):
        return [{"n_chars": len(text), "first": text[:1]} for text in batch]

    return run


@query("annotate", "SELECT doc_id, length(text) AS n_chars, left(text, 1) AS first FROM documents")
def annotate(spark, sf_dir):
    found = O.annotate(documents(spark, sf_dir), "text", length_annotator, "struct<n_chars: long, first: string>")
    return found.select("doc_id", "annotation.n_chars", "annotation.first")
