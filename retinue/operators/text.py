"""Token annotators as lexicon lookups, sentence rows, and user models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retinue.functions.text import clean_xml, first_sentence, ssplit, tokenize
from retinue.operators.spread import slot_filter, unused
from retinue.session import materialise

#: A lexicon of at most this many words and bytes is sent to the tasks.
BROADCAST_WORDS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
#: Copies of a larger lexicon, so that a frequent word is spread over as many tasks.
WORD_SALTS = 32


def explode_sentences(df: DataFrame, text: str = "text", out: str = "sentence") -> DataFrame:
    """Cleaned text, one row per sentence, with its position."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(ssplit(clean_xml(F.col(text)))).alias("pos", out))


def lookup_tokens(
    df: DataFrame,
    lexicon: DataFrame,
    tokens: str,
    out: str,
    default=None,
    row_key: str | None = None,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """``array`` column ``out``: the ``lexicon<word, value>`` entry of each token.

    An unknown token gets ``default``, or itself if ``default`` is None. A
    lexicon whose words and bytes were counted is looked up inside the row,
    without a shuffle; a larger one is joined, with the same result. ``row_key``
    may name a column that identifies the rows; else they are numbered.
    """
    words = _unique_words(lexicon)
    bytes_of = F.octet_length("word") + F.coalesce(F.octet_length("value"), F.lit(0))
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    if n <= broadcast_words and size <= BROADCAST_BYTES:
        return _lookup_in_row(df, words.toArrow(), tokens, out, default)
    if row_key is not None:
        return _lookup_by_join(df, words, tokens, out, default, row_key)
    # Written, so that the numbers stay the same on both sides of the join.
    numbered = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return _lookup_by_join(numbered, words, tokens, out, default, "_row").drop("_row")


def _unique_words(lexicon: DataFrame) -> DataFrame:
    """One value per word; the least one if the lexicon has several."""
    return lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.min("value").alias("value"))


def _lookup_in_row(df, head, tokens, out, default):
    shared = df.sparkSession.sparkContext.broadcast(head)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def lookup(lists: pa.Array) -> pa.Array:
        known = shared.value
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=known.column("word").combine_chunks())
        values = known.column("value").combine_chunks().take(at)
        values = pc.coalesce(values, flat if default is None else pa.scalar(default, pa.string()))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())

    return df.withColumn(out, lookup(F.col(tokens)))


def _lookup_by_join(df, words, tokens, out, default, row_key):
    """Of a row only its different words that the lexicon may have travel, and only the entries found come back."""
    each = df.select(row_key, F.explode(F.array_distinct(tokens)).alias("word"))
    each = slot_filter(each, "word", words).withColumn("salt", F.pmod(F.xxhash64(row_key), F.lit(WORD_SALTS)).cast("int"))
    copies = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))))
    found = each.join(copies, ["word", "salt"])
    entries = unused(df.columns, "_entries")
    # A group is one row's own words, which that row already held.
    lists = found.groupBy(row_key).agg(F.collect_list(F.struct("word", "value")).alias(entries))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def lookup(lists: pa.Array, own: pa.Array) -> pa.Array:
        flat, known = lists.flatten(), own.flatten()
        coded = flat.dictionary_encode()
        n = max(1, len(coded.dictionary))
        lengths, counts = (pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False) for a in (lists, own))
        # A word of a row is one number: every row has entries of its own.
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        asked = np.repeat(np.arange(len(lists)), lengths) * n + codes
        code_of = pc.index_in(pc.struct_field(known, "word"), value_set=coded.dictionary).to_numpy(zero_copy_only=False)
        held = np.repeat(np.arange(len(own)), counts) * n + code_of.astype(np.int64)
        order = np.argsort(held)
        at = np.minimum(np.searchsorted(held[order], asked), max(0, len(held) - 1))
        hit = (held[order][at] == asked) & (codes >= 0) if len(held) else np.zeros(len(asked), bool)
        places = order[at] if len(held) else np.zeros(len(asked), np.int64)
        values = pc.struct_field(known, "value").take(pa.array(places, mask=~hit))
        values = pc.coalesce(values, flat if default is None else pa.scalar(default, pa.string()))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())

    return df.join(lists, row_key, "left").withColumn(out, lookup(F.col(tokens), F.col(entries))).drop(entries)


def lemma(df: DataFrame, lexicon: DataFrame, tokens: str = "tokens", out: str = "lemmas", **options) -> DataFrame:
    """Base form of each token; unknown ones stay as they are."""
    return lookup_tokens(df, lexicon, tokens, out, None, **options)


def pos_tags(
    df: DataFrame, lexicon: DataFrame, tokens: str = "tokens", out: str = "pos", default: str = "NN", **options
) -> DataFrame:
    """Part-of-speech tag of each token."""
    return lookup_tokens(df, lexicon, tokens, out, default, **options)


def ner_tags(
    df: DataFrame, gazetteer: DataFrame, tokens: str = "tokens", out: str = "ner", **options
) -> DataFrame:
    """Entity tag of each token, ``O`` for none."""
    return lookup_tokens(df, gazetteer, tokens, out, "O", **options)


def sentiment(
    df: DataFrame, lexicon: DataFrame, text: str = "text", out: str = "sentiment", **options
) -> DataFrame:
    """Class 0 (very negative) .. 4 (very positive) of the first sentence.

    ``lexicon<word, value>`` holds whole scores from -2 to 2 by lower-case word;
    the class is 2 plus the mean score, rounded half up. Without any scored
    word the class is 2.
    """
    words = F.transform(tokenize(first_sentence(F.col(text))), lambda t: F.lower(t))
    words = F.coalesce(words, F.array().cast("array<string>"))
    scores = lexicon.select("word", F.col("value").cast("string").alias("value"))
    found = lookup_tokens(df.withColumn("_words", words), scores, "_words", "_scores", "", **options)
    known = F.filter(F.transform("_scores", lambda s: s.try_cast("int")), lambda s: s.isNotNull())
    found = found.withColumn("_known", known)
    total = F.aggregate("_known", F.lit(0), lambda a, s: a + s)
    # floor(2 + total / n + 1/2) in whole numbers
    score = F.floor((2 * total + 5 * F.size("_known")) / (2 * F.size("_known")))
    value = F.when(F.size("_known") > 0, F.least(F.greatest(score, F.lit(0)), F.lit(4))).otherwise(F.lit(2))
    return found.withColumn(out, value.cast("int")).drop("_words", "_scores", "_known")


_MODELS: dict[str, object] = {}


def _model_once(name: str, factory: Callable[[], object]):
    """The model of this worker process, built at its first use."""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def annotate(
    df: DataFrame,
    col: str,
    factory: Callable[[], Callable[[pd.Series], object]],
    schema: str | T.DataType,
    out: str = "annotation",
    name: str | None = None,
) -> DataFrame:
    """Column ``out`` of type ``schema`` from a user model applied to batches of ``col``.

    ``factory`` runs once per worker process and returns a function from a
    batch (Series) to a Series or list of as many results; nested results are
    lists of dicts or tuples matching ``schema``. The factory is shipped, the
    model never.
    """
    # Two factories share a model only if they are the same code and closure.
    once = name or hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    kind = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema

    nested = isinstance(kind, T.StructType)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model_once(once, factory)
        for batch in batches:
            found = list(model(batch))
            yield pd.DataFrame(found, columns=kind.names) if nested else pd.Series(found)

    return df.withColumn(out, run(F.col(col)))
