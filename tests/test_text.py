import pytest
from pyspark.sql import functions as F

from retinue.functions.text import clean_xml, first_sentence, ssplit, tokenize
from retinue.operators import text as X

DOC = "<doc>The ferry to Halm leaves at noon. It carries <b>forty</b> cars.</doc>"


def test_document_to_sentences(spark):
    df = spark.createDataFrame([(1, DOC)], "id int, text string")
    rows = X.explode_sentences(df).collect()
    assert [(r.id, r.pos, r.sentence) for r in rows] == [
        (1, 0, "The ferry to Halm leaves at noon."),
        (1, 1, "It carries forty cars."),
    ]


def test_clean_tokenize_split(spark):
    row = spark.createDataFrame([("<a>x,\n y</a>  é9! Yes?..  ok",)], "t string").select(
        clean_xml(F.col("t")).alias("c"), tokenize(F.col("t")).alias("w"), ssplit(F.col("t")).alias("s")
    ).first()
    assert row.c == "x, y é9! Yes?.. ok"
    assert row.w[-7:] == ["!", "Yes", "?", ".", ".", "ok"][-7:] or row.w[-6:] == ["!", "Yes", "?", ".", ".", "ok"]
    assert row.s[-2:] == ["Yes?..", "ok"]


@pytest.mark.parametrize("options", [{}, {"broadcast_words": 0, "row_key": "id"}])
def test_lookups(spark, options):
    df = spark.createDataFrame([(1, ["cats", "run", "cats"]), (2, []), (3, None)], "id int, tokens array<string>")
    lexicon = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("cats", "zzz")], "word string, value string")
    got = {r.id: r.lemmas for r in X.lemma(df, lexicon, **options).collect()}
    assert got == {1: ["cat", "run", "cat"], 2: [], 3: None}
    got = {r.id: r.pos for r in X.pos_tags(df, lexicon, **options).collect()}
    assert got == {1: ["cat", "NN", "cat"], 2: [], 3: None}
    got = {r.id: r.ner for r in X.ner_tags(df, lexicon, **options).collect()}
    assert got == {1: ["cat", "O", "cat"], 2: [], 3: None}


def test_large_lexicon_without_a_row_key(spark):
    df = spark.createDataFrame([(["a", "c"],), (["a", "c"],), (None,)], "tokens array<string>")
    lexicon = spark.createDataFrame([("a", "b")], "word string, value string")
    joined = X.lemma(df, lexicon, broadcast_words=0)
    assert joined.columns == ["tokens", "lemmas"]
    assert sorted(map(str, (r.lemmas for r in joined.collect()))) == ["None", "['b', 'c']", "['b', 'c']"]


@pytest.mark.parametrize("options", [{}, {"broadcast_words": 0, "row_key": "id"}])
def test_sentiment_of_the_first_sentence(spark, options):
    texts = ["A great great day. Awful.", "Awful!", "Nothing here", "Great awful", "bad day", "", "good bad bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = spark.createDataFrame([("great", 2), ("awful", -2), ("bad", -1), ("good", 1)], "word string, value int")
    got = [r.sentiment for r in X.sentiment(df, lexicon, **options).orderBy("id").collect()]
    assert got == [4, 0, 2, 2, 1, 2, 2]


def chains():
    def run(batch):
        return [[(t[:1], [(0, 1, t)])] for t in batch]

    return run


def prefixer(mark):
    def factory():
        return lambda batch: [mark + t for t in batch]

    return factory


def test_factories_of_one_name_do_not_share_a_model(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    for mark in ("x", "y"):
        assert X.annotate(df, "t", prefixer(mark), "string").first().annotation == mark + "ab"


def test_annotate_with_nested_results(spark):
    df = spark.createDataFrame([("ab",), ("cd",)], "t string")
    schema = "array<struct<head: string, mentions: array<struct<sent: int, start: int, mention: string>>>>"
    rows = X.annotate(df, "t", chains, schema, out="coref").collect()
    assert rows[1].coref[0].head == "c" and rows[1].coref[0].mentions[0].mention == "cd"


def test_first_sentence_is_the_first_of_the_split(spark):
    texts = ["  A b. C", " ", "", "...x", " . y", "\n\n Q?! R", "no end", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(first_sentence(F.col("t")).alias("f"), F.get(ssplit(F.col("t")), F.lit(0)).alias("s")).collect()
    assert [r.f for r in both] == [r.s for r in both]


def test_joined_lookup_sends_different_words_and_returns_what_was_found(spark):
    """a token that occurs often in its row, or is not in the lexicon, is not shuffled; the result is that of the lookup in the row."""
    rows = [(i, [f"w{j % 7}" for j in range(i)] + [None, "", "w0"]) for i in range(60)] + [(90, []), (91, None), (92, ["zz"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    lexicon = spark.createDataFrame([("w0", "x"), ("w3", None), ("w5", ""), ("far", "y")], "word string, value string")
    for default in (None, "D"):
        small = X.lookup_tokens(df, lexicon, "tokens", "out", default)
        large = X.lookup_tokens(df, lexicon, "tokens", "out", default, "id", broadcast_words=0)
        assert large.columns == small.columns
        assert sorted(map(tuple, large.collect()), key=repr) == sorted(map(tuple, small.collect()), key=repr)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "posexplode" not in plan
    nothing = X.lookup_tokens(df, lexicon.where("word = 'far'"), "tokens", "out", None, "id", broadcast_words=0)
    assert {r.id: r.out for r in nothing.collect()} == dict(rows)
