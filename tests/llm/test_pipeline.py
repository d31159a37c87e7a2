import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from retinue.llm import pii, quality  # noqa: E402
from retinue.session import materialise  # noqa: E402
from tests.llm.test_dedup import plain_exact, plain_near  # noqa: E402
from tests.llm.test_models import plain_base  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    given = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]

    good = stages["quality"](spark, docs, SF).cache()
    texts = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and not any(plain_base(t)[1] for t in texts.values())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.quality_rules(docs, model).filter("kept").collect()
    assert {r.doc_id for r in rows} == set(texts)
    fine = {r.doc_id for r in labels.filter("quality = 1").collect()}
    clean = {i for i in fine if not plain_base(given[i])[1]}
    assert len(clean & set(texts)) > 0.97 * len(clean)

    single = stages["exact_dedup"](spark, good, SF).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == [i for i, _, _, kept, _ in plain_exact(list(texts.items())) if kept]

    apart = stages["near_dedup"](spark, single, SF).cache()
    left = [(r.doc_id, r.text) for r in single.collect()]
    assert apart.columns == columns
    assert sorted(r.doc_id for r in apart.collect()) == [i for i, _, _, kept in plain_near(left) if kept]

    clean = stages["pii"](spark, apart, SF).cache()
    model = pii.train(apart)
    assert clean.schema == apart.schema
    before = {r.doc_id: r.text for r in apart.collect()}
    for r in clean.collect():
        assert r.text == pii.redact(before[r.doc_id], pii.find_spans([before[r.doc_id]], model)[0][1]) and not pii.base_spans(r.text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, clean, SF).withColumn("n", F.octet_length("ids") / 4).cache()
    sizes = {r.doc_id: r.total for r in pieces.groupBy("doc_id").agg(F.sum("n").alias("total")).collect()}
    assert sizes == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    assert pieces.filter("n <> length OR length + offset > 2048").isEmpty()


def test_copies_are_decided_by_row(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near = [(None, f"{long} more"), (None, f"{long} more end"), (8, f"{long} end"), (8, "quite another text about one thing")]
    values = [(5, "A"), (5, "B"), (3, "B"), (None, "C"), (None, "C"), (7, "D"), (7, "D"), (None, "E"), (2, "E"), (4, ""), (None, None)]
    docs = spark.createDataFrame(values + near, "doc_id long, text string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    single = stages["exact_dedup"](spark, docs, SF)
    want = [(5, "A"), (3, "B"), (None, "C"), (7, "D"), (2, "E"), (4, "")]
    assert single.columns == docs.columns and sorted(map(str, map(tuple, single.collect()))) == sorted(map(str, want + near))
    apart = stages["near_dedup"](spark, single, SF)
    assert apart.columns == docs.columns and sorted(map(str, map(tuple, apart.collect()))) == sorted(map(str, want + near[2:]))
    # Texts in full, which no exact stage has thinned.
    same = spark.createDataFrame([(None, long), (None, long), (6, long), (6, f"{long} x"), (1, "")], "doc_id long, text string")
    left = [tuple(r) for r in stages["near_dedup"](spark, same, SF).collect()]
    assert len(left) == 2 and (1, "") in left and {i for i, _ in left} == {1, 6}


CLASHING = ["_row_number", "_slot", "_n", "_salt", "_pieces", "keep_row", "component_id", "node", "mark", "code", "digest"]


def stages_of(spark, docs):
    """What each stage but the last keeps, and the pieces of the last."""
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        kept.append(docs)
    return kept


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.withColumns({name: F.concat(F.lit(f"{name} "), "doc_id") for name in CLASHING})
    kept = stages_of(spark, docs)
    for rows in kept[:-1]:
        assert rows.columns == docs.columns and rows.count() > 0
        assert rows.filter(" OR ".join(f"`{name}` <> concat('{name} ', doc_id)" for name in CLASHING)).isEmpty()
    assert kept[-1].count() > 0


def test_nulls_and_empty_tables_go_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [rows.count() for rows in stages_of(spark, docs.limit(0))] == [0] * 5
    nulls = docs.limit(6).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    good = docs.filter("length(text) > 400").limit(30)
    mixed = good.unionByName(nulls).unionByName(good.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")))
    kept = stages_of(spark, mixed)
    texts = [r.text for r in kept[1].collect()]
    assert len(texts) == len(set(texts)) and None not in texts
    assert 0 < kept[2].count() <= kept[1].count() and kept[4].filter("length IS NULL").isEmpty()
    # Of a null and a given id the given one stays.
    assert kept[1].filter("doc_id IS NULL").isEmpty()


def test_run_is_the_stages_one_after_the_other(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
