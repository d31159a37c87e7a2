"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from retinue.operators import counts
from retinue.operators import graph as G
from retinue.operators import similarity as S
from retinue.operators.codebook import quantise
from retinue.plans.logs import log_lines
from retinue.session import bucketed, spread
from retinue.sinks.cells import upsert_cells
from retinue.sources.tables import scan_cells

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def images(spark, folder):
    rows = [(f"i{n}", [n % 3, n % 5, 1]) for n in range(40)]
    spark.createDataFrame(rows, "image_name string, histogram array<int>").write.parquet(folder + "/h")
    return spark.read.parquet(folder + "/h")


def test_top_k_is_cut_before_its_only_shuffle(images):
    plan = plan_of(S.top_k_similar(images, images, 3))
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1


def test_tiles_are_not_pairs(images):
    plan = plan_of(S.top_k_similar(images, images, 3, broadcast_queries=0))
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_histograms_need_no_shuffle(spark, images, folder):
    features = images.select("image_name", F.array(F.col("histogram").cast("array<float>")).alias("f"))
    centers = spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [2.0, 2.0, 1.0])], "center_id int, center array<double>")
    assert "Exchange" not in plan_of(quantise(features, centers, "f"))


def test_scan_reads_the_asked_columns_and_pushes_the_filter(images):
    plan = plan_of(scan_cells(images, ["histogram"]))
    assert "PushedFilters: [IsNotNull(histogram)]" in plan
    assert "ReadSchema: struct<histogram" in plan_of(images.select("histogram"))


def test_few_updates_do_not_shuffle_the_base(spark, images):
    news = spark.createDataFrame([("i1", [9, 9, 9])], "image_name string, histogram array<int>")
    plan = plan_of(upsert_cells(images, news))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_log_counts_use_one_scan_and_one_shuffle(spark):
    plan = plan_of(counts.log_counts(log_lines(spark, SF_DIR)))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in plan


def test_a_rank_round_does_not_shuffle_the_edges(spark, folder):
    edges = spark.range(200).select((F.col("id") % 7).alias("src"), F.col("id").alias("dst"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, degrees = G._out_edges(edges)
        ranks = degrees.select(F.col("src").alias("id"), "degree", "salts", F.lit(1.0).alias("rank"), F.lit(1.0).alias("gain"))
        with bucketed(rows, "plan-test", "src", "salt") as weighted:
            plan = plan_of(G._rank_round(ranks, weighted, 0.1, 0.15))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "plan_test" in line)
    assert "Bucketed: true" in lines[scan]
    above = lines[:scan][::-1]
    depth = lines[scan].index("FileScan")
    for line in above:  # climb from the scan to its join
        at = len(line) - len(line.lstrip(" :+-"))
        if at < depth:
            depth = at
            assert "Exchange" not in line
            if "Join" in line:
                break


def test_a_large_scan_is_left_alone(spark, images):
    assert spread(images).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


def test_edges_are_placed_by_one_shuffle_and_no_round_sorts_them(spark):
    """pagerank; F6, F8 take the same steps."""
    edges = spark.range(300).select((F.col("id") % 7).alias("src"), F.col("id").alias("dst"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, degrees = G._out_edges(edges)
        laid_out = plan_of(rows)
        ranks = degrees.select(F.col("src").alias("id"), "degree", "salts", F.lit(1.0).alias("rank"), F.lit(1.0).alias("gain"))
        with bucketed(rows, "sort-test", "src", "salt") as weighted:
            a_round = plan_of(G._rank_round(ranks, weighted, 0.1, 0.15))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert laid_out.count("Exchange") == 1 and "Join" not in laid_out
    assert "Sort " not in a_round and "SortMergeJoin" not in a_round and a_round.count("ShuffledHashJoin") == 2
