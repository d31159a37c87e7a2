"""Codebook, histogram and similarity queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retinue.functions.arrays import concat_features, reshape_rows
from retinue.operators import codebook, similarity
from retinue.plans import derived
from retinue.plans.derived import CENTERS_SQL, HISTOGRAM_SQL, PAIRS_SQL
from retinue.plans.registry import query, table
from retinue.session import materialise, shared_dir

#: A few hundredths of the pairs are as near as this.
RADIUS = 4


def text_of(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``<image_name, histogram>``, kept because it is both queries and gallery."""
    centers = materialise(derived.centers(spark, sf_dir), "centers")
    assigned = codebook.assign(derived.descriptors(spark, sf_dir), centers)
    n = centers.count()
    return codebook.histogram(assigned, n).persist(StorageLevel.MEMORY_AND_DISK)


def top_k(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    images = gallery(spark, sf_dir)
    return similarity.top_k_similar(images, images, k)


@query("top_k_similar", f"WITH {PAIRS_SQL} SELECT query, rank, match, distance FROM ranked WHERE rank <= 10")
def top_k_similar(spark, sf_dir):
    return top_k(spark, sf_dir)


@query(
    "top_k_similar_tiled", f"WITH {PAIRS_SQL} SELECT query, rank, match, distance FROM ranked WHERE rank <= 10"
)
def top_k_similar_tiled(spark, sf_dir):
    """The form that a query set over the broadcast bound takes."""
    images = gallery(spark, sf_dir)
    return similarity.top_k_similar(images, images, 10, broadcast_queries=0)


FLOAT_SQL = """
WITH values AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
distances AS (
  SELECT a.vec_id AS query, b.vec_id AS match, sum((a.x - b.x) * (a.x - b.x)) AS distance
  FROM values a JOIN values b ON a.pos = b.pos WHERE a.vec_id % 20 = 0 GROUP BY ALL)
SELECT query, match, CAST(rank AS INTEGER) AS rank, round(distance, 9) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), match) AS rank FROM distances) WHERE rank <= 5"""


@query("top_k_float", FLOAT_SQL)
def top_k_float(spark, sf_dir):
    """Raw embeddings: every twentieth one against all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    found = similarity.top_k_similar(rows.where("vec_id % 20 = 0"), rows, 5, key="vec_id", vector="vector")
    return found.select("query", "match", "rank", F.round("distance", 9).alias("distance"))


@query("nearest_image", f"WITH {PAIRS_SQL} SELECT query, match, distance FROM ranked WHERE rank = 1")
def nearest_image(spark, sf_dir):
    images = gallery(spark, sf_dir)
    return similarity.nearest(images, images)


@query(
    "all_matches",
    f"""WITH {PAIRS_SQL},
    vectors AS (SELECT image_name, list(cnt ORDER BY cluster) AS h FROM cells GROUP BY image_name),
    heads AS (SELECT min(image_name) AS match, count(*) AS copies FROM vectors GROUP BY h)
    SELECT p.query, p.distance, p.match, h.copies
    FROM pairs p JOIN heads h ON p.match = h.match WHERE p.distance <= {RADIUS}""",
)
def all_matches(spark, sf_dir):
    images = gallery(spark, sf_dir)
    return similarity.all_matches(images, images, RADIUS)


@query("pairwise_distance", f"WITH {PAIRS_SQL} SELECT query, match, distance FROM ranked WHERE rank <= 10")
def pairwise_distance(spark, sf_dir):
    images = gallery(spark, sf_dir)
    pairs = similarity.top_k_similar(images, images, 10).select("query", "match")
    return similarity.pairwise_distance(pairs, images, images)


WIDE_SQL = ", ".join(
    f"max(CASE WHEN rank = {i} THEN match || '#' || CAST(distance AS VARCHAR) END) AS image_{i}" for i in range(1, 11)
)


@query("write_matches_wide", f"WITH {PAIRS_SQL} SELECT query, {WIDE_SQL} FROM ranked WHERE rank <= 10 GROUP BY query")
def write_matches_wide(spark, sf_dir):
    path = shared_dir(spark, "matches")
    similarity.matches_wide(top_k(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "expand_matches",
    f"""WITH {PAIRS_SQL},
    found AS (SELECT query, rank, match, distance FROM ranked WHERE rank <= 10
              UNION ALL SELECT image_name, 0, image_name, NULL FROM cells GROUP BY image_name)
    SELECT f.query, f.rank, f.match, f.distance, i.content
    FROM found f LEFT JOIN (SELECT image_name, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY cluster) AS content
                            FROM cells GROUP BY image_name) i ON i.image_name = f.match""",
)
def expand_matches(spark, sf_dir):
    images = gallery(spark, sf_dir)
    wide = similarity.matches_wide(similarity.top_k_similar(images, images, 10))
    stored = images.select("image_name", text_of(F.col("histogram")).alias("content"))
    return similarity.expand_matches(wide, stored)


@query("assign_fixed_codebook", f"WITH {CENTERS_SQL} SELECT vec_id, image_name, cluster FROM assigned")
def assign_fixed_codebook(spark, sf_dir):
    found = codebook.assign(derived.descriptors(spark, sf_dir), derived.centers(spark, sf_dir))
    return found.select("vec_id", "image_name", "cluster")


IMAGE_HISTOGRAM_SQL = f"""WITH {HISTOGRAM_SQL}
SELECT image_name, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY cluster) AS histogram FROM cells GROUP BY image_name"""


@query("image_histogram", IMAGE_HISTOGRAM_SQL)
def image_histogram(spark, sf_dir):
    centers = derived.centers(spark, sf_dir)
    rows = codebook.explode_descriptors(derived.images(spark, sf_dir), "features")
    counted = codebook.histogram(codebook.assign(rows, centers), centers.count())
    return counted.select("image_name", text_of(F.col("histogram")).alias("histogram"))


@query("histogram_job", IMAGE_HISTOGRAM_SQL)
def histogram_job(spark, sf_dir):
    found = codebook.histogram_job(derived.images(spark, sf_dir), "features", derived.centers(spark, sf_dir))
    return found.select("image_name", text_of(F.col("histogram")).alias("histogram"))


def trained_facts(found: DataFrame, centers: DataFrame, limit: float = float("inf")) -> DataFrame:
    """What any good codebook fulfils: ``found`` is ``<vector, cluster>`` of all rows, ``limit`` a cost to stay below."""
    rows = sorted((r.center_id, list(r.center)) for r in centers.collect())  # as few as were trained

    def apart(center):
        return F.aggregate(F.zip_with("vector", F.array(*map(F.lit, center)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)

    distances = found.select("cluster", F.array(*(apart(center) for _, center in rows)).alias("d"))
    own = distances.select(F.array_min("d").alias("least"), F.get("d", F.col("cluster")).alias("own"))
    nearest = F.coalesce(F.min(F.col("own") <= F.col("least") * (1 + 1e-9) + 1e-9), F.lit(False))
    facts = own.agg(F.count("*").alias("n_rows"), nearest.alias("all_nearest"), F.sum("own").alias("cost"))
    n = F.lit(len(rows)).cast("long").alias("n_centers")
    return facts.select("n_rows", n, "all_nearest", (F.col("cost") <= F.lit(limit)).alias("cost_below"))


@query(
    "train_codebook",
    "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_centers, true AS all_nearest, true AS cost_below, true AS reloaded FROM embeddings",
)
def train_codebook(spark, sf_dir):
    """Train, save, load and assign; the cost is held against that of the overall mean."""
    rows = derived.descriptors(spark, sf_dir)
    path = shared_dir(spark, "codebook")
    model = codebook.train_codebook(rows, 8, max_iter=30, runs=3)
    codebook.save_codebook(model, path)
    centers = codebook.centers_table(spark, codebook.load_codebook(path))
    same = centers.exceptAll(codebook.centers_table(spark, model)).isEmpty()
    found = codebook.assign(rows, centers).select(F.col("descriptor").cast("array<double>").alias("vector"), "cluster")
    # The sum of squares less that of the mean, value by value.
    values = found.select(F.posexplode("vector").alias("pos", "v")).groupBy("pos").agg((F.var_pop("v") * F.count("v")).alias("cost"))
    limit = values.agg(F.sum("cost")).first()[0]
    return trained_facts(found, centers, limit).withColumn("reloaded", F.lit(same))


@query(
    "cluster_table",
    "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_centers, true AS all_nearest, true AS cost_below FROM customer",
)
def cluster_table(spark, sf_dir):
    """Customers by balance and nation; the cost is held against that of the overall mean."""
    cols = ["c_acctbal", "c_nationkey"]
    model, found = codebook.cluster_table(table(spark, sf_dir, "customer"), cols, 8, runs=1)
    found = found.select(F.array(*(F.col(c).cast("double") for c in cols)).alias("vector"), *cols, "cluster")
    spread = sum((F.var_pop(F.col(c).cast("double")) * F.count(c) for c in cols[1:]), F.var_pop(F.col(cols[0]).cast("double")) * F.count(cols[0]))
    limit = found.agg(spread).first()[0]
    return trained_facts(found.select("vector", "cluster"), codebook.centers_table(spark, model), limit)


@query(
    "assign_held_out",
    """SELECT label % 2 = 1 AS held_out, count(*) AS n_rows, true AS all_nearest FROM embeddings GROUP BY 1""",
)
def assign_held_out(spark, sf_dir):
    """A codebook trained on the even labels assigns the odd ones too."""
    rows = derived.descriptors(spark, sf_dir).withColumn("held_out", F.col("label") % 2 == 1)
    model = codebook.train_codebook(rows.where("NOT held_out"), 6, runs=1)
    centers = codebook.centers_table(spark, model)
    found = codebook.assign(rows, centers).select("held_out", F.col("descriptor").cast("array<double>").alias("vector"), "cluster")
    parts = [trained_facts(found.where(F.col("held_out") == side), centers).withColumn("held_out", F.lit(side)) for side in (True, False)]
    return parts[0].union(parts[1]).select("held_out", "n_rows", "all_nearest")


@query(
    "reshape_rows",
    """SELECT vec_id, unnest(range(0, len(embedding) // 6)) AS pos,
              unnest(list_transform(range(0, len(embedding) // 6), lambda i: embedding[i * 6 + 1])) AS first,
              unnest(list_transform(range(0, len(embedding) // 6), lambda i: embedding[i * 6 + 6])) AS last
       FROM embeddings""",
)
def reshape(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(reshape_rows(F.col("embedding"), 6)).alias("pos", "row")
    )
    return rows.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.col("row")[0].alias("first"), F.col("row")[5].alias("last")
    )


@query(
    "concat_features",
    """SELECT vec_id, CAST(CASE WHEN label % 2 = 0 THEN 64 ELSE 32 END AS INTEGER) AS n,
              CASE WHEN label % 2 = 0 THEN embedding[33] ELSE embedding[1] END AS head, embedding[32] AS tail
       FROM embeddings""",
)
def concat(spark, sf_dir):
    """Upper half (missing for odd labels) in front of the lower half."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("label") % 2 == 0, reshape_rows(F.slice("embedding", 33, 32), 1)).alias("sift"),
        reshape_rows(F.slice("embedding", 1, 32), 1).alias("harris"),
    )
    both = rows.select("vec_id", concat_features(F.col("sift"), F.col("harris")).alias("f"))
    return both.select(
        "vec_id", F.size("f").alias("n"), F.col("f")[0][0].alias("head"), F.element_at("f", -1)[0].alias("tail")
    )
