"""Near-duplicates by MinHash bands, with odd sketches that sift candidates before the exact check.

Every text becomes the set of its distinct five-word shingles. MinHash samples
of the set are used twice: in bands, whose equality makes two texts candidates,
and folded into a parity bitmap, the odd sketch. The exclusive or of two
sketches holds the samples that differ, so its population count tells how many
these are; only pairs that pass are compared on their full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retinue.llm.components import components
from retinue.llm.spread import slot_filter, spread_join
from retinue.llm.words import WordHashes, finish, fold, lower_words, shingles, small_batches
from retinue.session import materialise

#: Of two texts at the threshold of 0.75, all BANDS differ with a probability of 3e-7.
BANDS = 56
ROWS = 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: A pair whose sketches tell less similarity than this is not linked: six and a
#: half standard deviations of the estimate below the threshold.
RULED_OUT = 0.5
#: Sets linked when PERCENT_OF_UNION * union <= 100 * intersection.
PERCENT_OF_UNION = 75
#: Groups of fewer nodes are described against one of them, larger ones against what most of them hold.
LARGE = 16
#: Shingles handled at once, so that the sample matrix stays in the cache.
BLOCK = 512

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = (_RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_SHIFTS = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_MARKS = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_BAND_MARKS = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set of 64-bit hashes."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), BLOCK):
        table = _FACTORS * short[start : start + BLOCK]
        table += _SHIFTS
        np.minimum(least, table.min(axis=1), out=least)
    return least.astype(np.uint64)


def band_keys(taken: np.ndarray) -> np.ndarray:
    grid = taken.reshape(BANDS, ROWS)
    return fold([_BAND_MARKS, *grid.T])


def odd_sketch(taken: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    place = finish(taken ^ _MARKS) % np.uint64(SKETCH_BITS)
    parity = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_different_bits(similarity: float) -> int:
    """Differing sketch bits expected of two sets of this similarity."""
    differing = 2 * SAMPLES * (1 - similarity)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64, copy=False)))


def _sets(batch: pa.RecordBatch, known: WordHashes) -> list[np.ndarray]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return [shingles(known.of(lower_words(text))) for text in texts]


def _sign(batches):
    known = WordHashes()
    none = np.empty(0, np.int64)
    for batch in batches:
        sizes, marks, bands, sketches = [], [], [], []
        for found in _sets(batch, known):
            sizes.append(len(found))
            # Equal sets have equal marks: their size and two independent sums.
            sums = np.array([len(found), finish(found).sum(), finish(found ^ _MARKS[0]).sum()], np.uint64)
            marks.append(sums.tobytes())
            taken = samples(found) if len(found) else none
            bands.append(band_keys(taken).view(np.int64) if len(found) else none)
            sketches.append(odd_sketch(taken) if len(found) else none)
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), _lists(bands), _lists(sketches)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "mark", "bands", "sketch"])


def _shingle_rows(batches):
    known = WordHashes()
    for batch in batches:
        found = [row.view(np.int64) for row in _sets(batch, known)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(found)], ["node", "shingles"])


def signatures(docs: DataFrame) -> DataFrame:
    """``<doc_id, n_shingles, mark, bands, sketch>`` of every row; ``mark`` stands for the whole set."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_shingles long, mark binary, bands array<long>, sketch array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, schema)


def _differing(a: str, b: str):
    words = SKETCH_BITS // 64
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, words)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _attach(pairs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``column`` of both ends of the pairs ``<a, b>``."""
    for side in ("a", "b"):
        own = found.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))
        pairs = spread_join(pairs, own, side, ["a", "b"])
    return pairs


def _close(pairs: DataFrame, least: float):
    """Whether the sketches of a pair tell at least this similarity."""
    return _differing("sketch_a", "sketch_b") <= most_different_bits(least)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``<a, b, common, sizes>`` of pairs, from their full sets."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).alias("common")
    sizes = (F.size("shingles_a") + F.size("shingles_b")).alias("sizes")
    return _attach(pairs, sets, "shingles").select("a", "b", common, sizes)


def _linked(common, sizes):
    """Whether sets with ``common`` elements and together ``sizes`` are similar enough."""
    return 100 * common >= PERCENT_OF_UNION * (sizes - common)


def _described(members: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """``<g, node, label, n, lacking, more>`` of the members ``<g, node, label, centre>`` of groups.

    The group's model is a set of ``n`` shingles: what most members hold, or the
    set of a centre in small groups. ``lacking`` is what a node lacks of it,
    ``more`` what it holds besides.
    """
    held = materialise(spread_join(members, sets, "node", ["g"]), "near-held")
    large = sizes.filter(F.col("_n") >= LARGE)
    rows = spread_join(held.select("g", "node", "shingles"), large.select("g", F.col("_n").alias("of")), "g", ["node"], sizes=large)
    counts = rows.select("g", "of", F.explode("shingles").alias("shingle")).groupBy("g", "shingle").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
    most = counts.filter(2 * F.col("n") > F.col("of")).groupBy("g").agg(F.collect_list("shingle").alias("model"))
    small = held.join(sizes.filter(F.col("_n") < LARGE).select("g"), "g", "left_semi")
    own = small.filter("centre").groupBy("g").agg(F.min_by("shingles", "node").alias("model"))
    models = materialise(most.union(own), "near-models")
    known = spread_join(held, models, "g", ["node"], "left", sizes=sizes)
    model = F.coalesce("model", F.array().cast("array<long>"))
    lacking, more = F.array_except(model, "shingles"), F.array_except("shingles", model)
    return known.select("g", "node", "label", F.size(model).alias("n"), lacking.alias("lacking"), more.alias("more"))


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``<a, b>`` that join all members of a group that are linked, directly or over others.

    ``members`` is ``<g, node, label, centre>``: nodes of each group, the labels
    they have already (that of the centres is ``g``), and whether a node is a
    centre. Only groups with several labels and three nodes or more are looked
    at. Members are described by what they lack of, and hold beyond, a model of
    ``n`` shingles. Let two members share ``l`` lacking and ``m`` additional
    shingles; with ``cost = 4 * lacking + 3 * more`` they are linked when

        7 * (l + m) >= cost + cost' - n.

    * Where nothing need be shared, both are linked with the member of least
      cost too, so each is compared with that alone.
    * A pair that shares additional shingles shares as many as make up for what
      either lacks, so the rarest ones of each, all but as many as it needs
      less one, have one in common.
    * A pair that shares none has ``l`` alone. Few members can be linked so; of
      those the rarest lacking shingles have one in common.

    Only pairs with a member outside the centres' component are compared.
    Members with the same shared differences and costs have the same links and
    are one fold: it is compared once, however many copies with one edit it holds.
    """
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = materialise(sizes.filter("low <> high AND _n > 2").select("g", "_n"), "near-sizes")
    mixed = materialise(spread_join(members, sizes.select("g"), "g", ["node"], sizes=sizes), "near-mixed")
    described = _described(mixed, sizes, sets)
    described = described.withColumns({"few": F.size("lacking"), "many": F.size("more")})
    described = described.withColumn("cost", 4 * F.col("few") + 3 * F.col("many")).withColumn("size", F.col("n") - F.col("few") + F.col("many"))
    described = materialise(described, "near-described")

    outside = F.col("label") != F.col("g")
    stats = described.groupBy("g").agg(
        F.min(F.struct("cost", "node", "label")).alias("hub"),
        F.min("cost").alias("least"),
        F.min(F.when(outside, F.col("cost"))).alias("least_outside"),
        F.min("size").alias("smallest"),
        F.min(F.when(outside, F.col("size"))).alias("smallest_outside"),
    )
    stats = materialise(stats.select("*", "hub.node", F.col("hub.label").alias("hub_label")).drop("hub").withColumnRenamed("node", "hub"), "near-stats")
    known = spread_join(described, stats, "g", ["node"], sizes=sizes)
    free = known.filter("cost + least <= n AND label <> hub_label").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    free = materialise(free, "near-free")

    parts = [F.struct(F.lit(kind == "more").alias("is_more"), F.col(kind).alias("found")) for kind in ("lacking", "more")]
    carried = ["g", "label", "n", "few", "cost", "size"]
    rows = described.select("node", *carried, F.explode(F.array(*parts)).alias("part")).select("node", *carried, "part.is_more", F.explode("part.found").alias("shingle"))
    rows = rows.withColumn("k", F.xxhash64("g", "shingle")).drop("shingle")
    shared = materialise(rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "near-shared")
    rows = spread_join(rows, shared.select("k", F.col("_n").alias("held")), "k", ["node"], sizes=shared)

    def rarest(which: str) -> Column:
        listed = F.collect_list(F.when(F.expr(which), F.struct("held", "k")))
        return F.transform(F.sort_array(listed), lambda s: s["k"])

    firsts = [F.first(c).alias(c) for c in carried if c != "g"]
    folded = rows.groupBy("g", "node").agg(*firsts, rarest("NOT is_more").alias("lacks"), rarest("is_more").alias("adds"))
    marks = [F.xxhash64(F.lit(n), "lacks", "adds") for n in (0, 1)]
    folded = materialise(folded.withColumn("fold", F.struct("g", "cost", "few", *marks)), "near-folded")
    folds = folded.groupBy("fold").agg(
        *[F.first(c).alias(c) for c in ("g", "n", "few", "cost", "size", "lacks", "adds")],
        F.min("node").alias("first"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("_n"),
    )
    folds = spread_join(folds, stats.select("g", "least", "least_outside", "smallest", "smallest_outside"), "g", ["fold"])
    folds = folds.withColumn("outside", F.expr("low <> g OR high <> g"))
    # What a partner has at least; that of a member of the centres' component lies outside.
    partner_cost, partner_size = F.expr("if(outside, least, least_outside)"), F.expr("if(outside, smallest, smallest_outside)")
    owed = F.ceil(3 * (F.col("size") + partner_size) / 7) - (F.col("n") - F.col("few"))
    folds = folds.withColumn("owed", owed.cast("int")).withColumn("needed", F.ceil((F.col("cost") + partner_cost - F.col("n")) / 7).cast("int"))
    folds = folds.select("fold", "g", "n", "cost", "lacks", "adds", "first", "low", "high", "_n", "outside", "owed", "needed")
    folds = materialise(folds, "near-folds")

    def front(keys: str, needed: Column) -> Column:
        return F.slice(keys, 1, F.greatest(F.lit(0), F.size(keys) - F.greatest(F.lit(1), needed) + 1))

    none = F.array().cast("array<long>")
    alone = F.when(F.col("owed") <= 0, front("lacks", F.col("needed"))).otherwise(none)
    fronts = F.explode(F.concat(front("adds", F.col("owed")), alone)).alias("k")
    sides = materialise(folds.select("fold", "outside", "low", "high", fronts), "near-fronts")
    lists = materialise(sides.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("outside").alias("outside")), "near-lists")
    lists = lists.filter("outside AND _n > 1").select("k", "_n")
    right = spread_join(sides, lists.select("k"), "k", ["fold"], sizes=lists)
    left = right.filter("outside").select("k", *(F.col(c).alias(f"{c}_a") for c in ("fold", "low", "high")))
    pairs = spread_join(right, left, "k", ["fold"], sizes=lists)
    same = (F.col("low") == F.col("high")) & (F.col("low_a") == F.col("high_a")) & (F.col("low") == F.col("low_a"))
    pairs = pairs.filter((F.col("fold") != F.col("fold_a")) & ~same)
    pairs = pairs.select(F.least("fold", "fold_a").alias("a"), F.greatest("fold", "fold_a").alias("b")).distinct()
    for side in ("a", "b"):
        own = folds.select(F.col("fold").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "cost", "lacks", "adds", "first")))
        pairs = spread_join(materialise(pairs, "near-fold-pairs"), own, side, ["a", "b"])
    overlap = sum(F.size(F.array_intersect(f"{c}_a", f"{c}_b")) for c in ("lacks", "adds"))
    pairs = pairs.filter(7 * overlap >= F.col("cost_a") + F.col("cost_b") - F.col("n_a"))
    pairs = materialise(pairs.select("a", "b", "first_a", "first_b"), "near-fold-links")

    # A fold of several nodes is joined when its nodes are linked, or all are with those of another fold.
    inner = (7 * (F.size("lacks") + F.size("adds")) >= 2 * F.col("cost") - F.col("n")).alias("inner")
    several = folds.filter("_n > 1 AND low <> high").select("fold", "first", "_n", inner)
    met = pairs.select(F.col("a").alias("fold")).union(pairs.select("b")).distinct()
    met = several.join(met, "fold", "left_semi").union(several.filter("inner")).distinct()
    within = spread_join(folded.select("fold", F.col("node").alias("a")), met.select("fold", F.col("first").alias("b")), "fold", ["a"], sizes=met.select("fold", "_n"))
    links = free.union(pairs.select("first_a", "first_b")).union(within.select("a", "b"))
    return links.filter("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``<doc_id, n_shingles, component_id, kept>``, one row for every row of ``docs``.

    Two texts are linked when the intersection of their shingle sets holds at
    least 75 hundredths of the union; ``component_id`` is the smallest
    ``doc_id`` reachable over links. Only ``doc_id`` and ``text`` are read.

    Texts with equal sets form a class, and classes are what is linked. In each
    band bucket all classes are first compared with one of them, the class that
    shares most buckets. Classes that shared a bucket but are still in different
    components are then compared by what they lack of, and add to, the shingles
    that most of their group hold. That is exact, and takes few pairs even in
    groups of thousands: see :func:`_across`.

    * Null text, empty text and text without words have an empty set and are linked with nothing.
    * A null ``doc_id`` is linked with nothing, has a null ``component_id`` and is kept.
    * Rows that repeat a ``doc_id`` are one document, linked by any of its texts; each row keeps its own ``n_shingles``.
    * An empty table gives an empty result.
    """
    signed = materialise(signatures(docs), "near-signatures")
    n = signed.count()
    filled = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("mark").agg(F.min("doc_id").alias("class_id"))
    classed = spread_join(signed, classes, "mark", ["doc_id"], "left", total=n)
    first = F.col("doc_id") == F.col("class_id")
    own_class = F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    classed = classed.select(
        "doc_id", "n_shingles", own_class, F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("sketch")).alias("sketch")
    )
    classed = materialise(classed, "near-classes")
    leaders = classed.filter("bands IS NOT NULL").withColumnRenamed("class_id", "node")

    rows = leaders.select("node", F.explode("bands").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "near-buckets")
    # A class has one key per band, so no key holds more than one part in BANDS of the rows.
    members = rows.join(shared, "key")
    members = materialise(members, "near-members")
    degrees = members.groupBy("node").agg(F.sum(F.col("_n") - 1).alias("degree"))
    degrees = materialise(degrees, "near-degrees")
    members = materialise(members.join(degrees, "node"), "near-members")
    sketches = materialise(leaders.select("node", "sketch").join(degrees.select("node"), "node", "left_semi"), "near-sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    sets = slot_filter(texts, "node", degrees).mapInArrow(_shingle_rows, "node long, shingles array<long>")
    sets = materialise(sets.join(degrees.select("node"), "node", "left_semi"), "near-sets")

    # Each bucket against its class of highest degree, the centre of a star.
    centre = F.max(F.struct("degree", F.bitwise_not("node").alias("other"))).alias("top")
    centres = members.groupBy("key").agg(centre).select("key", F.bitwise_not("top.other").alias("b"))
    pairs = spread_join(members, centres, "key", ["node"], sizes=shared).filter("node <> b")
    pairs = materialise(pairs.select(F.col("node").alias("a"), "b").distinct(), "near-pairs")
    sifted = _attach(pairs, sketches, "sketch")
    sifted = materialise(sifted.filter(_close(sifted, RULED_OUT)).select("a", "b"), "near-sifted")
    measured = materialise(_measured(sifted, sets), "near-measured")
    links = measured.filter(_linked(F.col("common"), F.col("sizes"))).select("a", "b")
    # Texts under one id are one document.
    held = classed.filter("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("high"))
    held = materialise(held.filter("b <> high"), "near-repeated")
    repeated = classed.join(held, "doc_id").select(F.col("class_id").alias("a"), "b").filter("a <> b")
    links = materialise(links.union(repeated), "near-links")

    # Stars of one component make one group; what it still holds in different components is compared across them.
    labels = components(links)
    stars = pairs.union(pairs.select("b", "b").distinct()).toDF("node", "centre")
    for end, label in (("node", "label"), ("centre", "g")):
        stars = spread_join(stars, labels.select(F.col("node").alias(end), F.col("label").alias(label)), end, ["node", "centre"], "left")
        stars = stars.withColumn(label, F.coalesce(label, end))
    members = stars.groupBy("g", "node").agg(F.first("label").alias("label"), F.max(F.col("node") == F.col("centre")).alias("centre"))
    across = materialise(_across(materialise(members, "near-groups"), sets), "near-links")
    if not across.isEmpty():
        labels = components(links.union(across))

    found = classed.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("node"))
    found = spread_join(found, labels, "node", ["doc_id"], "left", total=n)
    component = F.coalesce("label", "node")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
