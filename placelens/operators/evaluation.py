"""Ground truth and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, stats
from ..functions.text import CONCEPTS
from . import grid

KS = (1, 5, 10, 20)
FLOOR_MODEL = "clip-vit-b-32-openai"


def concept_table(spark: SparkSession) -> DataFrame:
    """concept, feature_type (null without ground truth), ord: ground-truth concepts first. Twelve rows."""
    return spark.createDataFrame([(c, t, i) for i, (c, (t, _)) in enumerate(CONCEPTS.items())], "concept string, feature_type string, ord int")


def ground_truth(features: DataFrame, concepts: DataFrame, chips: DataFrame, ow: float, os: float, findable_only: bool) -> DataFrame:
    """concept, chip_location_id: places that hold a feature of the concept's type. Features of other types are left out.

    features: feature_id, type, findable_aerial (null counts as false), x, y.
    """
    if findable_only:
        features = features.filter(F.coalesce("findable_aerial", F.lit(False)))
    typed = features.join(F.broadcast(concepts.filter("feature_type is not null")), F.col("type") == F.col("feature_type"))  # at most one row a concept
    return grid.points_in_chips(typed.select("concept", "x", "y"), chips, ow, os).select("concept", "chip_location_id").distinct()


def metrics(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS, keys: tuple[str, ...] = ("config", "concept")) -> DataFrame:
    """keys, n_gt, k, hit, recall, mrr for each k up to the length of the list.

    hits: keys, chip_location_id, rank. Without ground truth all metrics are 0.
    """
    by = list(keys)
    sizes = truth.groupBy("concept").agg(F.count("*").alias("n_gt"))
    marked = hits.join(truth.withColumn("is_hit", F.lit(True)), ["concept", "chip_location_id"], "left").join(sizes, "concept", "left")
    found = F.coalesce("is_hit", F.lit(False))
    counts = [F.count_if(found & (F.col("rank") <= k)).alias(f"k{k}") for k in ks]
    per = marked.groupBy(*by).agg(F.max("rank").alias("returned"), F.max(F.coalesce("n_gt", F.lit(0))).alias("n_gt"), F.min(F.when(found, F.col("rank"))).alias("first"), *counts)
    rows = per.withColumn("e", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("n")) for k in ks]))).filter(F.col("e.k") <= F.col("returned"))
    n = F.col("e.n")
    return rows.select(
        *by, "n_gt", F.col("e.k").alias("k"), F.when(n > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(F.col("n_gt") > 0, n / F.col("n_gt")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def roll_up(table: DataFrame, by: list[str], ks: tuple[int, ...] = KS, missing_as_zero: bool = False) -> DataFrame:
    """by, k, hit, recall, mrr: means over concepts. ``missing_as_zero``: a k beyond a list's end counts as 0, not as absent."""
    if missing_as_zero:
        at = lambda c, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0.0)).alias(f"{c}_{k}")
        concepts = table.groupBy(*by, "concept").agg(F.max("mrr").alias("mrr"), *[at(c, k) for c in ("hit", "recall") for k in ks])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit_{k}").alias("hit"), F.col(f"recall_{k}").alias("recall")) for k in ks])).alias("e")
        table = concepts.select(*by, "mrr", each).select(*by, "mrr", "e.*")
    return table.groupBy(*by, "k").agg(F.avg("hit").alias("hit"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))


def findable_concepts(table: DataFrame) -> DataFrame:
    return table.groupBy("concept").agg(F.max("n_gt").alias("n_gt")).filter("n_gt > 0")


def best_config(table: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The config with the largest value; the first in ``order`` wins ties."""
    best = F.max_by(F.struct("config", value), F.struct(F.col(value), (-F.col(order)).alias("o")))
    return (table.groupBy(*by) if by else table.groupBy()).agg(best.alias("b")).select(*by, F.col("b.config").alias("config"), F.col(f"b.{value}").alias(value))


def random_baseline(sizes: DataFrame, n: int, ks: tuple[int, ...] = KS) -> DataFrame:
    """concept, k, hit, recall, mrr of a random ranking; sizes: concept, n_gt."""
    rows = sizes.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    g, total = F.col("n_gt"), F.lit(n)
    return rows.select("concept", "n_gt", "k", stats.random_hit(total, g, F.col("k")).alias("hit"), stats.random_recall(total, g, F.col("k")).alias("recall"), stats.random_mrr(total, g).alias("mrr"))


def random_sampled(sizes: DataFrame, n: int, k: int, trials: int, seed: int = 0) -> DataFrame:
    """concept, hit and recall at k, and mrr, as means over seeded random rankings of n places; sizes: concept, n_gt (at most n).

    A trial draws the ranks of the n_gt places alone, without the other places; trials are rows, so tasks share those of a concept.
    """

    def draw(batches):
        import zlib

        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for concept, g, t in zip(pdf["concept"], pdf["n_gt"], pdf["trial"], strict=True):
                ranks = np.random.default_rng([seed, zlib.crc32(str(concept).encode()), t]).choice(n, int(g), replace=False, shuffle=False) + 1
                found = int((ranks <= k).sum())
                rows.append((concept, float(found > 0), found / max(g, 1), 1.0 / ranks.min() if g else 0.0))
            yield pd.DataFrame(rows, columns=["concept", "hit", "recall", "mrr"])

    runs = sizes.select(F.col("concept").cast("string").alias("concept"), F.col("n_gt").cast("long").alias("n_gt"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    means = [F.avg(c).alias(c) for c in ("hit", "recall", "mrr")]
    return runs.mapInPandas(draw, "concept string, hit double, recall double, mrr double").groupBy("concept").agg(*means)


def is_floor(config: Column) -> Column:
    return F.startswith(config, F.lit(f"{FLOOR_MODEL}__"))


def is_not_floor(config: Column) -> Column:
    """Another model than the floor's; of an ensemble, any member."""
    members = F.split(F.get(F.split(F.regexp_replace(config, "^ensemble:", ""), "__"), F.lit(0)), "\\+")
    return F.exists(members, lambda m: m != FLOOR_MODEL)


def gate(table: DataFrame, random_hit10: float, anchor: str = "waterfall") -> DataFrame:
    """One row: the five checks, how many pass, and the verdict. table: config, concept, n_gt, k, hit, mrr (findable variant).

    Means and the fourth check are over concepts with ground truth in some config; a missing k counts as 0. ``table`` is read
    once. The anchor's check fails if it has no ground truth; an empty table passes the first and last check alone.
    """
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    per = table.groupBy("config", "concept").agg(F.max("n_gt").alias("n_gt"), at(10, "hit").alias("hit10"), at(1, "hit").alias("hit1"), at(1, "mrr").alias("mrr1"))
    w = Window.partitionBy("concept")
    findable = per.withColumns({"most": F.max("n_gt").over(w), "h": F.max("hit10").over(w)}).filter("most > 0")
    means = findable.groupBy("config").agg(
        (F.sum("hit10") / F.count("*")).alias("hit10"), (F.sum("mrr1") / F.count("*")).alias("mrr"),
        F.collect_set(F.struct("concept", "h")).alias("concepts"), F.max(F.when(F.col("concept") == anchor, F.col("hit1"))).alias("anchor1"),
    )
    configs = means.agg(
        F.max(F.coalesce("hit10", F.lit(0.0))).alias("best10"),
        F.max(F.when(is_not_floor(F.col("config")), F.col("mrr"))).alias("other"),
        F.max(F.when(is_floor(F.col("config")), F.col("mrr"))).alias("floor"),
        F.array_distinct(F.flatten(F.collect_list("concepts"))).alias("concepts"),  # as many as there are concepts with ground truth
        F.max("anchor1").alias("anchor1"),
    )
    one = configs.withColumns({"n_hit10": F.size(F.filter("concepts", lambda c: c["h"] == 1)).cast("long"), "n_findable": F.size("concepts").cast("long")})
    checks = {
        "ran": F.lit(True),
        "beats_random": F.coalesce(F.col("best10") > 5 * random_hit10, F.lit(False)),
        "anchor_first": F.coalesce(F.col("anchor1") == 1, F.lit(False)),
        "most_concepts": F.col("n_hit10") >= F.greatest(F.lit(1), F.rint(0.7 * F.col("n_findable")).cast("int")),
        "beats_floor": F.col("floor").isNull() | (F.coalesce("other", F.lit(0.0)) > F.col("floor")),
    }
    out = one.select("n_hit10", "n_findable", *[c.alias(n) for n, c in checks.items()])
    passed = sum((F.col(n).cast("int") for n in checks), F.lit(0))
    out = out.withColumn("n_passed", passed)
    return out.withColumn("verdict", F.when(F.col("n_passed") == 5, "GO").when((F.col("n_passed") >= 3) & F.col("anchor_first"), "ITERATE").otherwise("KILL candidate"))


def areas_meet(features: DataFrame, ring) -> DataFrame:
    """One row: whether all points lie in the polygon, boundary allowed."""
    return features.agg(F.every(geo.polygon_holds_point(ring, F.col("x"), F.col("y"))).alias("all_inside"), F.count("*").alias("n"))


def unmapped(hits: DataFrame, features: DataFrame, ow: float, os: float) -> DataFrame:
    """Hits whose box holds no known feature (an extension: new candidates only)."""
    boxes = hits.withColumn("row", F.floor((F.col("ymin") - os) / geo.STRIDE).cast("int")).withColumn("col", F.floor((F.col("xmin") - ow) / geo.STRIDE).cast("int"))
    known = grid.points_in_chips(features.select("x", "y"), boxes.select("row", "col", "chip_location_id", "xmin", "ymin", "xmax", "ymax"), ow, os)
    return hits.join(known.select("chip_location_id").distinct(), "chip_location_id", "left_anti")
