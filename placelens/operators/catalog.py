"""Selection over catalog items and bookkeeping of manifests and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import winter_year

WINTER = (12, 1, 2, 3)


def usable_naip(items: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Items with a datetime whose box meets the area."""
    return items.filter(F.col("ts").isNotNull() & geo.boxes_meet(west, south, east, north))


def usable_winter(items: DataFrame, area: tuple[float, float, float, float], most_cloud: float = 20.0) -> DataFrame:
    """Little cloud, a winter month, and a box that covers the area; null boxes do not. Plain comparisons, so that sources can take them."""
    west, south, east, north = (float(v) for v in area)
    held = (F.col("xmin") <= west) & (F.col("ymin") <= south) & (F.col("xmax") >= east) & (F.col("ymax") >= north)
    return items.filter((F.col("cloud_cover") < float(most_cloud)) & F.month("ts").isin(*WINTER) & held)


def clearest_per_winter(items: DataFrame, n: int, zero_is_missing: bool = False) -> DataFrame:
    """The item of least cloud of each winter, of the n newest winters. Ties: earlier, then smaller id; null cloud comes last.

    ``zero_is_missing`` treats a cover of exactly 0 as 100, as some catalogs use 0 for unknown.
    """
    cloud = F.coalesce(F.nullif("cloud_cover", F.lit(0.0)) if zero_is_missing else F.col("cloud_cover"), F.lit(100.0))
    best = F.min_by(F.struct("item_id", "cloud_cover"), F.struct(cloud, "ts", "item_id"))
    per = items.groupBy(winter_year(F.col("ts")).alias("winter")).agg(best.alias("b"), F.count("*").alias("n_items"))
    return per.select("winter", F.col("b.item_id").alias("item_id"), F.col("b.cloud_cover").alias("cloud_cover"), "n_items").orderBy(F.desc("winter")).limit(n)


def year_counts(items: DataFrame, examples: int = 5) -> DataFrame:
    """year, n_items and the first item ids of each year, in order. The rank filter is pushed into the window, so that tasks keep only the first ids."""
    from pyspark.sql import Window

    year = F.date_format("ts", "yyyy").alias("year")
    counts = items.groupBy(year).agg(F.count("*").alias("n_items"))
    first = items.select(year, "item_id").withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy("item_id"))).filter(F.col("r") <= examples)
    lists = first.groupBy("year").agg(F.sort_array(F.collect_list("item_id")).alias("first_ids"))
    return counts.join(lists, "year")


def merge_manifest(picks: DataFrame, prior: DataFrame) -> DataFrame:
    """New picks with the assets and fetch time that the prior manifest has for them; an empty map counts as missing."""
    old = prior.select("item_id", F.col("assets").alias("old_assets"), F.col("fetched_at").alias("old_fetched_at"))
    kept = F.when(F.size("old_assets") > 0, F.col("old_assets")).otherwise(F.col("assets"))
    return picks.join(old, "item_id", "left").select("item_id", kept.alias("assets"), F.coalesce("old_fetched_at", "fetched_at").alias("fetched_at"))


def with_raster(hits: DataFrame, files: DataFrame, cycle: str = "winning_cycle") -> DataFrame:
    """The file of the winning cycle, else that of the latest cycle that has one."""
    latest = files.agg(F.max_by("path", "cycle").alias("latest_path"))  # one row
    met = hits.join(files.withColumnRenamed("cycle", cycle), cycle, "left").crossJoin(F.broadcast(latest))
    return met.withColumn("path", F.coalesce("path", "latest_path")).drop("latest_path")


def stale(cells: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of ``current`` that are absent, or differ in index, weights or tag (null equals null)."""
    marks = ["index_sha", "weights_sha", "tag"]
    on = [current[k] == cells[k] for k in keys] + [current[m].eqNullSafe(cells[m]) for m in marks]
    test = on[0]
    for t in on[1:]:
        test = test & t
    return current.join(cells, test, "left_anti")


def missing(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def mark_fetched(items: DataFrame) -> DataFrame:
    """Fetch times: now for fetched items; for skipped ones the file's time, only where none is known."""
    return items.withColumn("fetched_at", F.when(~F.col("skipped"), F.col("now")).otherwise(F.coalesce("fetched_at", "file_time"))).drop("now", "file_time", "skipped")
