"""Raster arithmetic over long tables of pixels: band, row, col, value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


#: Value ranges that a round of ``percentiles`` counts for each key and rank.
BINS = 1024
#: Keys up to this number are sent to all tasks; more are joined by a shuffle.
SENT_KEYS = 100_000


def _sent(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.count() <= SENT_KEYS else few


def percentiles(values: DataFrame, keys: list[str], shares: list[float], value: str = "value") -> DataFrame:
    """keys and ``p``: exact percentiles, interpolated between the two neighbours in order; null, NaN and infinite values take no part.

    Each wanted rank is a range of values that holds it. A round counts the values of each range in ``BINS`` parts and keeps the part
    with the rank, from its least to its largest value; it ends when the two are equal. So no task holds more than the counts,
    however many distinct values there are; rounds follow from how far values spread, two or three for pixels.
    """
    v = F.col(value).cast("double")
    held = values.select(*keys, v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    facts = held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(i).alias("share"), F.lit(j).alias("side"), edge(at(p)).cast("long").alias("rank")) for i, p in enumerate(shares) for j, edge in enumerate((F.floor, F.ceil))])
    # rank counts from 0 within the range lo..hi
    todo = _written(facts.select(*keys, "lo", "hi", F.explode(wanted).alias("w")).select(*keys, "w.share", "w.side", "w.rank", "lo", "hi"))
    done = todo.filter("lo = hi").select(*keys, "share", "side", F.col("lo").alias("x"))
    todo = todo.filter("lo < hi")
    while not todo.isEmpty():
        ranges = todo.select(*keys, "lo", "hi").distinct()  # floor and ceiling of a share mostly lie in one range
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1)).cast("int")
        counts = held.join(_sent(ranges), keys).filter("v BETWEEN lo AND hi").groupBy(*keys, "lo", "hi", part.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows a range
        met = todo.join(counts.withColumn("before", before), [*keys, "lo", "hi"]).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        now = _written(met.select(*keys, "share", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        done = done.unionByName(now.filter("lo = hi").select(*keys, "share", "side", F.col("lo").alias("x")))
        todo = now.filter("lo < hi")
    near = done.groupBy(*keys, "share").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("x1"))
    share = F.element_at(F.array(*[F.lit(float(p)) for p in shares]), F.col("share") + 1) * (F.col("n") - 1)
    mixed = near.join(facts.select(*keys, "n"), keys).withColumn("p", F.col("x0") + (share - F.floor(share)) * (F.col("x1") - F.col("x0")))
    return mixed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "p"))), lambda s: s["p"]).alias("p"))


def _written(few: DataFrame) -> DataFrame:
    """Ranges of one round, in the shared folder: a row for each key, share and side."""
    path = f"{scratch(few.sparkSession)}/placelens-ranges-{uuid.uuid4().hex}"
    few.write.parquet(path)
    return few.sparkSession.read.schema(few.schema).parquet(path)


def stretch(pixels: DataFrame, keys: list[str], value: str = "value", skip_zeros: bool = False) -> DataFrame:
    """``stretched``: each band's 2nd to 98th percentile mapped to 0..255 and cut to whole numbers.

    A band without spread keeps its values, or becomes 0 with ``skip_zeros`` (which also leaves zeros out of the percentiles).
    """
    v = F.col(value).cast("double")
    cut = percentiles(pixels.filter(v > 0) if skip_zeros else pixels, keys, [0.02, 0.98], value)
    limits = cut.select(*keys, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    scaled = F.floor(F.least(F.greatest((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, F.lit(0.0)), F.lit(255.0)))
    flat = F.lit(0) if skip_zeros else F.floor(v)
    met = pixels.join(_sent(limits), keys, "left").withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(1.0))})
    return met.withColumn("stretched", F.when(F.col("hi") <= F.col("lo"), flat).otherwise(scaled).cast("int")).drop("lo", "hi")


def block_average(pixels: DataFrame, factor: int, keys: list[str], value: str = "value") -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / factor).alias(c)
    return pixels.groupBy(*keys, cell("row"), cell("col")).agg(F.avg(value).alias(value))


def sample(points: DataFrame, pixels: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """All bands at each point; nulls for a point outside the raster. Row 0 is in the north."""
    at = points.withColumn("row", F.floor((F.lit(top) - F.col("y")) / size).cast("int")).withColumn("col", F.floor((F.col("x") - left) / size).cast("int"))
    return at.join(pixels, ["row", "col"], "left")


def nodata_fraction(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg((F.col(value) == 0).cast("double")).alias("nodata"))


def check_raster(meta: DataFrame, bands: int, dtype: str, area: list, pixel: float | None = None, slack_pixels: int = 1) -> DataFrame:
    """``ok``: bands, type, pixel size within 1e-6, and the box covers the area but for ``slack_pixels``.

    meta: n_bands, dtype, pixel, xmin, ymin, xmax, ymax.
    """
    slack = F.col("pixel") * slack_pixels
    w, s, e, n = (F.lit(float(a)) for a in area)
    fits = (F.col("xmin") <= w + slack) & (F.col("ymin") <= s + slack) & (F.col("xmax") >= e - slack) & (F.col("ymax") >= n - slack)
    right = (F.col("n_bands") == bands) & (F.col("dtype") == dtype)
    if pixel is not None:
        right = right & (F.abs(F.col("pixel") - pixel) <= 1e-6)
    return meta.withColumn("ok", F.coalesce(right & fits, F.lit(False)))


def check_epsg(meta: DataFrame, epsg: int = 26916) -> DataFrame:
    """The rows, or an error for one in another CRS."""
    wrong = F.raise_error(F.concat(F.lit("not in the working CRS: EPSG:"), F.coalesce(F.col("epsg").cast("string"), F.lit("none"))))
    return meta.withColumn("epsg", F.when(F.col("epsg") == epsg, F.col("epsg")).otherwise(wrong.cast("int")))
