"""The overlapping grid of chips, and the chip index built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text


def origin_and_dims(bounds: DataFrame, stride: int = geo.STRIDE) -> DataFrame:
    """ow, os, n_rows, n_cols for each row of ``bounds`` (west, south, east, north)."""
    ow, os = geo.snap_down(F.col("west"), stride), geo.snap_down(F.col("south"), stride)
    return bounds.select(ow.alias("ow"), os.alias("os"), geo.cells(F.col("north") - os, stride).alias("n_rows"), geo.cells(F.col("east") - ow, stride).alias("n_cols"))


def build(spark: SparkSession, bounds: tuple[float, float, float, float], size: int = geo.SIZE, stride: int = geo.STRIDE) -> DataFrame:
    """Every chip of the grid, row by row: ids, box and centre. Cells are generated where they are used."""
    o = origin_and_dims(spark.createDataFrame([bounds], "west double, south double, east double, north double"), stride).first()
    cells = spark.range(o["n_rows"] * o["n_cols"])
    row, col = F.expr(f"cast(id div {o['n_cols']} as int)"), (F.col("id") % o["n_cols"]).cast("int")
    grid = cells.select(row.alias("row"), col.alias("col"), F.col("id").alias("loc_idx"))
    return boxed(grid, o["ow"], o["os"], size, stride).withColumn("chip_location_id", text.location_id(F.col("row"), F.col("col")))


def build_all(bounds: DataFrame, key: str, size: int = geo.SIZE, stride: int = geo.STRIDE) -> DataFrame:
    """``build`` for every row of ``bounds`` (key, west, south, east, north): rows of a grid are listed first, cells where they are."""
    ow, os = geo.snap_down(F.col("west"), stride), geo.snap_down(F.col("south"), stride)
    dims = bounds.select(key, ow.alias("ow"), os.alias("os"), geo.cells(F.col("north") - os, stride).alias("n_rows"), geo.cells(F.col("east") - ow, stride).alias("n_cols"))
    rows = dims.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    cells = cells.withColumn("loc_idx", F.col("row").cast("long") * F.col("n_cols") + F.col("col")).withColumn("chip_location_id", text.location_id(F.col("row"), F.col("col")))
    return boxed(cells, F.col("ow"), F.col("os"), size, stride).drop("ow", "os", "n_rows", "n_cols")


def boxed(grid: DataFrame, ow, os, size: float = geo.SIZE, stride: float = geo.STRIDE) -> DataFrame:
    """Box and centre of each row and col of a grid with its origin at ``ow``, ``os`` (numbers or Columns)."""
    xmin, ymin = (F.lit(ow) + F.col("col") * stride).cast("double"), (F.lit(os) + F.col("row") * stride).cast("double")
    return grid.withColumns({"xmin": xmin, "ymin": ymin, "xmax": xmin + size, "ymax": ymin + size, "cx": xmin + size / 2, "cy": ymin + size / 2})


def per_cycle(grid: DataFrame, cycles: list[str], aoi: list[tuple[float, float]]) -> DataFrame:
    """Chips of every cycle (``schemas.CHIPS``). What does not depend on the cycle is computed once a cell."""
    lon, lat = geo.to_degrees(F.col("cx"), F.col("cy"))
    inside = geo.polygon_holds_box(aoi, F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    cells = grid.withColumns({"lon": lon, "lat": lat, "inside_aoi": inside})
    out = cells.withColumn("cycle", F.explode(F.array(*map(F.lit, cycles))))
    return out.withColumn("chip_id", text.chip_id(F.col("cycle"), F.col("row"), F.col("col")))


def points_in_chips_theta(points: DataFrame, chips: DataFrame) -> DataFrame:
    """Half-open containment as a plain theta join."""
    return points.join(chips, geo.box_holds(F.col("x"), F.col("y"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def points_in_chips(points: DataFrame, chips: DataFrame, ow: float, os: float, size: float = geo.SIZE, stride: float = geo.STRIDE) -> DataFrame:
    """The same rows by an equi-join: a point can only lie in ``ceil(size / stride)`` cells an axis, which are listed and joined."""
    reach = -(-int(size) // int(stride))
    cell = lambda c, o: F.floor((F.col(c) - o) / stride).cast("int")
    listed = points.withColumn("row", F.explode(F.sequence(cell("y", os) - (reach - 1), cell("y", os)))).withColumn("col", F.explode(F.sequence(cell("x", ow) - (reach - 1), cell("x", ow))))
    met = listed.join(chips, ["row", "col"])
    return met.filter(geo.box_holds(F.col("x"), F.col("y"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def primary_chip(points: DataFrame, chips: DataFrame, ow: float, os: float, key: str, strict: bool = False) -> DataFrame:
    """The chip with the nearest centre among those that hold the point (ties: row, col); ``strict``: no chip is an error."""
    met = points_in_chips(points, chips, ow, os)
    d2 = (F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")) + (F.col("cy") - F.col("y")) * (F.col("cy") - F.col("y"))
    best = met.groupBy(key).agg(F.min_by(F.struct("row", "col", "chip_location_id", d2.alias("d2")), F.struct(d2, "row", "col")).alias("b")).select(key, "b.*")
    if strict and not points.join(best, key, "left_anti").isEmpty():
        raise ValueError("a point lies in no chip")
    return best


def eval_lookup(primary: DataFrame, cycles: list[str], key: str) -> DataFrame:
    """key, cycle, chip_id: the primary chip of each feature in each cycle."""
    out = primary.withColumn("cycle", F.explode(F.array(*map(F.lit, cycles))))
    return out.select(key, "cycle", text.chip_id(F.col("cycle"), F.col("row"), F.col("col")).alias("chip_id"))


def overview_pixel(x, y, left, top, pixel):
    """World to raster row and column, row 0 in the north."""
    return F.floor((top - y) / pixel).cast("int"), F.floor((x - left) / pixel).cast("int")


def pick_cycles(years: DataFrame, n: int) -> DataFrame:
    """At most n of the years (column ``year``), spread over time: latest; first and last; or those and evenly stepped inner ones."""
    w = Window.orderBy("year")  # a handful of rows: one a cycle
    distinct = years.select("year").distinct()
    total = distinct.count()
    placed = distinct.withColumn("i", F.row_number().over(w) - 1)
    if total <= n:
        wanted = range(total)
    elif n == 1:
        wanted = [total - 1]
    else:
        inner, left = total - 2, n - 2
        step = max(1, inner // (left + 1))
        wanted = {0, total - 1, *(1 + min(inner - 1, i * step) for i in range(1, left + 1))}
    return placed.filter(F.col("i").isin(*wanted)).select("year") if n > 0 and total else placed.filter("false").select("year")


def latest_cycle(chips: DataFrame, cycle: str = "cycle") -> DataFrame:
    return chips.agg(F.max(cycle).alias("latest_cycle"))
