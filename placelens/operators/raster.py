"""Rasters as tables of tiles: windowed reads, mosaics and reprojection.

A tile is a row: raster, band, tile_row, tile_col, height, width, data (little-endian numbers, row 0 in the north). Tables are
partitioned by raster, band and tile_row, so a window reads the strips it meets. ``meta`` has a row for each raster: raster, left,
top, pixel, height, width. 0 stands for no data.

A window lists the tiles it meets and joins them; a task assembles one window at a time. A mosaic or a reprojection works the other
way round for each block of the output: pixel centres are mapped back into each source, whose tiles around them are
joined, and sampled bilinearly over tile borders.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

TILES = "raster string, band int, tile_row int, tile_col int, height int, width int, data binary"
META = "raster string, `left` double, top double, pixel double, height int, width int"
#: Pixels of a window at most: it is assembled in one task.
MOST_PIXELS = 1 << 26
#: So many rows of ``meta`` are sent to all tasks; with more, rows meet them by a shuffle.
SENT = 500_000


def sent(meta: DataFrame) -> DataFrame:
    """``meta`` to be joined by raster: few rasters have many rows each, which a shuffle by raster would put into one task."""
    return F.broadcast(meta) if meta.limit(SENT + 1).count() <= SENT else meta


def cut(pixels: DataFrame, meta: DataFrame, side: int = 256, dtype: str = "<u2") -> DataFrame:
    """TILES of ``side`` pixels from rows raster, band, row, col, value; pixels without a row are 0, of repeated ones the largest stays.

    Tiles without a pixel are left out; pixels outside their raster go.
    """
    once = pixels.filter("row >= 0 AND col >= 0 AND value IS NOT NULL").groupBy("raster", "band", "row", "col").agg(F.max("value").alias("value"))
    inside = once.join(sent(meta.select("raster", "height", "width")), "raster").filter("row < height AND col < width")
    place = {f"tile_{c}": F.floor(F.col(c) / side).cast("int") for c in ("row", "col")}

    def block(key, table):
        raster, band, r, c = (k.as_py() for k in key)
        h, w = (min(side, table.column(n)[0].as_py() - t * side) for n, t in (("height", r), ("width", c)))
        out = np.zeros((h, w), dtype)
        out[table.column("row").to_numpy() - r * side, table.column("col").to_numpy() - c * side] = table.column("value").to_numpy()
        return pa.table([[raster], pa.array([band], pa.int32()), *(pa.array([v], pa.int32()) for v in (r, c, h, w)), pa.array([out.tobytes()], pa.binary())], names=[f.split()[0] for f in TILES.split(", ")])

    return inside.withColumns(place).groupBy("raster", "band", "tile_row", "tile_col").applyInArrow(block, TILES)


def write(tiles: DataFrame, folder: str) -> None:
    tiles.repartition("raster", "band", "tile_row").sortWithinPartitions("raster", "band", "tile_row", "tile_col").write.partitionBy("raster", "band", "tile_row").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TILES).parquet(folder)


def windows_of(boxes: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """key, raster, row0, col0, height, width of boxes (key, raster, xmin..ymax): offsets rounded down, lengths up, cut to the raster.

    A thousandth of a pixel is forgiven, as boxes on whole pixels miss them by rounding. Boxes that miss their raster go.
    """
    m = boxes.join(sent(meta.withColumnsRenamed({"height": "rows", "width": "cols"})), "raster")
    near = lambda c: F.round(c / F.col("pixel"), 3)
    r, c = F.floor(near(F.col("top") - F.col("ymax"))).cast("int"), F.floor(near(F.col("xmin") - F.col("left"))).cast("int")
    h, w = F.ceil(near(F.col("ymax") - F.col("ymin"))).cast("int"), F.ceil(near(F.col("xmax") - F.col("xmin"))).cast("int")
    row0, col0 = F.greatest(r, F.lit(0)), F.greatest(c, F.lit(0))
    height, width = F.least(r + h, F.col("rows")) - row0, F.least(c + w, F.col("cols")) - col0
    return m.select(key, "raster", row0.alias("row0"), col0.alias("col0"), height.alias("height"), width.alias("width")).filter("height > 0 AND width > 0")


def _steps(first: Column, length: Column, side: int) -> Column:
    return F.explode(F.sequence(F.floor(first / side).cast("int"), F.floor((first + length - 1) / side).cast("int")))


def paste(out: np.ndarray, row0: int, col0: int, tile: np.ndarray, r: int, c: int) -> None:
    """Copy what a tile at pixel (r, c) has of the window at (row0, col0)."""
    top, left = max(r, row0), max(c, col0)
    end, right = min(r + tile.shape[0], row0 + out.shape[0]), min(c + tile.shape[1], col0 + out.shape[1])
    if top < end and left < right:
        out[top - row0 : end - row0, left - col0 : right - col0] = tile[top - r : end - r, left - c : right - c]


def tiles_of(table: pa.Table, side: int, dtype: str):
    """(row, column, pixels) of the tiles of a group."""
    for r, c, h, w, data in zip(*(table.column(n).to_pylist() for n in ("tile_row", "tile_col", "height", "width", "data")), strict=True):
        yield r * side, c * side, np.frombuffer(data, dtype).reshape(h, w)


def read_windows(tiles: DataFrame, windows: DataFrame, key: str, bands: list[int] | None = None, side: int = 256, dtype: str = "<u2") -> DataFrame:
    """key, band, height, width, data of windows (key, raster, row0, col0, height, width); keys are distinct.

    Only strips of tiles between the first and last row of any window are read, and of those the rasters and bands asked for. Where
    the raster has no tile the window is 0; a window of a raster without tiles, or a band without any in it, gives no row.
    """
    kind = dict(windows.dtypes)[key]
    reach = windows.agg(F.min("row0").alias("a"), F.max(F.col("row0") + F.col("height") - 1).alias("b"), F.max(F.col("height").cast("long") * F.col("width")).alias("most")).first()
    if (reach["most"] or 0) > MOST_PIXELS:
        raise ValueError(f"a window has more than {MOST_PIXELS} pixels")
    tiles = tiles.filter(F.col("tile_row").between((reach["a"] or 0) // side, (reach["b"] or 0) // side))
    if bands is not None:
        tiles = tiles.filter(F.col("band").isin(*bands))
    w = windows.select(F.col(key).alias("__key"), "raster", "row0", "col0", F.col("height").alias("rows"), F.col("width").alias("cols"))
    met = w.withColumn("tile_row", _steps(F.col("row0"), F.col("rows"), side)).withColumn("tile_col", _steps(F.col("col0"), F.col("cols"), side)).join(tiles, ["raster", "tile_row", "tile_col"])

    def assemble(group, table):
        row0, col0, h, v = (table.column(n)[0].as_py() for n in ("row0", "col0", "rows", "cols"))
        out = np.zeros((h, v), dtype)
        for r, c, tile in tiles_of(table, side, dtype):
            paste(out, row0, col0, tile, r, c)
        return pa.table([table.column("__key").slice(0, 1), table.column("band").slice(0, 1), pa.array([h], pa.int32()), pa.array([v], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=[key, "band", "height", "width", "data"])

    return met.groupBy("__key", "band").applyInArrow(assemble, f"`{key}` {kind}, band int, height int, width int, data binary")


def values_of(windows: DataFrame, key: str, dtype: str = "<u2") -> DataFrame:
    """key, band, row, col, value: the pixels of windows in long form."""
    kind = dict(windows.dtypes)[key]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                v = np.frombuffer(b.column("data")[i].as_py(), dtype).reshape(b.column("height")[i].as_py(), b.column("width")[i].as_py())
                r, c = np.indices(v.shape, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(n).take(pa.array(np.full(v.size, i))) for n in (key, "band")] + [pa.array(r.ravel()), pa.array(c.ravel()), pa.array(v.ravel().astype(np.int64))], names=[key, "band", "row", "col", "value"])

    return windows.select(key, "band", "height", "width", "data").mapInArrow(run, f"`{key}` {kind}, band int, row int, col int, value long")


def pixels_of(tiles: DataFrame, side: int = 256, dtype: str = "<u2") -> DataFrame:
    """band, row, col, value of the pixels of tiles or blocks that are not 0, at their place in the raster or grid."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r0, c0, h, w = (b.column(n)[i].as_py() for n in ("tile_row", "tile_col", "height", "width"))
                v = np.frombuffer(b.column("data")[i].as_py(), dtype).reshape(h, w)
                r, c = np.nonzero(v)
                yield pa.RecordBatch.from_arrays([b.column("band").take(pa.array(np.full(len(r), i))), pa.array((r + r0 * side).astype(np.int32)), pa.array((c + c0 * side).astype(np.int32)), pa.array(v[r, c].astype(np.int64))], names=["band", "row", "col", "value"])

    return tiles.select("band", "tile_row", "tile_col", "height", "width", "data").mapInArrow(run, "band int, row int, col int, value long")


@dataclass(frozen=True)
class Crs:
    """Metres of a transverse Mercator zone with this central meridian on GRS80; None: degrees."""

    lon0: float | None = geo.LON0

    def to_degrees(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.lon0 is None:
            return x, y
        xi, eta = y / (geo.K0 * geo.RECTIFYING), (x - geo.EAST0) / (geo.K0 * geo.RECTIFYING)
        north, east = xi.copy(), eta.copy()
        for j, c in enumerate(geo.INVERSE, 1):
            north -= c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            east -= c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        target = np.sin(north) / np.sqrt(np.sinh(east) ** 2 + np.cos(north) ** 2)
        tau, e = target.copy(), geo.E1
        for _ in range(3):  # Newton steps on the tangent of the latitude
            s = np.sinh(e * np.arctanh(e * tau / np.sqrt(1 + tau * tau)))
            now = tau * np.sqrt(1 + s * s) - s * np.sqrt(1 + tau * tau)
            tau += (target - now) / np.sqrt(1 + now * now) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * np.sqrt(1 + tau * tau))
        return self.lon0 + np.degrees(np.arctan2(np.sinh(east), np.cos(north))), np.degrees(np.arctan(tau))

    def from_degrees(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.lon0 is None:
            return lon, lat
        phi, lam, e = np.radians(lat), np.radians(lon - self.lon0), geo.E1
        t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.sqrt(t * t + np.cos(lam) ** 2))
        north, east = xi.copy(), eta.copy()
        for j, c in enumerate(geo.FORWARD, 1):
            north += c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            east += c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        return geo.EAST0 + geo.K0 * geo.RECTIFYING * east, geo.K0 * geo.RECTIFYING * north

    def into(self, other: Crs, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (x, y) if self == other else other.from_degrees(*self.to_degrees(x, y))


@dataclass(frozen=True)
class Grid:
    """An output raster: its north-west corner, pixel size and shape, in a CRS, made in blocks of ``side`` pixels."""

    left: float
    top: float
    pixel: float
    height: int
    width: int
    side: int = 256
    crs: Crs = Crs()

    @staticmethod
    def around(bounds: tuple[float, float, float, float], pixel: float, side: int = 256, crs: Crs = Crs()) -> Grid:
        """The grid on whole multiples of the pixel size that covers west, south, east, north."""
        w, s, e, n = (f(v / pixel) for f, v in zip((math.floor, math.floor, math.ceil, math.ceil), bounds, strict=True))
        return Grid(w * pixel, n * pixel, pixel, n - s, e - w, side, crs)


def bilinear(source: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, valid) at fractional places, where whole numbers are pixel centres; 0 and what lies outside have no weight.

    A place is valid if it lies in the raster (half a pixel around the centres) and the pixel it lies in is not 0.
    """
    h, w = source.shape
    inside = (rows >= -0.5) & (rows < h - 0.5) & (cols >= -0.5) & (cols < w - 0.5)
    r, c = np.floor(rows).astype(np.int64), np.floor(cols).astype(np.int64)
    total, weight = np.zeros(rows.shape), np.zeros(rows.shape)
    for dr in (0, 1):
        for dc in (0, 1):
            y, x = r + dr, c + dc
            on = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            v = np.where(on, source[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 0).astype(np.float64)
            share = np.where(v != 0, np.abs(1 - dr - (rows - r)) * np.abs(1 - dc - (cols - c)), 0.0)
            total += share * v
            weight += share
    at = source[np.clip(np.floor(rows + 0.5).astype(np.int64), 0, h - 1), np.clip(np.floor(cols + 0.5).astype(np.int64), 0, w - 1)]
    valid = inside & (at != 0) & (weight > 0)
    return np.divide(total, weight, out=np.zeros(rows.shape), where=valid), valid


def _block(grid: Grid, r: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the pixels of a block of the grid."""
    rows = np.arange(r * grid.side, min((r + 1) * grid.side, grid.height))
    cols = np.arange(c * grid.side, min((c + 1) * grid.side, grid.width))
    x, y = np.meshgrid(grid.left + (cols + 0.5) * grid.pixel, grid.top - (rows + 0.5) * grid.pixel)
    return x, y


def mosaic(tiles: DataFrame, meta: DataFrame, grid: Grid, order: str = "raster", source: Crs = Crs(), bands: list[int] | None = None, side: int = 256, dtype: str = "<u2") -> DataFrame:
    """band, tile_row, tile_col, height, width, data: the blocks of the grid that some raster has a valid pixel for.

    meta: META and the column ``order``; where rasters overlap the first valid one wins (ties: the smaller name). Values are
    rounded to the nearest whole number. Sources share one CRS; each block gathers the source tiles under it, and no more.
    """
    if bands is not None:
        tiles = tiles.filter(F.col("band").isin(*bands))

    def blocks(batches):
        """Blocks of the grid under each raster, and the window of the raster that each needs."""
        for b in batches:
            out = []
            for m in b.to_pylist():
                t = np.linspace(0, 1, 65)
                edge = np.concatenate([np.stack(p) for p in ((t, 0 * t), (t, 0 * t + 1), (0 * t, t), (0 * t + 1, t))], axis=1)
                x, y = source.into(grid.crs, m["left"] + edge[0] * m["width"] * m["pixel"], m["top"] - edge[1] * m["height"] * m["pixel"])
                # A pixel more on all sides, as edges between the points may bend.
                r0, r1 = ((grid.top - v) / grid.pixel for v in (y.max(), y.min()))
                c0, c1 = ((v - grid.left) / grid.pixel for v in (x.min(), x.max()))
                for r in range(max(0, math.floor((r0 - 1) / grid.side)), min(-(-grid.height // grid.side), math.floor((r1 + 1) / grid.side) + 1)):
                    for c in range(max(0, math.floor((c0 - 1) / grid.side)), min(-(-grid.width // grid.side), math.floor((c1 + 1) / grid.side) + 1)):
                        sx, sy = grid.crs.into(source, *_block(grid, r, c))
                        rows, cols = (m["top"] - sy) / m["pixel"] - 0.5, (sx - m["left"]) / m["pixel"] - 0.5
                        top, left = max(0, math.floor(rows.min())), max(0, math.floor(cols.min()))
                        end, right = min(m["height"], math.floor(rows.max()) + 2), min(m["width"], math.floor(cols.max()) + 2)
                        if top < end and left < right:
                            out.append({"raster": m["raster"], "out_row": r, "out_col": c, "row0": top, "col0": left, "rows": end - top, "cols": right - left, "left": m["left"], "top": m["top"], "pixel": m["pixel"]})
            names = {"raster": pa.string(), **dict.fromkeys(("out_row", "out_col", "row0", "col0", "rows", "cols"), pa.int32()), **dict.fromkeys(("left", "top", "pixel"), pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in names.items()], names=list(names))

    wanted = meta.select("raster", "left", "top", "pixel", "height", "width").mapInArrow(blocks, "raster string, out_row int, out_col int, row0 int, col0 int, rows int, cols int, `left` double, top double, pixel double")
    wanted = wanted.withColumn("tile_row", _steps(F.col("row0"), F.col("rows"), side)).withColumn("tile_col", _steps(F.col("col0"), F.col("cols"), side))
    ranks = meta.select("raster", F.col(order).cast("string").alias("place") if order == "raster" else F.col(order).alias("place"))
    met = wanted.join(ranks, "raster").join(tiles, ["raster", "tile_row", "tile_col"])

    def fill(group, table):
        band, r, c = (k.as_py() for k in group)
        x, y = _block(grid, r, c)
        out, done = np.zeros(x.shape), np.zeros(x.shape, bool)
        sx, sy = grid.crs.into(source, x, y)
        names = table.column("raster").to_pylist()
        places = dict(zip(names, table.column("place").to_pylist(), strict=True))
        for raster in sorted(places, key=lambda n: (places[n] is None, 0 if places[n] is None else places[n], n)):
            own = table.filter(pa.array([n == raster for n in names]))
            row0, col0, h, w, left, top, pixel = (own.column(n)[0].as_py() for n in ("row0", "col0", "rows", "cols", "left", "top", "pixel"))
            held = np.zeros((h, w), dtype)
            for tr, tc, tile in tiles_of(own, side, dtype):
                paste(held, row0, col0, tile, tr, tc)
            v, valid = bilinear(held, (top - sy) / pixel - 0.5 - row0, (sx - left) / pixel - 0.5 - col0)
            out = np.where(valid & ~done, v, out)
            done |= valid
        if not done.any():
            return pa.table([pa.array([], pa.int32())] * 5 + [pa.array([], pa.binary())], names=["band", "tile_row", "tile_col", "height", "width", "data"])
        data = np.floor(out + 0.5).astype(dtype)
        return pa.table([pa.array([v], pa.int32()) for v in (band, r, c, *data.shape)] + [pa.array([data.tobytes()], pa.binary())], names=["band", "tile_row", "tile_col", "height", "width", "data"])

    return met.groupBy("band", "out_row", "out_col").applyInArrow(fill, "band int, tile_row int, tile_col int, height int, width int, data binary")
