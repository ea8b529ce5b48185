"""Tiles, windows, mosaics and reprojection against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import layout, raster

SIDE = 16


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """Two rasters of one pixel size that overlap, with holes, three bands each; the second lies east of the first."""
    rng = np.random.default_rng(2)
    arrays = {(n, b): np.where(rng.random((h, w)) < 0.1, 0, rng.integers(1, 4000, (h, w))) for n, h, w in (("a", 50, 70), ("b", 41, 60)) for b in (1, 2, 3)}
    rows = [(n, b, int(r), int(c), int(v[r, c])) for (n, b), v in arrays.items() for r, c in zip(*np.nonzero(v), strict=True)]
    meta = spark.createDataFrame([("a", 1000.0, 5000.0, 2.0, 50, 70), ("b", 1091.0, 4987.0, 2.0, 41, 60)], raster.META)
    pixels = spark.createDataFrame(rows, "raster string, band int, row int, col int, value int")
    folder = str(tmp_path_factory.mktemp("tiles") / "t")
    raster.write(raster.cut(pixels, meta, SIDE), folder)
    return arrays, meta, raster.read(spark, folder), pixels


def test_windows_are_slices(spark, scene):
    arrays, meta, tiles, _ = scene
    boxes = [(1, "a", 1000.0, 4990.0, 1010.0, 5000.0), (2, "a", 1027.0, 4921.0, 1069.5, 4961.3), (3, "a", 900.0, 4000.0, 1e4, 6e3), (4, "b", 1091.0, 4905.0, 1092.0, 4906.0), (5, "a", 0.0, 0.0, 10.0, 10.0), (6, "a", 1010.0000001, 4979.9999999, 1019.9999999, 4990.0)]
    windows = raster.windows_of(spark.createDataFrame(boxes, "id int, raster string, xmin double, ymin double, xmax double, ymax double"), meta, "id")
    placed = {r["id"]: tuple(r)[2:] for r in windows.collect()}
    assert placed == {1: (0, 0, 5, 5), 2: (19, 13, 21, 22), 3: (0, 0, 50, 70), 4: (40, 0, 1, 1), 6: (5, 5, 5, 5)}
    got = raster.read_windows(tiles, windows, "id", [1, 3], SIDE).collect()
    assert len(got) == 10 and {r["band"] for r in got} == {1, 3}
    for r in got:
        row0, col0, h, w = placed[r["id"]]
        want = arrays["b" if r["id"] == 4 else "a", r["band"]][row0 : row0 + h, col0 : col0 + w]
        assert (np.frombuffer(r["data"], "<u2").reshape(r["height"], r["width"]) == want).all()
    long = raster.values_of(raster.read_windows(tiles, windows.filter("id = 2"), "id", [3], SIDE), "id")
    assert {(r["row"], r["col"]): r["value"] for r in long.collect()} == {(r, c): v for r, line in enumerate(arrays["a", 3][19:40, 13:35].tolist()) for c, v in enumerate(line)}


def test_windows_read_their_strips_only(spark, scene):
    _, meta, tiles, _ = scene
    windows = spark.createDataFrame([(1, "a", 17, 3, 10, 20)], "id int, raster string, row0 int, col0 int, height int, width int")
    plan = raster.read_windows(tiles, windows, "id", [2], SIDE)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "tile_row" in filters and "band" in filters
    assert layout.files_read(tiles.filter("tile_row BETWEEN 1 AND 1 AND band = 2 AND raster = 'a'")) == 1 < layout.files_read(tiles) == 21
    with pytest.raises(ValueError, match="pixels"):
        raster.read_windows(tiles, windows.withColumn("width", F.lit(1 << 27)), "id")


def test_cut_odd_pixels(spark, scene):
    _, meta, _, _ = scene
    odd = spark.createDataFrame([("a", 1, 0, 0, 5), ("a", 1, 0, 0, 9), ("a", 1, -1, 0, 7), ("a", 1, 0, 70, 7), ("a", 1, 3, 3, None), ("z", 1, 0, 0, 1), ("a", 2, 49, 69, 8)], "raster string, band int, row int, col int, value int")
    got = {(r["band"], r["tile_row"], r["tile_col"]): np.frombuffer(r["data"], "<u2").reshape(r["height"], r["width"]) for r in raster.cut(odd, meta, SIDE).collect()}
    assert set(got) == {(1, 0, 0), (2, 3, 4)} and got[1, 0, 0][0, 0] == 9 and got[1, 0, 0].sum() == 9 and got[2, 3, 4].shape == (2, 6) and got[2, 3, 4][1, 5] == 8
    assert raster.cut(odd.filter("false"), meta, SIDE).collect() == []


def naive(arrays, metas, band, x, y):
    """One pixel, the first valid raster, written out."""
    for name, left, top, pixel in metas:
        v = arrays[name, band]
        r, c = (top - y) / pixel - 0.5, (x - left) / pixel - 0.5
        rr, cc = int(np.floor(r + 0.5)), int(np.floor(c + 0.5))
        if not (0 <= rr < v.shape[0] and 0 <= cc < v.shape[1]) or v[rr, cc] == 0:
            continue
        total = weight = 0.0
        for i in (int(np.floor(r)), int(np.floor(r)) + 1):
            for j in (int(np.floor(c)), int(np.floor(c)) + 1):
                if 0 <= i < v.shape[0] and 0 <= j < v.shape[1] and v[i, j]:
                    w = (1 - abs(r - i)) * (1 - abs(c - j))
                    total, weight = total + w * v[i, j], weight + w
        return int(np.floor(total / weight + 0.5))
    return 0


def whole(blocks, grid, band):
    out = np.zeros((grid.height, grid.width), int)
    for r in blocks:
        if r["band"] == band:
            raster.paste(out, 0, 0, np.frombuffer(r["data"], "<u2").reshape(r["height"], r["width"]), r["tile_row"] * grid.side, r["tile_col"] * grid.side)
    return out


@pytest.mark.parametrize(("pixel", "first"), [(2.0, "a"), (3.0, "a"), (3.0, "b"), (0.7, "b")])
def test_mosaic(spark, scene, pixel, first):
    arrays, meta, tiles, _ = scene
    grid = raster.Grid.around((1080.3, 4920.0, 1150.0, 4992.2), pixel, side=20)
    metas = sorted([("a", 1000.0, 5000.0, 2.0), ("b", 1091.0, 4987.0, 2.0)], key=lambda m: m[0] != first)
    ranked = meta.withColumn("rank", (F.col("raster") != first).cast("int"))
    blocks = raster.mosaic(tiles, ranked, grid, "rank", bands=[2], side=SIDE).collect()
    got = whole(blocks, grid, 2)
    want = np.array([[naive(arrays, metas, 2, grid.left + (c + 0.5) * pixel, grid.top - (r + 0.5) * pixel) for c in range(grid.width)] for r in range(grid.height)])
    assert abs(got - want).max() <= 1 and (got == want).mean() > 0.999 and {b["band"] for b in blocks} == {2}


def test_grid_is_on_whole_pixels():
    grid = raster.Grid.around((333511.04, 5139212.617, 338656.93, 5144347.779), 10.0)
    assert (grid.left, grid.top, grid.width, grid.height) == (333510.0, 5144350.0, 515, 514)


def test_reprojection_from_another_zone(spark):
    """A plane of values in the zone to the west, sampled on a 10 m grid of the working zone, keeps its values at every place."""
    west, here = raster.Crs(-93.0), raster.Crs()
    x0, y0 = here.into(west, np.array([333600.0]), np.array([5140000.0]))
    left, top = float(np.floor(x0[0] / 20) * 20) - 1000, float(np.floor(y0[0] / 20) * 20) + 1000
    meta = spark.createDataFrame([("s", left, top, 20.0, 100, 100)], raster.META)
    plane = lambda x, y: 1000 + (x - left) * 0.5 + (top - y) * 0.25
    rows = [("s", 1, r, c, int(round(plane(left + (c + 0.5) * 20, top - (r + 0.5) * 20)))) for r in range(100) for c in range(100)]
    tiles = raster.cut(spark.createDataFrame(rows, "raster string, band int, row int, col int, value int"), meta, 32)
    grid = raster.Grid.around((333300.0, 5139700.0, 333900.0, 5140300.0), 10.0, side=25)
    got = whole(raster.mosaic(tiles, meta, grid, source=west, side=32).collect(), grid, 1)
    x, y = np.meshgrid(grid.left + (np.arange(grid.width) + 0.5) * 10, grid.top - (np.arange(grid.height) + 0.5) * 10)
    assert abs(got - plane(*here.into(west, x, y))).max() <= 1.01 and (got > 0).all()


def test_projection_agrees_with_columns(spark):
    lon, lat = np.array([-89.2, -87.0, -84.3]), np.array([46.38, 30.0, 60.5])
    x, y = raster.Crs().from_degrees(lon, lat)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], "lon double, lat double").select(*geo.to_utm(F.col("lon"), F.col("lat"))).collect()
    assert np.allclose([tuple(r) for r in rows], np.stack([x, y], axis=1), atol=1e-6)
    assert np.allclose(raster.Crs().to_degrees(x, y), (lon, lat), atol=1e-11)


def test_pixels_and_boxes_are_not_shuffled_by_raster(spark):
    """One raster may have all pixels, so its tasks would hold them all."""
    meta = spark.createDataFrame([("a", 0.0, 100.0, 1.0, 90, 70)], raster.META)
    pixels = spark.range(40_000).select(F.when(F.col("id") >= 0, "a").alias("raster"), F.lit(1).alias("band"), (F.col("id") % 100 - 5).cast("int").alias("row"), F.expr("cast(id div 100 % 80 - 5 as int)").alias("col"), F.expr("cast(id div 8000 + 1 as int)").alias("value"))
    tiles = raster.cut(pixels, meta, 32)
    boxes = spark.createDataFrame([(1, "a", 2.0, 60.0, 9.0, 70.0)], "id int, raster string, xmin double, ymin double, xmax double, ymax double")
    for df in (tiles, raster.windows_of(boxes, meta, "id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = raster.pixels_of(tiles, 32).collect()
    assert {(r["row"], r["col"]) for r in got} == {(r, c) for r in range(90) for c in range(70)} and len(got) == 6300 and {r["value"] for r in got} == {5}
