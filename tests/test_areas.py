"""Polygons with holes against points by a cover of cells, and distances on the ellipsoid."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import areas, grid

RINGS = "area_id int, ring int, points array<struct<x: double, y: double>>"


def holds(rings, x, y):
    """Even-odd over all rings, boundary included."""
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)):
                inside = not inside
    return inside


def star(rng, x, y, size, n):
    return [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("side", [3.0, 25.0, 400.0])
def test_points_in_areas_by_brute_force(spark, side):
    rng = random.Random(1)
    shapes = {i: [star(rng, rng.uniform(-200, 200), rng.uniform(-200, 200), rng.uniform(5, 150), rng.randrange(3, 30))] for i in range(25)}
    for i in range(0, 25, 3):
        shapes[i].append([(x * 0.5 + sum(p[0] for p in shapes[i][0]) / len(shapes[i][0]) * 0.5, y * 0.5 + sum(p[1] for p in shapes[i][0]) / len(shapes[i][0]) * 0.5) for x, y in shapes[i][0]])
    shapes[90] = [[(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)], [(25.0, 25.0), (40.0, 25.0), (40.0, 40.0), (25.0, 40.0)]]  # along cell sides
    shapes[91] = [[(-300.0, -300.0), (-300.0, 300.0), (300.0, 300.0), (300.0, -300.0), (-300.0, -300.0)]]  # closed
    points = [(i, rng.uniform(-310, 310), rng.uniform(-310, 310)) for i in range(600)] + [(1000 + i, x, y) for i, (x, y) in enumerate([(0, 0), (25, 25), (50, 25), (30, 30), (32, 25), (-300, 12), (300, 300), (25, 10), (75, 0)])]
    points = [(i, float(x), float(y)) for i, x, y in points]
    table = spark.createDataFrame([(a, r, [{"x": x, "y": y} for x, y in p]) for a, rings in shapes.items() for r, p in enumerate(rings)], RINGS)
    got = areas.points_in_areas(spark.createDataFrame([*points, (5000, None, 1.0)], "id int, x double, y double"), table, "id", side)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in got.collect()]
    want = {(i, a) for i, x, y in points for a, rings in shapes.items() if holds([r[:-1] if r[0] == r[-1] else r for r in rings], x, y)}
    assert len(found) == len(set(found)) and set(found) == want
    strict = {tuple(r) for r in areas.points_in_areas(spark.createDataFrame(points, "id int, x double, y double"), table, "id", side, on_boundary=False).collect()}
    assert (1000, 90) not in strict and (1005, 91) not in strict and strict < want


def test_areas_without_edges_or_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    odd = spark.createDataFrame([(1, 0, []), (2, 0, None), (3, 0, [{"x": 0.0, "y": 0.0}]), (4, 0, [{"x": 1.0, "y": 1.0}, None, {"x": 1.0, "y": 1.0}])], RINGS)
    assert areas.points_in_areas(points, odd, "id").collect() == [] == areas.points_in_areas(points, odd.filter("false"), "id").collect()
    assert areas.points_in_areas(points.filter("false"), odd, "id").collect() == [] == areas.size_of(odd).collect()


def test_area_sizes_and_edges(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    hole = [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 2.0}, {"x": 3.0, "y": 1.0}, {"x": 1.0, "y": 1.0}]
    table = spark.createDataFrame([(1, 0, square), (1, 1, hole), (2, 0, square[::-1])], RINGS)
    assert {tuple(r) for r in areas.size_of(table).collect()} == {(1, 14.0), (2, 16.0)}
    flat = table.select("area_id", "ring", F.posexplode("points").alias("i", "p")).select("area_id", "ring", "i", "p.x", "p.y")
    assert sorted(areas.edges(table).collect()) == sorted(areas.edges_by_window(flat).collect())


def test_rings_keep_their_holes_in_metres(spark):
    ring = [{"x": -89.1, "y": 46.4}, {"x": -89.0, "y": 46.4}, {"x": -89.0, "y": 46.5}]
    got = spark.createDataFrame([(1, 0, ring), (1, 1, ring[::-1])], RINGS).select("ring", areas.rings_to_utm(F.col("points")).alias("p")).orderBy("ring").collect()
    assert got[0]["p"] == got[1]["p"][::-1]
    x, y = geo.to_utm(F.lit(-89.1), F.lit(46.4))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx(tuple(got[0]["p"][0]), abs=1e-6)


def test_geodesic_golden(spark):
    """Published distances on this ellipsoid, to a millimetre."""
    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (1 if d > 0 else -1)
    golden = [
        (dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610), 54972.271),  # Flinders Peak to Buninyong
        (0.0, 0.0, 1.0, 0.0, 6378137.0 * math.pi / 180), (10.0, 0.0, 10.0, 90.0, 10001965.7293), (5.0, 5.0, 5.0, 5.0, 0.0),
    ]
    got = spark.createDataFrame([g[:4] for g in golden], "a double, b double, c double, d double").select(geo.geodesic(*map(F.col, "abcd")).alias("m")).collect()
    for r, g in zip(got, golden, strict=True):
        assert r["m"] == pytest.approx(g[4], abs=1e-3)
    assert spark.range(1).select(geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(179.9), F.lit(0.3)).alias("m")).first()["m"] is None  # nearly antipodal


def test_geodesic_agrees_with_the_plane(spark):
    a, b = (-89.12, 46.40), (-89.08, 46.43)
    (x1, y1), (x2, y2) = (spark.range(1).select(*geo.to_utm(F.lit(p[0]), F.lit(p[1]))).first() for p in (a, b))
    metres = spark.range(1).select(geo.geodesic(*map(F.lit, (*a, *b))).alias("m")).first()["m"]
    assert abs(math.hypot(x2 - x1, y2 - y1) - metres) / metres < 1e-3


def test_grids_of_many_bounds(spark):
    bounds = [(1, 333511.04, 5139212.617, 334100.0, 5139900.0), (2, 0.0, 0.0, 1.0, 1.0)]
    many = grid.build_all(spark.createDataFrame(bounds, "id int, west double, south double, east double, north double"), "id")
    for i, *b in bounds:
        one = grid.build(spark, tuple(b))
        columns = ["chip_location_id", "loc_idx", "row", "col", "xmin", "ymax", "cx"]
        assert sorted(many.filter(F.col("id") == i).select(*columns).collect()) == sorted(one.select(*columns).collect())


def test_geodesic_of_many_rows_is_vectorised(spark):
    """A null gives a null; a step is computed once a batch, so many rows take seconds and not minutes."""
    points = spark.range(300_000).select((F.col("id") % 359).cast("double").alias("a"), (F.col("id") % 83).cast("double").alias("b"))
    started = time.monotonic()
    far = points.select(geo.geodesic(F.col("a"), F.col("b"), F.col("a") + 1, F.col("b") + 1).alias("m")).agg(F.count("m").alias("n"), F.min("m").alias("low"), F.max("m").alias("high")).first()
    assert time.monotonic() - started < 60
    assert far["n"] == 300_000 and 111_000 < far["low"] < far["high"] < 157_500
    assert spark.range(1).select(geo.geodesic(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("m")).first()["m"] is None


def test_points_at_one_place_meet_the_areas_once(spark):
    ring = [{"x": 100 * math.cos(i / 50 * math.pi), "y": 100 * math.sin(i / 50 * math.pi)} for i in range(100)]
    points = spark.range(3000).select("id", (F.col("id") % 3 * 60).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = areas.points_in_areas(points, spark.createDataFrame([(7, 0, ring)], RINGS), "id", 50.0)
    assert "keys=[knownfloatingpointnormalized(normalizenanandzero(x" in got._jdf.queryExecution().executedPlan().toString()  # distinct places, before any join
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(3000) if i % 3 < 2]


def test_cells_of_areas_are_not_broadcast(spark):
    """Tables of a known, small size: what areas are exploded into may be any size and stays off the driver. -0.0 is 0.0."""
    corners = ", ".join(f"struct({x} + 400D * id AS x, {y} AS y)" for x, y in [("0D", "0D"), ("300D", "0D"), ("300D", "300D"), ("0D", "300D")])
    rings = spark.range(3).select(F.col("id").alias("area_id"), F.lit(0).alias("ring"), F.expr(f"array({corners})").alias("points"))
    points = spark.range(1200).select("id", F.expr("if(id = 0, -0D, cast(id AS double))").alias("x"), F.expr("if(id = 1, -0D, if(id % 2 = 0, 0D, 125D))").alias("y"))
    got = areas.points_in_areas(points, rings, "id", 10.0)
    plan = got._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    assert sorted(map(tuple, got.collect())) == [(i, i // 400) for i in range(1200) if i % 400 <= 300]
    assert "Broadcast" not in plan.toString()  # as it ran
