"""Grid, polygons, projection, ground truth: golden numbers of the survey."""

import pytest
from placelens import carriers as C
from placelens.functions import geo
from placelens.operators import evaluation, grid
from pyspark.sql import functions as F

FEATURES = [
    ("bond-falls", "waterfall", True, 336088.755, 5141776.242), ("upper-bond-falls", "waterfall", True, 336103.457, 5141722.474),
    ("pond-1", "beaver_kettle_pond", True, 335725.824, 5141665.955), ("pond-2", "beaver_kettle_pond", True, 335897.218, 5140293.662),
    ("wetland", "beaver_kettle_pond", False, 335525.054, 5141295.554), ("pond-3", "beaver_kettle_pond", True, 337040.101, 5141946.354),
    ("dam", "dam", True, 336391.604, 5141597.958), ("parking", "parking", True, 336057.398, 5141554.704), ("boardwalk", "boardwalk", True, 336179.625, 5141694.846),
    ("road", "road", True, 336356.028, 5141647.841), ("cemetery", "cemetery", False, 335744.344, 5139737.883), ("cabin", "cabin", None, 336631.294, 5143074.806),
]


@pytest.fixture(scope="module")
def chips(spark):
    return grid.build(spark, C.BOUNDS).cache()


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(FEATURES, "feature_id string, type string, findable_aerial boolean, x double, y double")


def test_grid(spark, chips):
    o = grid.origin_and_dims(spark.createDataFrame([C.BOUNDS], "west double, south double, east double, north double")).first()
    assert tuple(o) == (333424, 5139120, 47, 47) and chips.count() == 2209
    last = chips.orderBy(F.desc("loc_idx")).first()
    assert (last["row"], last["col"], last["chip_location_id"]) == (46, 46, "r046_c046")


def test_inside_is_full_containment(chips):
    flag = geo.polygon_holds_box(C.AOI, *[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    assert chips.filter(flag).count() == 1822
    assert chips.filter(geo.polygon_holds_point(C.AOI, F.col("cx"), F.col("cy"))).count() == 2002


def test_per_cycle(chips):
    six = grid.per_cycle(chips, [str(y) for y in range(2012, 2024, 2)], C.AOI)
    assert six.count() == 13254
    assert six.filter("inside_aoi").groupBy("cycle").count().select("count").distinct().collect()[0][0] == 1822
    r = six.filter("cycle = '2022' AND row = 7 AND col = 13").first()
    assert r["chip_id"] == "naip_2022_r007_c013" and -89.2 < r["lon"] < -89.0 and 46.3 < r["lat"] < 46.5


def test_concave_polygon(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    boxes = spark.createDataFrame([(1.0, 1.0, 3.0, 3.0), (4.0, 3.0, 6.0, 5.0), (1.0, 1.0, 9.0, 8.0), (-1.0, 1.0, 2.0, 2.0)], "a double, b double, c double, d double")
    got = [r[0] for r in boxes.select(geo.polygon_holds_box([tuple(map(float, p)) for p in ring], *[F.col(c) for c in "abcd"])).collect()]
    assert got == [True, False, False, False]


def test_anchor_lies_in_four_chips(spark, chips, features):
    for met in (grid.points_in_chips(features, chips, 333424, 5139120), grid.points_in_chips_theta(features, chips)):
        assert sorted(r["chip_location_id"] for r in met.filter("feature_id = 'bond-falls'").collect()) == ["r022_c022", "r022_c023", "r023_c022", "r023_c023"]


def test_both_range_joins_agree_on_edges(spark, chips):
    pts = [(i, 333424.0 + 112 * (i % 9), 5139120.0 + 56 * (i % 13)) for i in range(200)] + [(900, 0.0, 0.0), (901, 333423.999, 5139121.0)]
    df = spark.createDataFrame(pts, "p int, x double, y double")
    a, b = ({(r["p"], r["chip_location_id"]) for r in j.collect()} for j in (grid.points_in_chips(df, chips, 333424, 5139120), grid.points_in_chips_theta(df, chips)))
    assert a == b and len(a) > 300
    plan = grid.points_in_chips(df, chips, 333424, 5139120)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_primary_chip(spark, chips, features):
    got = {r["feature_id"]: r for r in grid.primary_chip(features, chips, 333424, 5139120, "feature_id", strict=True).collect()}
    assert len(got) == 12 and got["cabin"]["chip_location_id"] in {"r034_c028", "r034_c027", "r035_c028", "r035_c027"}
    with pytest.raises(ValueError):
        grid.primary_chip(spark.createDataFrame([("far", 0.0, 0.0)], "feature_id string, x double, y double"), chips, 333424, 5139120, "feature_id", strict=True)
    look = grid.eval_lookup(grid.primary_chip(features, chips, 333424, 5139120, "feature_id"), ["2018", "2020"], "feature_id")
    assert look.count() == 24


def test_ground_truth_sizes(spark, chips, features):
    names = evaluation.concept_table(spark)
    sizes = [{r["concept"]: r["count"] for r in evaluation.ground_truth(features, names, chips, 333424, 5139120, f).groupBy("concept").count().collect()} for f in (True, False)]
    assert sizes[0] == {"waterfall": 4, "pond": 12, "dam": 4, "road": 4, "parking_lot": 4, "boardwalk": 4}
    assert sizes[1] == {**sizes[0], "pond": 16, "cemetery": 4, "abandoned_cabin": 4}


def test_area_and_projection(spark):
    assert abs(abs(geo.signed_area(C.AOI)) - 25073377.970) < 0.01
    df = spark.createDataFrame([(*d, *m) for d, m in zip(C.AOI_DEGREES, C.AOI)], "lon double, lat double, mx double, my double")
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    for r in df.select(x.alias("x"), y.alias("y"), "mx", "my").collect():
        assert abs(r["x"] - r["mx"]) < 1e-3 and abs(r["y"] - r["my"]) < 1e-3
    lon, lat = geo.to_degrees(F.col("x"), F.col("y"))
    back = df.withColumns({"x": x, "y": y}).select(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))).alias("e")).agg(F.max("e")).first()[0]
    assert back < 1e-7


def test_covers_and_area_of_use(spark):
    one = spark.range(1)
    v = lambda *a: [F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in a]
    got = one.select(geo.covers(v(0, 0, 4, 4), v(0, 1, 4, 3)), geo.covers(v(None, 0, 4, 4), v(0, 1, 4, 3)), geo.in_area_of_use(*v(-89, 46, -88, 47)), geo.in_area_of_use(*v(-90, 46, -88, 47))).first()
    assert tuple(got) == (True, False, True, False)


def test_points_inside(features):
    assert evaluation.areas_meet(features, C.AOI).first()["all_inside"]


def test_pick_cycles(spark):
    years = lambda *y: spark.createDataFrame([(str(a),) for a in y], "year string")
    got = lambda df: sorted(r[0] for r in df.collect())
    all_ = years(*range(2000, 2010))
    assert got(grid.pick_cycles(all_, 1)) == ["2009"] and got(grid.pick_cycles(all_, 2)) == ["2000", "2009"]
    assert got(grid.pick_cycles(all_, 4)) == ["2000", "2003", "2005", "2009"]
    assert got(grid.pick_cycles(years(1, 2), 5)) == ["1", "2"] and got(grid.pick_cycles(years(), 3)) == []
