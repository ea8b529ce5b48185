"""Views of the driver's tables as places, vectors, features and catalog items; each beside the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, text
from .operators import grid

OW, OS, COLS = 333424, 5139120, 20
#: Outer ring of the area of interest, metres.
AOI = [(333511.04, 5139347.782), (338524.131, 5139212.617), (338656.93, 5144212.624), (333647.965, 5144347.779)]
AOI_DEGREES = [(-89.1653, 46.3872), (-89.1001, 46.3872), (-89.1001, 46.4322), (-89.1653, 46.4322)]
BOUNDS = (333511.040, 5139212.617, 338656.930, 5144347.779)
TYPES = ["waterfall", "beaver_kettle_pond", "dam", "road", "parking", "boardwalk", "cemetery", "cabin"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chips(spark: SparkSession, folder: str) -> DataFrame:
    """One row a place and cycle, in the shape of ``schemas.CHIP_EMBEDDINGS``, with row, col, loc_idx and label."""
    e = table(spark, folder, "embeddings").withColumn("loc_idx", F.expr("vec_id div 5"))
    e = e.withColumns({"source_cycle": (2014 + 2 * (F.col("vec_id") % 5)).cast("string"), "row": F.expr(f"cast(loc_idx div {COLS} as int)"), "col": (F.col("loc_idx") % COLS).cast("int")})
    e = grid.boxed(e, OW, OS)
    return e.withColumns({
        "chip_location_id": text.location_id(F.col("row"), F.col("col")), "chip_id": text.chip_id(F.col("source_cycle"), F.col("row"), F.col("col")),
        "inside_aoi": (F.col("row") + F.col("col")) % 4 != 0, "experiment_id": F.lit("default"), "model_id": F.lit("m"), "bands": F.lit("rgb"),
    })


CHIPS = """chips AS (
    SELECT vec_id, label, embedding, vec_id // 5 AS loc_idx, CAST(2014 + 2 * (vec_id % 5) AS VARCHAR) AS source_cycle,
        CAST(vec_id // 5 // 20 AS INTEGER) AS "row", CAST(vec_id // 5 % 20 AS INTEGER) AS col,
        333424.0::DOUBLE + 112 * (vec_id // 5 % 20) AS xmin, 5139120.0::DOUBLE + 112 * (vec_id // 5 // 20) AS ymin,
        333424.0::DOUBLE + 112 * (vec_id // 5 % 20) + 224 AS xmax, 5139120.0::DOUBLE + 112 * (vec_id // 5 // 20) + 224 AS ymax,
        333424.0::DOUBLE + 112 * (vec_id // 5 % 20) + 112 AS cx, 5139120.0::DOUBLE + 112 * (vec_id // 5 // 20) + 112 AS cy,
        printf('r%03d_c%03d', CAST(vec_id // 5 // 20 AS INTEGER), CAST(vec_id // 5 % 20 AS INTEGER)) AS chip_location_id,
        printf('naip_%s_r%03d_c%03d', CAST(2014 + 2 * (vec_id % 5) AS VARCHAR), CAST(vec_id // 5 // 20 AS INTEGER), CAST(vec_id // 5 % 20 AS INTEGER)) AS chip_id,
        (vec_id // 5 // 20 + vec_id // 5 % 20) % 4 <> 0 AS inside_aoi
    FROM embeddings)"""


def places(spark: SparkSession, folder: str) -> DataFrame:
    """One row a place."""
    return chips(spark, folder).filter("vec_id % 5 = 0").select("loc_idx", "chip_location_id", "row", "col", "xmin", "ymin", "xmax", "ymax", "cx", "cy", "inside_aoi")


PLACES = 'places AS (SELECT loc_idx, chip_location_id, "row", col, xmin, ymin, xmax, ymax, cx, cy, inside_aoi FROM chips WHERE vec_id % 5 = 0)'


def features(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), F.col("s_nationkey") % 8 + 1)
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("feature_id"), kind.alias("type"), (F.col("s_acctbal") > 0).alias("findable_aerial"), (OW + k * 37 % 2300 + 0.25).cast("double").alias("x"), (OS + k * 91 % 700 + 0.75).cast("double").alias("y")
    )


FEATURES = f"""features AS (
    SELECT s_suppkey AS feature_id, [{", ".join(f"'{t}'" for t in TYPES)}][s_nationkey % 8 + 1] AS type, s_acctbal > 0 AS findable_aerial,
        333424 + s_suppkey * 37 % 2300 + 0.25::DOUBLE AS x, 5139120 + s_suppkey * 91 % 700 + 0.75::DOUBLE AS y
    FROM supplier)"""
CONCEPT_ROWS = "concepts AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {'NULL' if t is None else repr(t)}, {i})" for i, (c, (t, _)) in enumerate(text.CONCEPTS.items())) + ") AS t(concept, feature_type, ord))"


def items(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    xmin, ymin = (F.lit(333000.0) + key % 700).cast("double"), (F.lit(5139000.0) + key % 500).cast("double")
    return table(spark, folder, "orders").select(
        key.alias("item_id"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") % 100).alias("cloud_cover"), xmin.alias("xmin"), ymin.alias("ymin"), (xmin + 6000).alias("xmax"), (ymin + 6000).alias("ymax")
    )


ITEMS = """items AS (
    SELECT o_orderkey AS item_id, o_orderdate AS ts, o_totalprice % 100 AS cloud_cover, 333000.0::DOUBLE + o_orderkey % 700 AS xmin, 5139000.0::DOUBLE + o_orderkey % 500 AS ymin,
        333000.0::DOUBLE + o_orderkey % 700 + 6000 AS xmax, 5139000.0::DOUBLE + o_orderkey % 500 + 6000 AS ymax
    FROM orders)"""


def spots(spark: SparkSession, folder: str) -> DataFrame:
    """Points in degrees."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("id"), (F.lit(-89.2) + (k % 1000) * 0.0001).alias("lon"), (F.lit(46.38) + (k * 7 % 1000) * 0.00005).alias("lat"))


SPOTS = "spots AS (SELECT c_custkey AS id, -89.2::DOUBLE + (c_custkey % 1000) * 0.0001::DOUBLE AS lon, 46.38::DOUBLE + (c_custkey * 7 % 1000) * 0.00005::DOUBLE AS lat FROM customer)"


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Long-form pixels: band 1 to 4, row 0 in the north, value 0 to 255."""
    k = F.col("l_orderkey")
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("band"), (k % 300).cast("int").alias("row"), F.expr("cast(l_orderkey div 300 % 300 as int)").alias("col"), (F.col("l_extendedprice") % 256).cast("int").alias("value")
    )


PIXELS = """pixels AS (
    SELECT l_linenumber AS band, CAST(l_orderkey % 300 AS INTEGER) AS "row", CAST(l_orderkey // 300 % 300 AS INTEGER) AS col, CAST(trunc(l_extendedprice % 256) AS INTEGER) AS value
    FROM lineitem)"""


def half_split(spark: SparkSession, folder: str) -> DataFrame:
    """The chips under two models: model b holds the components in reverse."""
    c = chips(spark, folder)
    return c.withColumn("model_id", F.lit("a")).unionByName(c.withColumns({"model_id": F.lit("b"), "embedding": F.reverse("embedding")}))


HALVES = "halves AS (SELECT 'a' AS model_id, * FROM chips UNION ALL SELECT 'b' AS model_id, * REPLACE (list_reverse(embedding) AS embedding) FROM chips)"


#: Vertices of an area about its middle, as multiples of its half side: an arrow head, which is not convex, and a hole in it.
OUTER = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 0.25), (-1.0, 1.0)]
HOLE = [(-0.5, -0.75), (0.25, -0.75), (0.25, -0.25), (-0.5, -0.25)]


def rings(spark: SparkSession, folder: str) -> DataFrame:
    """area_id, ring, points: an area of two rings for each supplier (one of three has no hole)."""
    k = F.col("s_suppkey")
    middle = table(spark, folder, "supplier").select(k.alias("area_id"), (OW + k * 37 % 2300 + 0.25).cast("double").alias("x"), (OS + k * 91 % 700 + 0.75).cast("double").alias("y"), (60 + k % 7 * 40).cast("double").alias("s"))
    ring = lambda points: F.array(*[F.struct((F.col("x") + F.col("s") * a).alias("x"), (F.col("y") + F.col("s") * b).alias("y")) for a, b in points])
    outer = middle.select("area_id", F.lit(0).alias("ring"), ring(OUTER).alias("points"))
    return outer.unionByName(middle.filter("area_id % 3 != 0").select("area_id", F.lit(1).alias("ring"), ring(HOLE).alias("points")))


def _vertices(points) -> str:
    return "[" + ", ".join(f"{{'x': x + s * {a}::DOUBLE, 'y': y + s * {b}::DOUBLE}}" for a, b in points) + "]"


RINGS = f"""middles AS (SELECT s_suppkey AS area_id, 333424 + s_suppkey * 37 % 2300 + 0.25::DOUBLE AS x, 5139120 + s_suppkey * 91 % 700 + 0.75::DOUBLE AS y, (60 + s_suppkey % 7 * 40)::DOUBLE AS s FROM supplier),
    rings AS (SELECT area_id, 0 AS ring, {_vertices(OUTER)} AS p FROM middles UNION ALL SELECT area_id, 1 AS ring, {_vertices(HOLE)} AS p FROM middles WHERE area_id % 3 <> 0),
    ring_edges AS (SELECT area_id, ring, i, p[i].x AS x1, p[i].y AS y1, p[i % len(p) + 1].x AS x2, p[i % len(p) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM rings))"""


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Points in metres over the areas, one a customer."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("id"), (OW + k * 53 % 2400).cast("double").alias("x"), (OS + k * 29 % 800 + 0.5).cast("double").alias("y"))


VISITS = "visits AS (SELECT c_custkey AS id, (333424 + c_custkey * 53 % 2400)::DOUBLE AS x, 5139120 + c_custkey * 29 % 800 + 0.5::DOUBLE AS y FROM customer)"
