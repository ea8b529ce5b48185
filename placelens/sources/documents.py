"""Readers and writers of the JSON documents and embedding files."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHIP_INDEX, FEATURE_COLLECTION, NAIP_MANIFEST, S2_MANIFEST

PROPERTIES = ["name", "type", "category", "source", "findable_aerial", "findable_aerial_source", "findable_lidar", "notes", "provenance", "mvp_required"]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest, or no row where it is missing or broken."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return whole.select(parsed.alias("d")).select("d.*").filter("_corrupt_record IS NULL").drop("_corrupt_record")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, the properties, x and y of each point of a feature collection."""
    f = read_json(spark, path, FEATURE_COLLECTION).select(F.explode("features").alias("f"))
    at = F.from_json("f.geometry.coordinates", "array<double>")
    return f.select(F.coalesce("f.id", "f.properties.id").alias("id"), *[F.col(f"f.properties.{p}").alias(p) for p in PROPERTIES], at[0].alias("x"), at[1].alias("y"))


def read_area(spark: SparkSession, path: str) -> tuple[list[tuple[float, float]], DataFrame]:
    """The outer ring of the first feature, and its bounds as one row."""
    first = read_json(spark, path, FEATURE_COLLECTION).select(F.element_at("features", 1)["geometry"]["coordinates"].alias("c"))
    ring = first.select(F.from_json("c", "array<array<array<double>>>")[0].alias("ring"))
    axis = lambda i: F.transform("ring", lambda p: p[i])
    bounds = ring.select(F.array_min(axis(0)).alias("west"), F.array_min(axis(1)).alias("south"), F.array_max(axis(0)).alias("east"), F.array_max(axis(1)).alias("north"))
    return [tuple(p) for p in ring.first()["ring"]], bounds


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """area_id, ring, points (x, y) of all rings of the polygons of a feature collection: outer ones have number 0, holes follow."""
    f = read_json(spark, path, FEATURE_COLLECTION).select(F.posexplode("features").alias("area_id", "f"))
    rings = f.select("area_id", F.posexplode(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")).alias("ring", "r"))
    return rings.select("area_id", "ring", F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))


def area_json(rings: DataFrame, epsg: int = 26916) -> DataFrame:
    """One row, ``value``: polygons with their holes as a feature collection, coordinates rounded to 3 digits (half to even)."""
    ring = F.transform("points", lambda p: F.array(F.bround(p["x"], 3), F.bround(p["y"], 3)))
    polygons = rings.groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("ring", ring.alias("p")))).alias("rings"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: r["p"]).alias("coordinates")).alias("geometry"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"urn:ogc:def:crs:EPSG::{epsg}").alias("name")).alias("properties"))
    all_ = polygons.agg(F.array_sort(F.collect_list(F.struct("area_id", feature.alias("f")))).alias("s"))
    return all_.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.transform("s", lambda s: s["f"]).alias("features"))).alias("value"))


def read_chip_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid meta, chips of all cycles, eval lookup)."""
    doc = read_json(spark, path, CHIP_INDEX)
    meta = doc.drop("cycles", "eval_lookup")
    c = doc.select(F.explode("cycles").alias("y"), "n_cols").select("n_cols", F.col("y.year").alias("cycle"), F.explode("y.chips").alias("c"))
    box = ["xmin", "ymin", "xmax", "ymax"]
    chips = c.select(
        "cycle", "c.chip_id", "c.row", "c.col", F.format_string("r%03d_c%03d", "c.row", "c.col").alias("chip_location_id"),
        (F.col("c.row").cast("long") * F.col("n_cols") + F.col("c.col")).alias("loc_idx"), *[F.col("c.bbox_26916")[i].alias(b) for i, b in enumerate(box)],
        F.col("c.center_26916")[0].alias("cx"), F.col("c.center_26916")[1].alias("cy"), F.col("c.center_wgs84")[0].alias("lon"), F.col("c.center_wgs84")[1].alias("lat"), "c.inside_aoi",
    )
    lookup = doc.select(F.explode("eval_lookup").alias("feature_id", "v")).select("feature_id", F.explode("v").alias("e")).select("feature_id", F.col("e.year").alias("cycle"), "e.chip_id")
    return meta, chips, lookup


def one_cycle(chips: DataFrame, cycle: str) -> DataFrame:
    """The chips of a cycle; an unknown cycle is an error."""
    rows = chips.filter(F.col("cycle") == cycle)
    if rows.isEmpty():
        raise ValueError(f"cycle {cycle} is not in the chip index")
    return rows


def chip_index_json(meta: dict, chips: DataFrame, lookup: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row, ``value``: the nested document. Gathers the chips of a cycle, as the document does."""
    chip = F.struct("chip_id", "row", "col", F.array("xmin", "ymin", "xmax", "ymax").alias("bbox_26916"), F.array("cx", "cy").alias("center_26916"), F.array("lon", "lat").alias("center_wgs84"), "inside_aoi")
    years = chips.groupBy(F.col("cycle").alias("year")).agg(F.array_sort(F.collect_list(F.struct("loc_idx", chip.alias("c")))).alias("s")).select("year", F.transform("s", lambda s: s["c"]).alias("chips"))
    if extra is not None:
        years = years.join(extra, "year", "left")
    cycles = years.agg(F.array_sort(F.collect_list(F.struct("year", *[c for c in years.columns if c not in ("year", "chips")], "chips"))).alias("cycles"))
    named = lookup.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct(F.col("cycle").alias("year"), "chip_id"))).alias("v"))
    table = named.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_id", "v")))).alias("eval_lookup"))
    kind = lambda v: "array<long>" if all(isinstance(x, int) for x in v) else "array<double>"
    header = [F.from_json(F.lit(json.dumps(v)), kind(v)).alias(k) if isinstance(v, (list, tuple)) else F.lit(v).alias(k) for k, v in meta.items()]
    return cycles.crossJoin(table).select(F.to_json(F.struct(*header, "cycles", "eval_lookup")).alias("value"))


def features_json(features: DataFrame, epsg: int = 26916) -> DataFrame:
    """One row, ``value``: points as a feature collection, coordinates rounded to 3 digits (half to even)."""
    props = [c for c in features.columns if c not in ("x", "y")]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.bround("x", 3), F.bround("y", 3)).alias("coordinates"))
    f = features.select(F.struct(F.lit("Feature").alias("type"), "id", F.struct(*props).alias("properties"), geometry.alias("geometry")).alias("f"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit(f"urn:ogc:def:crs:EPSG::{epsg}").alias("name")).alias("properties"))
    return f.agg(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), "features")).alias("value"))


def write_text(value: str, path: str) -> None:
    """A small document, replaced as a whole."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(value)
    os.replace(part, path)


def manifest_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """item_id, datetime, assets, fetched_at (and year or cloud_cover) of a manifest; none where it is missing or broken."""
    if kind == "naip":
        rows = read_tolerant(spark, path, NAIP_MANIFEST).select(F.explode("cycles").alias("c")).select(F.col("c.year").alias("year"), F.explode("c.items").alias("i"))
        return rows.select("year", "i.*")
    return read_tolerant(spark, path, S2_MANIFEST).select(F.explode("scenes").alias("i")).select("i.*")


def unsigned_url(signed, original):
    """The original link where there is one, else the link without its query string."""
    return F.coalesce(original, F.get(F.split(signed, "\\?"), F.lit(0)))


def read_npy(spark: SparkSession, folder: str) -> DataFrame:
    """model_id, bands, source_cycle, chip_id, embedding from ``model__bands__cycle.npy`` files and their ``.json`` sidecars.

    Rows must match the sidecar's ids and be float32.
    """

    def load(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, data, side in zip(*(b.column(c).to_pylist() for c in ("stem", "data", "side")), strict=True):
                m, meta = np.load(io.BytesIO(data)), json.loads(side)
                if m.dtype != np.float32 or m.ndim != 2 or len(m) != len(meta["chip_ids"]):
                    raise ValueError(f"{name}: {m.dtype} {m.shape} for {len(meta['chip_ids'])} ids")
                model, bands, cycle = name.split("__")
                for at in range(0, len(m), 4096):
                    rows = m[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(rows)) for v in (model, bands, cycle)), pa.array(meta["chip_ids"][at : at + 4096]), pa.array(list(rows), pa.list_(pa.float32()))], names=["model_id", "bands", "source_cycle", "chip_id", "embedding"])

    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.(npy|json)$", "")
    arrays = files.filter(F.endswith(name, F.lit(".npy"))).select(stem.alias("stem"), F.col("content").alias("data"))
    sides = files.filter(F.endswith(name, F.lit(".json"))).select(stem.alias("stem"), F.decode("content", "UTF-8").alias("side"))
    return arrays.join(sides, "stem").mapInArrow(load, "model_id string, bands string, source_cycle string, chip_id string, embedding array<float>")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"))
