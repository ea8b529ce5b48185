"""The chip_embeddings table: Parquet partitioned by experiment, model, bands and cycle, keyed by chip.

Upsert rewrites the partitions (experiment, model, bands, cycle) that hold a new row or an old row of the same key; delete
removes whole partitions. There is no table format with transactions here: one writer at a time, and readers should not
read while a partition is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import CHIP_EMBEDDINGS, STORE_KEY, STORE_PARTITIONS


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, folder: str) -> None:
    """Make the table if it is not there."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        spark.createDataFrame([], CHIP_EMBEDDINGS).write.partitionBy(*STORE_PARTITIONS).parquet(folder)
        fs.mkdirs(path)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHIP_EMBEDDINGS).parquet(folder)


def columns(df: DataFrame) -> DataFrame:
    """In the order of the table; without an experiment it is "default"."""
    if "experiment_id" not in df.columns:
        df = df.withColumn("experiment_id", F.lit("default"))
    return df.select([c.split()[0] for c in CHIP_EMBEDDINGS.split(", ")])


def upserted(old: DataFrame, new: DataFrame, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The rows after an upsert: new rows win over old ones of the same key; of repeated new rows one stays.

    That is the one with the largest ``order``; ties, and rows without an ``order``, are settled by a hash of the row.
    """
    key = key or STORE_KEY
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    by = [F.desc("__new"), *([F.desc(order)] if order else []), F.xxhash64(*new.columns)]
    w = Window.partitionBy(*key).orderBy(*by)
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__new", "__r")


#: Rows in a file of the table, about.
ROWS_A_FILE = 1_000_000


def partition_folders(rows: DataFrame, cells: DataFrame | None = None) -> list[str]:
    """The folders that hold the rows of a scan of the table, as Spark wrote (and escaped) them; one a partition."""
    at = rows.select(*STORE_PARTITIONS, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("__folder")).distinct()
    if cells is not None:
        at = at.join(cells, STORE_PARTITIONS, "left_semi")
    return [r["__folder"] for r in at.select("__folder").collect()]


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.delete(path, True) and fs.exists(path):
            raise OSError(f"could not delete {folder}")


def _replace(spark: SparkSession, folder: str, touched: DataFrame, parts: DataFrame) -> None:
    """Write the touched partitions: staged beside the table first, as they may be read from what they replace."""
    staging = f"{folder.rstrip('/')}__staging_{uuid.uuid4().hex}"
    touched.write.parquet(staging)
    staged = spark.read.schema(touched.schema).parquet(staging)
    left = staged.groupBy(*STORE_PARTITIONS).count()
    emptied = partition_folders(read(spark, folder), parts.join(left, STORE_PARTITIONS, "left_anti"))
    files = max(1, -(-(left.agg(F.max("count")).first()[0] or 0) // ROWS_A_FILE))
    staged.repartition(*STORE_PARTITIONS, F.pmod(F.xxhash64("chip_id"), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*STORE_PARTITIONS).parquet(folder)
    _remove(spark, emptied)  # nothing remains of these
    path, fs = _path(spark, staging)
    fs.delete(path, True)
    spark.catalog.refreshByPath(folder)


def upsert(spark: SparkSession, folder: str, new: DataFrame) -> None:
    """Insert rows, in place of those of the same key. Chips whose id names their cycle stay in it, so the table's keys are not read for them."""
    create(spark, folder)
    new = columns(new)
    # The key has no cycle: a chip that moves to another cycle must leave the old one.
    loose = new.filter(~F.coalesce(F.contains("chip_id", F.concat(F.lit("_"), "source_cycle", F.lit("_"))), F.lit(False))).select(*STORE_KEY).distinct()
    cells = new.select(*STORE_PARTITIONS).distinct()
    if not loose.isEmpty():
        moved = read(spark, folder).select(*STORE_PARTITIONS, "chip_id").join(loose, STORE_KEY, "left_semi")
        cells = cells.union(moved.select(*STORE_PARTITIONS)).distinct()
    old = read(spark, folder).join(cells, STORE_PARTITIONS, "left_semi")
    _replace(spark, folder, columns(upserted(columns(old), new)), cells)


def delete(spark: SparkSession, folder: str, model_id: str, bands: str | None = None, experiment_id: str | None = None) -> None:
    """Delete a model's rows; ``bands=None`` means all bands. A folder that can't be removed is an error."""
    rows = read(spark, folder).filter(F.col("model_id") == model_id)
    for c, v in (("bands", bands), ("experiment_id", experiment_id)):
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    _remove(spark, partition_folders(rows))
    spark.catalog.refreshByPath(folder)


def without(rows: DataFrame, test: Column) -> DataFrame:
    """The rows that remain after a delete; a null test keeps the row."""
    return rows.filter(~F.coalesce(test, F.lit(False)))


def join_chips(embeddings: DataFrame, chips: DataFrame, strict: bool = True) -> DataFrame:
    """Vectors with their chip's boxes, by cycle and chip id; a vector without chip is an error."""
    if strict:
        lost = orphans(embeddings, chips).limit(3).collect()
        if lost:
            raise ValueError(f"not in chip_index: {[r['chip_id'] for r in lost]}")
    index = chips.select(F.col("cycle").alias("source_cycle"), "chip_id", "inside_aoi", "cx", "cy", "xmin", "ymin", "xmax", "ymax")
    joined = embeddings.drop("inside_aoi", "cx", "cy", "xmin", "ymin", "xmax", "ymax", "chip_location_id").join(index, ["source_cycle", "chip_id"])
    return joined.withColumn("chip_location_id", text.location_of_chip(F.col("chip_id"), F.col("source_cycle")))


def orphans(embeddings: DataFrame, chips: DataFrame) -> DataFrame:
    return embeddings.join(chips.select(F.col("cycle").alias("source_cycle"), "chip_id"), ["source_cycle", "chip_id"], "left_anti")


def load(spark: SparkSession, folder: str, embeddings: DataFrame, chips: DataFrame, cycles: list[str] | None = None, clear: bool = False) -> dict[str, int]:
    """Join with the chip index and upsert; returns rows a cycle. embeddings: model_id, bands, source_cycle, chip_id, embedding."""
    if cycles:
        absent = set(cycles) - {r[0] for r in chips.select("cycle").distinct().collect()}
        if absent:
            raise ValueError(f"cycles not in the index: {sorted(absent)}")
        embeddings = embeddings.filter(F.col("source_cycle").isin(*cycles))
    create(spark, folder)
    rows = join_chips(embeddings, chips)  # raises before anything is deleted
    if clear:
        by = ["model_id", "bands", *(["experiment_id"] if "experiment_id" in embeddings.columns else [])]
        for r in embeddings.select(*by).distinct().collect():
            delete(spark, folder, **r.asDict())
    upsert(spark, folder, rows)
    return {r["source_cycle"]: r["count"] for r in rows.groupBy("source_cycle").count().collect()}


def cycle_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_cycle").agg(
        F.count("*").alias("n_rows"), F.count_if("inside_aoi").alias("n_inside"), F.count_distinct("chip_location_id").alias("n_locations"), F.count_distinct("model_id", "bands").alias("n_models")
    )


def models(rows: DataFrame, bands: str) -> DataFrame:
    return rows.filter(F.col("bands") == bands).select("model_id").distinct()


def models_of_files(paths: DataFrame, bands: str) -> DataFrame:
    """Model ids in file names ``model__bands__cycle.npy``; other names are passed over."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split(F.regexp_replace(name, r"\.npy$", ""), "__")
    return paths.filter(F.endswith(name, F.lit(".npy")) & (F.size(parts) == 3) & (F.get(parts, F.lit(1)) == bands)).select(F.get(parts, F.lit(0)).alias("model_id")).distinct()
