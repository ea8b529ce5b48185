"""Embedding cells (one model, bands and cycle) with their provenance: written once, checked, and skipped while they are not stale.

A cell is a folder of Parquet files, rows in the order of ``position``, beside a sidecar of one row: what it was made from and
with, how long it took, the digest of each file, and a digest of the order of its ids. Row counts, dimensions and norms are
observed while the cell is written, without a second pass.
"""

from __future__ import annotations

import io
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import catalog
from .catalog import file_system

CELL = ["model_id", "bands", "source_cycle"]
ROWS_A_FILE = 100_000
SIDECAR = (
    "model_id string, bands string, source_cycle string, n_chips long, embed_dim int, index_sha string, weights_sha string, tag string, order_digest string, "
    "seconds double, chips_per_sec double, generated_at timestamp, files array<struct<name: string, sha256: string>>"
)


def order_digest(position: Column, chip: Column) -> Column:
    """An aggregate that depends on which id stands at which position: sums of hashes, so tasks add up and nothing is gathered."""
    return F.sum(F.xxhash64(position.cast("long"), chip).cast("decimal(38,0)")).cast("string")


def orders(rows: DataFrame, by: list[str], position: str = "position", chip: str = "chip_location_id") -> DataFrame:
    """by, n, digest: cells with the same ids in the same order have the same."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), order_digest(F.col(position), F.col(chip)).alias("digest"))


def order_of_cycles(rows: DataFrame, position: str = "position", chip: str = "chip_location_id") -> DataFrame:
    """model_id, bands, source_cycle, n, same: whether a cycle has the ids of the model's first cycle, in their order."""
    per = orders(rows, CELL, position, chip)
    first = per.groupBy("model_id", "bands").agg(F.min_by(F.struct("n", "digest"), "source_cycle").alias("f"))
    return per.join(first, ["model_id", "bands"]).select(*CELL, "n", ((F.col("n") == F.col("f.n")) & (F.col("digest") == F.col("f.digest"))).alias("same"))


def check_order(rows: DataFrame, position: str = "position", chip: str = "chip_location_id") -> None:
    """ValueError that names cells whose order differs from their model's first cycle."""
    wrong = order_of_cycles(rows, position, chip).filter("NOT same").orderBy(*CELL).limit(5).collect()
    if wrong:
        raise ValueError("order of ids differs: " + ", ".join("/".join(r[c] for c in CELL) for r in wrong))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cell_folder(folder: str, kind: str, cell: tuple[str, str, str]) -> str:
    for part in cell:
        if not part or any(c in part for c in '/\\:*?"<>|=%') or part.startswith("."):
            raise ValueError(f"{part!r} cannot name a cell")
    return f"{folder.rstrip('/')}/{kind}/" + "/".join(f"{n}={v}" for n, v in zip(CELL, cell, strict=True))


def write_cell(rows: DataFrame, folder: str, cell: tuple[str, str, str], facts: dict[str, str | None]) -> dict:
    """Write rows (position, chip_id, embedding) as a cell with its sidecar, in place of an older one; the sidecar's values.

    Vectors of unit norm and one length, and distinct positions without a gap, or ValueError and no cell. ``facts``: index_sha,
    weights_sha, tag. The old sidecar goes first and the new one comes last, so a cell that was cut short is stale.
    """
    spark, data = rows.sparkSession, cell_folder(folder, "cells", cell)
    _delete(spark, cell_folder(folder, "sidecars", cell))
    seen, size = Observation(), F.size("embedding")
    off = F.coalesce(F.abs(vectors.norm(F.col("embedding")) - 1) >= 1e-3, F.lit(True))
    watched = rows.select(F.col("position").cast("long").alias("position"), "chip_id", F.col("embedding").cast("array<float>").alias("embedding")).repartitionByRange("position").sortWithinPartitions("position").observe(  # above the shuffle, whose ranges are sampled in a run of their own
        seen, F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(off).alias("off"), F.min("position").alias("first"), F.max("position").alias("last"), order_digest(F.col("position"), F.col("chip_id")).alias("order")
    )
    began = time.monotonic()
    watched.write.mode("overwrite").option("maxRecordsPerFile", ROWS_A_FILE).parquet(data)
    seconds = time.monotonic() - began
    m = seen.get
    n = m["n"]
    faults = [text for wrong, text in (
        (not n, "no rows"), (n and (m["least"] != m["most"] or m["least"] < 1), f"vectors of {m['least']} to {m['most']} components"), (m["off"], f"{m['off']} vectors without unit norm"),
        (n and (m["first"] != 0 or m["last"] != n - 1 or not spark.read.parquet(data).groupBy("position").count().filter("count > 1").isEmpty()), "positions are not 0 to n - 1"),
    ) if wrong]
    if faults:
        _delete(spark, data)
        raise ValueError(f"{'/'.join(cell)}: " + "; ".join(faults))
    made = digests(spark, data).agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("files"))  # a row a file of the cell
    values = {**dict(zip(CELL, cell, strict=True)), "n_chips": n, "embed_dim": m["least"], **{k: facts.get(k) for k in ("index_sha", "weights_sha", "tag")}, "order_digest": m["order"], "seconds": round(seconds, 2), "chips_per_sec": round(n / max(seconds, 1e-9), 2)}
    known = [F.lit(values[c]).cast(t).alias(c) for c, t in (f.split(" ", 1) for f in SIDECAR.split(", ")[:11])]
    side = made.select(*known, F.current_timestamp().alias("generated_at"), "files")
    side.coalesce(1).write.mode("overwrite").json(cell_folder(folder, "sidecars", cell))
    return values


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name, sha256 of the files of a cell."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each whole cell."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/sidecars")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SIDECAR)
    return spark.read.schema(SIDECAR).option("recursiveFileLookup", True).json(path.toString())


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """model_id, bands, source_cycle, position, chip_id, embedding of the cells that have a sidecar."""
    rows = spark.read.schema("position long, chip_id string, embedding array<float>, model_id string, bands string, source_cycle string").parquet(f"{folder.rstrip('/')}/cells")
    return rows.join(F.broadcast(sidecars(spark, folder).select(*CELL)), CELL, "left_semi").select(*CELL, "position", "chip_id", "embedding")


def damaged(spark: SparkSession, folder: str) -> list[str]:
    """Names of files whose content, or presence, is not what their sidecar says."""
    told = sidecars(spark, folder).select(*CELL, F.explode("files").alias("f")).select(*CELL, "f.*")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{folder.rstrip('/')}/cells")
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return sorted(r["name"] for r in told.join(found, "name", "left").filter(~F.col("sha256").eqNullSafe(F.col("found"))).select("name").collect())


def embed_stale(spark: SparkSession, folder: str, wanted: list[tuple[tuple[str, str, str], dict]], embed: Callable[[tuple[str, str, str]], DataFrame]) -> list[tuple[str, str, str]]:
    """Embed and write the wanted cells that are absent or were made from another index, weights or tag; which those were."""
    now = spark.createDataFrame([(*cell, facts.get("index_sha"), facts.get("weights_sha"), facts.get("tag")) for cell, facts in wanted], ", ".join(f"{c} string" for c in (*CELL, "index_sha", "weights_sha", "tag")))
    todo = {tuple(r) for r in catalog.stale(sidecars(spark, folder).select(*now.columns), now, CELL).select(*CELL).collect()}  # a row a cell
    for cell, facts in wanted:
        if cell in todo:
            write_cell(embed(cell), folder, cell, facts)
    return [cell for cell, _ in wanted if cell in todo]


def write_npy(rows: DataFrame, folder: str, most_rows: int = 1_000_000) -> DataFrame:
    """Cells (CELL, position, chip_id, embedding) as ``model__bands__cycle.npy`` and ``.json`` for ``documents.read_npy``; files and rows.

    One file a cell is made in one task: an exchange format for cells of at most ``most_rows`` rows, more are an error.
    """
    import numpy as np
    import pyarrow as pa

    def save(key, table):
        cell = [k.as_py() for k in key]
        if table.num_rows > most_rows:
            raise ValueError(f"{'/'.join(cell)} has over {most_rows} rows")
        table = table.sort_by("position")
        vectors_, ids = np.array(table.column("embedding").to_pylist(), np.float32), table.column("chip_id").to_pylist()
        buffer = io.BytesIO()
        np.save(buffer, vectors_)
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        side = {"model_id": cell[0], "bands": cell[1], "cycle": cell[2], "n_chips": len(ids), "embed_dim": int(vectors_.shape[1]), "chip_ids": ids}
        for end, data in ((".npy", buffer.getvalue()), (".json", json.dumps(side).encode())):
            name = f"{root}/{'__'.join(cell)}{end}"
            with system.open_output_stream(f"{name}.part") as f:
                f.write(data)
            system.move(f"{name}.part", name)
        return pa.table([[c] for c in cell] + [[len(ids)]], names=[*CELL, "n"])

    return rows.select(*CELL, "position", "chip_id", "embedding").groupBy(*CELL).applyInArrow(save, "model_id string, bands string, source_cycle string, n long")
