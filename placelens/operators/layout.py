"""Physical layouts of the store: footprints in tiles along a space-filling curve, and rows bucketed by place.

Tiles: every row lies in the square of ``side`` metres that holds its centre; tile columns and rows are partitions, and rows follow
the Morton curve within a tile, so that row groups have small boxes. A box or distance filter becomes ranges of tile columns and
rows, which prune whole folders, and its own predicates, which skip row groups.

Buckets: rows of a place lie in one bucket, so pooling over cycles and joins by place need no exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schemas import CHIP_EMBEDDINGS
from . import search, store

#: Rows in a file of a tile, about.
ROWS_A_FILE = 250_000


@dataclass(frozen=True)
class Tiles:
    """``side`` of a tile in metres; ``reach``: no edge of a chip is farther from its centre. Coordinates from -origin up."""

    side: float = 28_672.0
    reach: float = geo.SIZE / 2
    origin: float = 16_777_216.0

    def at(self, metres):
        """The tile number along one axis, of a Column or a number."""
        place = (metres + self.origin) / self.side
        return F.floor(place).cast("int") if isinstance(metres, Column) else math.floor(place)

    def predicates(self, request: search.Request) -> list[Column]:
        """What the filters of a request say of tiles; a row that a filter keeps is in a tile that these keep."""
        boxes = []
        if request.bbox:
            w, s, e, n = request.bbox
            boxes.append((w - self.reach, s - self.reach, e + self.reach, n + self.reach))
        if request.near:
            x, y, r = request.near
            boxes.append((x - abs(r), y - abs(r), x + abs(r), y + abs(r)))
        return [F.col(c).between(self.at(low), self.at(high)) for w, s, e, n in boxes for c, low, high in (("tile_x", w, e), ("tile_y", s, n))]


TILED = f"{CHIP_EMBEDDINGS}, tile_x int, tile_y int"


def write_tiled(rows: DataFrame, folder: str, tiles: Tiles = Tiles()) -> None:
    """Write the store's rows in tiles; a row whose box reaches farther than ``tiles.reach`` from its centre is an error.

    A tile with many rows is dealt to several files, each a stretch of the curve (range partitioning splits any tile).
    """
    far = F.greatest(F.col("cx") - F.col("xmin"), F.col("xmax") - F.col("cx"), F.col("cy") - F.col("ymin"), F.col("ymax") - F.col("cy"))
    wide = F.when(far <= tiles.reach, tiles.at(F.col("cx"))).otherwise(F.raise_error(F.lit(f"a chip reaches over {tiles.reach} m from its centre")).cast("int"))
    fine = tiles.reach  # cells of the curve within a tile
    curve = geo.morton(F.floor((F.col("cx") + tiles.origin) / fine), F.floor((F.col("cy") + tiles.origin) / fine))
    placed = store.columns(rows).withColumns({"tile_x": wide, "tile_y": tiles.at(F.col("cy")), "__curve": curve})
    files = max(1, -(-placed.count() // ROWS_A_FILE))
    by = ["tile_x", "tile_y", "__curve"]
    placed.repartitionByRange(files, *by).sortWithinPartitions(*by).drop("__curve").write.partitionBy("tile_x", "tile_y").parquet(folder)


def read_tiled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TILED).parquet(folder)


def in_tiles(rows: DataFrame, request: search.Request, tiles: Tiles = Tiles()) -> DataFrame:
    """The rows of the tiles that a request can find something in."""
    for test in tiles.predicates(request):
        rows = rows.filter(test)
    return rows


def search_tiled(spark: SparkSession, folder: str, query, request: search.Request, tiles: Tiles = Tiles()) -> DataFrame:
    """``search`` that opens only the files of those tiles."""
    return search.search(in_tiles(read_tiled(spark, folder), request, tiles).drop("tile_x", "tile_y"), query, request)


def files_read(rows: DataFrame) -> int:
    """How many files a scan of a table opens once its filters have pruned partitions."""
    return rows.select("_metadata.file_path").distinct().count()


def save_bucketed(rows: DataFrame, table: str, folder: str, buckets: int) -> DataFrame:
    """Save the store's rows as a table bucketed and sorted by place: one file a bucket; returns the table."""
    rows = store.columns(rows).repartition(buckets, "chip_location_id")
    rows.write.bucketBy(buckets, "chip_location_id").sortBy("chip_location_id").option("path", folder).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def join_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables bucketed alike by place: a merge join without an exchange."""
    return left.join(right.hint("merge"), "chip_location_id")
