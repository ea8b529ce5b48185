"""Catalog items as a data source whose filters are pushed into the reader.

A catalog is a folder of item files by year, ``year=2018/*.json``, one GeoJSON feature a line (``write_items``). The reader takes
comparisons of the item's columns with constants: those on ``year`` and ``ts`` leave out whole files before any is opened, the
others leave out items before they reach Spark. Each ``SPLIT`` bytes of a file are a partition, which reads line by line.

Files are reached through Arrow's file systems (local, S3, GCS, HDFS), from the driver for the listing and from tasks for reading.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

ITEMS = "item_id string, ts timestamp, cloud_cover double, xmin double, ymin double, xmax double, ymax double, year int"
COLUMNS = [f.split()[0] for f in ITEMS.split(", ")]
#: What a filter says of a value that is not null.
TESTS = {EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x, IsNotNull: lambda v, x: True}
#: Bytes of a file that one task reads, and bytes it holds at a time (but for longer lines).
SPLIT, CHUNK = 1 << 25, 1 << 20


@dataclass
class ItemFile(InputPartition):
    """The lines of a file that begin from byte ``start`` to before ``end`` (None: to the last)."""

    path: str
    year: int
    start: int = 0
    end: int | None = None


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def holds(filters: Sequence[Filter], item: dict) -> bool:
    """Whether all filters keep an item; a null is kept by none."""
    return all((v := item[f.attribute[0]]) is not None and TESTS[type(f)](v, getattr(f, "value", None)) for f in filters)


def may_hold(filters: Sequence[Filter], year: int) -> bool:
    """Whether the items of a year can pass the filters on ``year`` and ``ts``."""
    for f in filters:
        value = getattr(f, "value", None)
        if f.attribute == ("year",) and not TESTS[type(f)](year, value):
            return False
        if f.attribute == ("ts",) and value is not None:
            years = [v.year for v in (value if isinstance(f, In) else [value])]
            if isinstance(f, (EqualTo, In)) and year not in years or isinstance(f, (GreaterThan, GreaterThanOrEqual)) and year < years[0] or isinstance(f, (LessThan, LessThanOrEqual)) and year > years[0]:
                return False
    return True


def lines_of(f, start: int, end: int | None) -> Iterator[bytes]:
    """The lines of a file that begin from byte ``start`` to before ``end``; one that crosses ``end`` is read to its own end."""
    at = max(start - 1, 0)  # a line begins at ``start`` if the byte before it ends one
    f.seek(at)
    rest, skip = b"", start > 0
    while chunk := f.read(CHUNK):
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for line in parts:
            begin, at = at, at + len(line) + 1
            if end is not None and begin >= end:
                return
            if skip:
                skip = False
            else:
                yield line
    if rest and not skip and (end is None or at < end):
        yield rest


class CatalogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what ``holds`` can tell; the rest stays with Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in COLUMNS and not (isinstance(f, In) and None in f.value):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """The files of years that may hold an item."""
        from pyarrow import fs

        system, root = file_system(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder = next((p for p in info.path.split("/") if p.startswith("year=")), None)
            if info.type == fs.FileType.File and folder and info.base_name.endswith(".json") and folder[5:].lstrip("-").isdigit() and may_hold(self.filters, int(folder[5:])):
                found += [ItemFile(info.path, int(folder[5:]), at, min(at + SPLIT, info.size)) for at in range(0, info.size, SPLIT)]
        return found or [ItemFile("", 0)]

    def read(self, partition: ItemFile) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as f:
            for line in lines_of(f, partition.start, partition.end):
                if line.strip():
                    item = parsed(json.loads(line), partition.year)
                    if holds(self.filters, item):
                        yield tuple(item[c] for c in COLUMNS)


def parsed(feature: dict, year: int) -> dict:
    """The columns of a feature; what is absent is null."""
    properties, box = feature.get("properties") or {}, feature.get("bbox") or [None] * 4
    when = properties.get("datetime")
    ts = datetime.datetime.fromisoformat(when.replace("Z", "+00:00")) if when else None
    ts = ts.replace(tzinfo=datetime.timezone.utc) if ts is not None and ts.tzinfo is None else ts
    cloud = properties.get("eo:cloud_cover")
    return {"item_id": feature.get("id"), "ts": ts, "cloud_cover": None if cloud is None else float(cloud), **{c: None if v is None else float(v) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True)}, "year": year}


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_items"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options["path"])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of a catalog; filters on its columns are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    return spark.read.format("catalog_items").load(path)


def write_items(items: DataFrame, path: str, files: int = 1) -> None:
    """A catalog of items (item_id, ts, cloud_cover, xmin..ymax) by year, ``files`` files a year; items without a time are under year 0."""
    feature = items.select(
        F.lit("Feature").alias("type"), F.col("item_id").cast("string").alias("id"), F.when(F.col("xmin").isNotNull(), F.array("xmin", "ymin", "xmax", "ymax")).alias("bbox"),
        F.struct(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover")).alias("properties"),
        F.coalesce(F.year(F.to_utc_timestamp("ts", F.current_timezone())), F.lit(0)).alias("year"),
    )
    feature.repartition("year", F.pmod(F.xxhash64("id"), F.lit(files))).write.partitionBy("year").json(path)
