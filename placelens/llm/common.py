"""Shared pieces of the corpus operators: the shared folder, row keys and two-level running totals."""

from __future__ import annotations

import contextlib
import math
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch

#: A word is a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files go as soon as the write that made them has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[tuple[str, str], list[str]] = {}
_run: ContextVar[str] = ContextVar("run", default="")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset (tests)."""
    return scratch(spark)


@contextlib.contextmanager
def owned_by(run: str):
    """What ``materialise`` writes inside belongs to ``run``, and ``release`` deletes it by that name."""
    token = _run.set(run)
    try:
        yield
    finally:
        _run.reset(token)


@contextlib.contextmanager
def cleaned_up(spark: SparkSession):
    """Inside, shuffle files of a query are deleted when it ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/placelens-{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.setdefault((spark.sparkContext.applicationId, _run.get()), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, run: str = "", needed_by: DataFrame | None = None) -> None:
    """Delete what ``materialise`` wrote for ``run``, but for tables that ``needed_by`` reads.

    Only call it once no other DataFrame of that run is needed any more.
    """
    key = (spark.sparkContext.applicationId, run)
    written = _written.pop(key, [])
    read = needed_by.inputFiles() if written and needed_by is not None else []
    for path in written:
        if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in read):
            _written.setdefault(key, []).append(path)
        else:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "__row") -> tuple[DataFrame, str]:
    """``df`` with a number for each row under a free name, written: numbers stay with their rows whatever plan reads them.

    A number drawn in two plans over anything but plain files (a shuffle, a join, a sort) may fall on different rows.
    """
    name = free_name(df, name)
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def source_key(col: str = "source") -> Column:
    """A non-null key of a nullable name, so that joins and windows keep null as a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def shuffle_key(seed: int, *cols: str) -> Column:
    """A seeded 64-bit hash: the order of a reproducible shuffle."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def buckets_for(rows: int) -> int:
    """About the square root of the rows, so that neither level of ``running_total`` sees a large group."""
    return max(64, math.isqrt(max(rows, 1)))


def hash_bucket(key: str, buckets: int) -> Column:
    """The bucket of a signed 64-bit hash; rises with the hash."""
    return F.least(F.floor((F.col(key).cast("double") / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before in ``order``.

    ``bucket`` must not fall as ``order`` rises. Totals run over buckets first and then inside each, so a source that
    holds most rows is still spread over all buckets. ``df`` is read twice: pass something materialised.
    """
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__sum"))
    before = (Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(*before)
    base = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(*before)
    total = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return total.join(base, [*keys, "__bucket"]).withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop("__bucket", "__base", "__in")


#: Ids up to this number (about 64 MB) are sent to all tasks; more are joined by a shuffle of both sides.
SENT_IDS = 2_000_000


def sent_if_small(ids: DataFrame, most: int = SENT_IDS) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most ``most`` rows, so that texts it is joined to stay where they are."""
    return F.broadcast(ids) if ids.count() <= most else ids


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
