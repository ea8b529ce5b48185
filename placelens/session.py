"""SparkSession factory; settings come from arguments, then the environment, then defaults."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def resolve(name: str, given: str | None, default: str) -> str:
    """``given``, else the environment variable ``name`` unless it is blank, else ``default``."""
    return given or os.environ.get(name, "").strip() or default


def get_session(master: str | None = None, shuffle_partitions: str | None = None, app: str = "placelens") -> SparkSession:
    """UTC, adaptive execution and Arrow on; the cluster's own settings win where they are set."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if wanted := resolve("PLACELENS_MASTER", master, ""):
        builder = builder.master(wanted)
    if parts := resolve("PLACELENS_SHUFFLE_PARTITIONS", shuffle_partitions, ""):
        builder = builder.config("spark.sql.shuffle.partitions", parts)
    return builder.getOrCreate()


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder for tables that queries write: ``spark.checkpoint.dir``, which all executors share; a local master may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="placelens-"))
        folder = _own[0]
    return folder.rstrip("/")
