"""Proportional stratified interleaving: every shard gets the mixture of the whole.

Rows are ranked in a seeded shuffle within each source, ordered by fractional rank ``(2 * rank + 1) / (2 * rows of the
source)`` and cut into contiguous shards whose row counts differ by one at most (law ``rows``).

Defined results: a null source is a source of its own; null text counts no bytes and has the CRC of the empty string;
null or repeated ids are rows like any other (rows equal in id and text may swap their slots); an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, hash_bucket, materialise, running_total, shuffle_key, source_key


def interleave_shards(docs: DataFrame, shards: int = 24, seed: int = 7, overhead: int = 8) -> DataFrame:
    """doc_id, source, size, text_crc32, shard (from 0), slot (gapless from 0 in its shard) of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id", "source", source_key().alias("__source"),
            (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.lit(seed), "doc_id", text).alias("__order"),
        ),
        "shard-rows",
    )
    n = rows.count()
    buckets = buckets_for(n)
    order = ["__order", "doc_id", "text_crc32", "size"]
    ranked = running_total(rows.withColumn("__one", F.lit(1)), ["__source"], hash_bucket("__order", buckets), order, "__one", "__rank")
    counts = rows.groupBy("__source").agg(F.count("*").alias("__rows"))
    placed = materialise(ranked.join(counts, "__source").withColumn("__at", (2 * F.col("__rank") + 1) / (2 * F.col("__rows"))), "shard-ranks")
    bucket = F.least(F.floor(F.col("__at") * buckets), F.lit(buckets - 1)).cast("int")
    placed = running_total(placed, [], bucket, ["__at", "__source", "__rank"], "__one", "__place")
    # Place p is in shard s if ceil(s * n / shards) <= p: integer arithmetic, so no row is lost to rounding.
    shard = F.expr(f"(__place * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(__shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("__shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("__shard").cast("int").alias("shard"), (F.col("__place") - first).cast("long").alias("slot")
    )
