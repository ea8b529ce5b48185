"""Low-discrepancy source schedule: mix sources to target weights.

Words of a source form one stream of its documents in a seeded shuffle, cut into blocks of equal token counts. Slot i of
the schedule maps the i-th van der Corput point through the cumulative targets to a source; the rank of a slot among
those of its source picks the source's block (rank modulo blocks: the second pass starts over). Each document takes
what the scheduled blocks hold of it.

Defined results: null text has no words; a null source is a source of its own and comes last; a source without words
gets target 0; repeated rows are rows of their own; an empty table gives an empty result; other columns are not read.
Sources' totals are collected, one row a source, never documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, buckets_for, free_name, hash_bucket, materialise, numbered, running_total, source_key


def share_out(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Split ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again by weight."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, most * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def van_der_corput(i: np.ndarray) -> np.ndarray:
    """The base-2 radical inverse: the bits of ``i`` mirrored behind the point."""
    x = i.astype(np.uint64)
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = ((x >> s) & m) | ((x & m) << s)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def schedule(spark, sources: list[tuple[str, int, float]], block_tokens: int, chunk: int = 65536) -> DataFrame:
    """__source, slot, rank, block of each slot; ``sources``: key, size and target of each."""
    total = sum(t for _, _, t in sources)
    slots = round(total / block_tokens)
    live = [(k, -(-s // block_tokens)) for k, s, t in sources if t > 0]
    ends = np.cumsum([t for _, _, t in sources if t > 0]) / total if live else np.array([])

    def draw(batches):
        for pdf in batches:
            at = np.minimum(np.searchsorted(ends, van_der_corput(pdf["id"].to_numpy()), side="right"), len(live) - 1)
            yield pd.DataFrame({"slot": pdf["id"], "__s": at.astype("int32")})

    drawn = spark.range(slots if live else 0).mapInPandas(draw, "slot long, __s int").withColumn("__one", F.lit(1))
    ranked = running_total(materialise(drawn, "mix-slots"), ["__s"], (F.col("slot") / chunk).cast("int"), ["slot"], "__one", "rank")
    names = spark.createDataFrame([(i, k, b) for i, (k, b) in enumerate(live)], "__s int, __source string, __blocks long")
    ranked = ranked.join(F.broadcast(names), "__s")
    return ranked.filter("rank < 2 * __blocks").select("__source", "slot", "rank", (F.col("rank") % F.col("__blocks")).alias("block"))


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block_tokens: int = 64, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``; also ``__row``, unique to each row.

    ``weights`` repeat over the sources in code point order, null last. ``share`` of all words is given out, at most
    ``most`` (up to 2) times a source's words. A document is taken at most twice as blocks are used at most twice.
    """
    numbers = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "source", "text")
    return mixed_rows(materialise(stream_rows(numbers, seed), "mix-rows"), weights, share, most, block_tokens).drop("__order")


def stream_rows(docs: DataFrame, seed: int) -> DataFrame:
    """docs: __row, doc_id, source and text. A narrow row for each, without its text."""
    return docs.select(
        "__row", "doc_id", "source", source_key().alias("__source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__order"),
    )


def mixed_rows(rows: DataFrame, weights, share: float, most: float, block_tokens: int) -> DataFrame:
    spark = rows.sparkSession
    totals = rows.groupBy("__source", "source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # one row a source
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["s"] for r in totals]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(totals))], share * sum(sizes), most)
    plan = [(r["__source"], s, t) for r, s, t in zip(totals, sizes, targets, strict=True)]
    block_tokens = block_of(sizes, targets, block_tokens)
    slots = schedule(spark, plan, block_tokens)
    uses = slots.groupBy("__source", "block").agg(F.count("*").alias("__uses"))
    at = running_total(rows, ["__source"], hash_bucket("__order", buckets_for(sum(r["n"] for r in totals))), ["__order", "doc_id", "size", "__row"], "size", "__from")
    at = at.withColumn("__to", F.col("__from") + F.col("size"))
    first, last = F.expr(f"__from div {block_tokens}"), F.expr(f"(__to - 1) div {block_tokens}")
    parts = at.filter("size > 0").select("__row", "__source", "__from", "__to", F.explode(F.sequence(first, last)).alias("block"))
    held = F.least(F.col("__to"), (F.col("block") + 1) * block_tokens) - F.greatest(F.col("__from"), F.col("block") * block_tokens)
    taken = parts.join(uses, ["__source", "block"]).groupBy("__row").agg(F.sum(held * F.col("__uses")).alias("taken"))
    goal = spark.createDataFrame(plan, "__source string, source_size long, target double")
    return rows.join(taken, "__row", "left").join(F.broadcast(goal), "__source").select(
        "__row", "__order", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def block_of(sizes: list[int], targets: list[float], least: int, slots: int = 20_000) -> int:
    """Words in a block: ``least``, or more where every source still has about ``slots`` blocks and so many slots of its target."""
    smallest = min((min(s, t) for s, t in zip(sizes, targets, strict=True) if t > 0), default=0)
    return max(least, int(smallest) // slots)


def mixed_documents(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block_tokens: int = 64, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as often as they are taken: whole documents, taken / size times, the fraction by a seeded draw.

    The draw is a hash of the document, so reruns agree; documents without words stay once. Columns stay as they are.
    """
    own, row = numbered(docs)
    rows = stream_rows(own.select(F.col(row).alias("__row"), "doc_id", "source", "text"), seed)
    got = mixed_rows(materialise(rows, "mix-rows"), weights, share, most, block_tokens)
    draw = F.xxhash64(F.lit(seed + 1), "doc_id", "__order").cast("double") / F.lit(2.0**64) + 0.5
    times = F.coalesce(F.floor(F.col("taken") / F.col("size") + draw), F.lit(1)).cast("int")
    got = got.select(F.col("__row").alias("r"), times.alias("n")).filter("n > 0").alias("y")
    copies = own.alias("x").join(got, F.col(f"x.{row}") == F.col("y.r")).select(*[F.col(f"x.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("y.n"))).alias(free_name(docs, "copy")))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
