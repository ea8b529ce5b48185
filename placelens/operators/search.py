"""Cosine top-K over chips, max-pooled over cycles, with spatial filters; batches of queries and ensembles of models.

``store`` has the columns of ``schemas.CHIP_EMBEDDINGS``. Filters stand below scoring and use plain columns, so that they
reach the Parquet scan; the embedding is dropped as soon as the score is known.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, vectors
from . import nearest
from .nearest import ATTRIBUTES


@dataclass(frozen=True)
class Request:
    """Filters of a search; None means no filter. ``overfetch`` keeps only so many rows before grouping (None: all, exact)."""

    top_k: int = 10
    model_id: str | None = None
    bands: str | None = None
    experiment_id: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    near: tuple[float, float, float] | None = None
    inside_aoi_only: bool = False
    overfetch: int | None = None

    def checked(self) -> Request:
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if self.overfetch is not None and self.overfetch < self.top_k:
            raise ValueError("overfetch must not be less than top_k")
        return self


def default_overfetch(top_k: int) -> int:
    return max(12 * top_k, 60)


def predicates(request: Request) -> list[Column]:
    tests = [F.col(c) == F.lit(v) for c in ("experiment_id", "model_id", "bands") if (v := getattr(request, c)) is not None]
    if request.bbox:
        tests.append(geo.boxes_meet(*map(float, request.bbox)))
    if request.near:
        tests.append(geo.within(F.col("cx"), F.col("cy"), *map(float, request.near)))
    if request.inside_aoi_only:
        tests.append(F.col("inside_aoi"))
    return tests


def filtered(store: DataFrame, request: Request) -> DataFrame:
    tests = predicates(request)
    return store.filter(reduce(lambda a, b: a & b, tests)) if tests else store


def score_arrow(rows: DataFrame, query: list[float]) -> DataFrame:
    """The score of each row by NumPy over Arrow batches; other columns pass through."""
    keep = [f for f in rows.schema.fields if f.name != "embedding"]
    q = np.asarray(query)
    q = q / np.linalg.norm(q)

    def run(batches):
        for b in batches:
            flat = b.column("embedding")
            m = np.asarray(flat.values.to_numpy(zero_copy_only=False), np.float64)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()].reshape(-1, len(q))
            length = np.linalg.norm(m, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = m @ q / length
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(s, mask=~np.isfinite(s))], names=[*(f.name for f in keep), "score"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "score double"]))


def scored(store: DataFrame, query, engine: str = "jvm") -> DataFrame:
    """Rows with a score; rows without a direction (null, zero or NaN vectors) are left out, as they have no cosine."""
    query = vectors.check_query(query)
    if engine == "arrow":
        out = score_arrow(store.filter(F.size("embedding") == len(query)), query)
    else:
        out = store.withColumn("score", F.expr(vectors.cosine_sql("embedding", query))).drop("embedding")
    return out.filter("score IS NOT NULL AND NOT isnan(score)")


def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best cycle of each place: max score, the attributes of that row (ties: smallest cycle), any inside_aoi."""
    first = f"min_by(struct(source_cycle, {', '.join(ATTRIBUTES)}), struct(-score AS s, source_cycle AS c)) AS w"
    out = rows.groupBy(*keys).agg(F.expr("max(score) AS score"), F.expr(first), F.expr("bool_or(inside_aoi) AS inside_aoi"))
    return out.selectExpr(*keys, "score", "w.source_cycle AS winning_cycle", *[f"w.{a}" for a in ATTRIBUTES], "inside_aoi")


def search(store: DataFrame, query, request: Request | None = None, engine: str = "jvm") -> DataFrame:
    """The ``top_k`` places by their best cycle, with their rank.

    With ``overfetch`` only the best so many rows are grouped, which may leave fewer than ``top_k`` places. Null, zero and
    NaN vectors take no part; ties go to the smaller place; a store without matching rows gives an empty result.
    """
    request = (request or Request()).checked()
    columns = ["chip_location_id", "source_cycle", "inside_aoi", *ATTRIBUTES]
    rows = scored(filtered(store, request).select(*columns, "embedding"), query, engine)
    if request.overfetch:
        rows = rows.orderBy(F.desc("score"), "chip_location_id", "source_cycle").limit(request.overfetch)
    hits = pooled(rows, ["chip_location_id"]).orderBy(F.desc("score"), "chip_location_id").limit(request.top_k)
    return hits.withColumn("rank", F.expr("row_number() OVER (ORDER BY score DESC, chip_location_id)"))  # over top_k rows


def search_batch(store: DataFrame, queries: DataFrame, request: Request | None = None, key: str = "concept") -> DataFrame:
    """``search`` for each row of ``queries`` (key, q); keys are distinct.

    Vectors stay where they are: each batch of rows meets all queries of a part (at most ``nearest.BATCH_BYTES``) in one
    matrix product, and a task keeps the best ``top_k`` places of each query, so only those are shuffled. Whether a place is inside
    the area in any cycle is looked up for hits alone, in a scan without vectors.
    """
    request = (request or Request()).checked()
    rows = filtered(store, request)
    return ranked_places(rows, [(keys, nearest.hits_of_tasks(rows, q, request.top_k)) for keys, q in nearest.parts_of(queries, key)], key, dict(queries.dtypes)[key], request.top_k)


def ranked_places(rows: DataFrame, parts: list[tuple[list, DataFrame]], key: str, kind: str, k: int) -> DataFrame:
    """The best ``k`` places of each query, from what tasks kept of each part of the queries; ``rows`` tell which are inside."""
    spark = rows.sparkSession
    hits = reduce(DataFrame.unionByName, [nearest.named(spark, h, keys, key, kind) for keys, h in parts], nearest.named(spark, spark.createDataFrame([], nearest.HITS), [], key, kind))
    first = F.min_by(F.struct("source_cycle", *ATTRIBUTES), F.struct((-F.col("score")).alias("s"), F.col("source_cycle").alias("c")))
    best = hits.groupBy(key, "chip_location_id").agg(F.max("score").alias("score"), first.alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "chip_location_id")
    best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    inside = rows.select("chip_location_id", "inside_aoi").join(best.select("chip_location_id").distinct(), "chip_location_id", "left_semi").groupBy("chip_location_id").agg(F.bool_or("inside_aoi").alias("inside_aoi"))
    out = best.join(inside, "chip_location_id", "left")
    return out.select(key, "chip_location_id", "score", F.col("w.source_cycle").alias("winning_cycle"), *[F.col(f"w.{a}").alias(a) for a in ATTRIBUTES], "inside_aoi", "rank")


def check_ensemble(query_models: set[str], store_models: set[str], primary: str) -> None:
    """The same models on both sides, at least one, the primary among them; else ValueError."""
    if not query_models or query_models != store_models:
        raise ValueError(f"models differ: {sorted(query_models)} and {sorted(store_models)}")
    if primary not in query_models:
        raise ValueError(f"{primary} is not among the models")


def search_ensemble(store: DataFrame, queries: dict[str, list[float]], primary: str, request: Request | None = None) -> DataFrame:
    """Places by the mean over models of their best score in each; the winning cycle is that of the primary model."""
    request = (request or Request()).checked()
    present = {r["model_id"] for r in filtered(store, replace(request, model_id=None)).select("model_id").distinct().collect()}
    check_ensemble(set(queries), present, primary)
    parts = [scored(filtered(store, replace(request, model_id=m)).select("model_id", "chip_location_id", "source_cycle", "embedding"), q) for m, q in sorted(queries.items())]
    per_model = reduce(DataFrame.unionByName, parts).groupBy("model_id", "chip_location_id").agg(
        F.max("score").alias("best"), F.min_by("source_cycle", F.struct((-F.col("score")).alias("s"), F.col("source_cycle").alias("c"))).alias("cycle")
    )
    mean = per_model.groupBy("chip_location_id").agg(F.avg("best").alias("score"), F.max(F.when(F.col("model_id") == primary, F.col("cycle"))).alias("winning_cycle"))
    return mean.orderBy(F.desc("score"), "chip_location_id").limit(request.top_k)


def search_lsh(store: DataFrame, query, request: Request | None = None, tables: int = 4, bucket: float = 0.5, candidates: int = 200) -> DataFrame:
    """Approximate search: random projections pick candidates on unit vectors, which are then scored exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    request = (request or Request()).checked()
    q = np.asarray(vectors.check_query(query))
    rows = filtered(store, request).filter(vectors.norm(F.col("embedding")) > 0)
    rows = rows.withColumn("unit", array_to_vector(vectors.normalise(F.col("embedding"))))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=bucket, seed=1).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(q / np.linalg.norm(q)), candidates)
    return search(near.select(*store.columns), query, request)


def preflight(store: DataFrame, model_id: str, bands: str) -> int:
    """Rows of a model and bands; none is an error."""
    n = store.filter((F.col("model_id") == model_id) & (F.col("bands") == bands)).count()
    if not n:
        raise ValueError(f"no rows for {model_id} / {bands}: load embeddings first")
    return n


def same_shape(store: DataFrame, counts: bool = True) -> DataFrame:
    """source_cycle, n, dim, ok: whether every cycle has as many chips of one dimension as the largest.

    Without ``counts`` only the dimension is compared: cycles need not show the same places.
    """
    per = store.groupBy("source_cycle").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"), F.max(F.size("embedding")).alias("top"))
    most = per.agg(F.max("n").alias("most_n"), F.max("top").alias("most_d"))  # one row
    ok = F.col("dim") == F.col("most_d")
    if counts:
        ok = (F.col("n") == F.col("most_n")) & ok
    return per.crossJoin(F.broadcast(most)).select("source_cycle", "n", "dim", ok.alias("ok"))
