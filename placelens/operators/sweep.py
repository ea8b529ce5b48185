"""Evaluation of many configurations (a model and bands, or an ensemble of models) in one pass over the store."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation, nearest, search


def config_name(model: Column, bands: Column) -> Column:
    return F.concat(model, F.lit("__"), bands)


def ensemble_name(models: list[str], bands: str) -> str:
    return f"ensemble:{'+'.join(sorted(models))}__{bands}"


def ranked_lists(store: DataFrame, queries: DataFrame, top_k: int = 20) -> DataFrame:
    """config, concept, chip_location_id, rank, score: the best places of every query in its own model and bands.

    queries: model_id, bands, concept, q; a row for each configuration and concept. Every vector is read once and meets
    the queries of its configuration alone; see ``search.search_batch``.
    """
    asked = queries.withColumn("config", config_name(F.col("model_id"), F.col("bands")))
    named = asked.select("model_id", "bands", "config").distinct().orderBy("config").collect()  # configurations
    numbers = {r["config"]: i for i, r in enumerate(named)}
    spark = store.sparkSession
    cells = spark.createDataFrame([(r["model_id"], r["bands"], numbers[r["config"]]) for r in named], "model_id string, bands string, cell int")
    rows = store.join(F.broadcast(cells), ["model_id", "bands"])
    parts = []
    for keys, q in nearest.parts_of(asked.select(F.struct("config", "concept").alias("key"), "q"), "key"):
        looks: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            looks.setdefault(numbers[k["config"]], []).append(i)
        parts.append((keys, nearest.hits_of_tasks(rows, q, top_k, {c: np.array(v) for c, v in looks.items()})))
    hits = [nearest.named(spark, h, [tuple(k) for k in keys], "key", "struct<config: string, concept: string>") for keys, h in parts]
    if not hits:
        return spark.createDataFrame([], "config string, concept string, chip_location_id string, rank int, score double")
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    best = out.groupBy("key", "chip_location_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "chip_location_id")
    best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return best.select("key.config", "key.concept", "chip_location_id", "rank", "score")


def place_scores(store: DataFrame, queries: DataFrame) -> DataFrame:
    """model_id, concept, chip_location_id, score: the best score of every place for each query; queries: model_id, concept, q.

    A batch gives one row for each of its places and query, so what is shuffled is places times queries and no vector.
    """
    spark, found = store.sparkSession, []
    for keys, q in nearest.parts_of(queries.select(F.struct("model_id", "concept").alias("key"), "q"), "key"):
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        models = np.array([k["model_id"] for k in keys], object)
        shared = spark.sparkContext.broadcast((unit, models))

        def run(batches, shared=shared):
            unit, models = shared.value
            for b in batches:
                at, v = nearest.matrix_of(b.column("embedding"), unit.shape[1])
                owner, place = (np.array(b.column(c).to_pylist(), object)[at] for c in ("model_id", "chip_location_id"))
                for model in set(owner.tolist()) & set(models.tolist()):
                    own, asked = owner == model, np.flatnonzero(models == model)
                    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                        s = v[own] @ unit[asked].T / np.linalg.norm(v[own], axis=1)[:, None]
                    s[~np.isfinite(s)] = -np.inf
                    names, number = np.unique(place[own].astype(str), return_inverse=True)
                    best = np.full((len(names), len(asked)), -np.inf)
                    np.maximum.at(best, number, s)
                    i, j = np.nonzero(best > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[j].astype(np.int32)), pa.array(names[i].tolist(), pa.string()), pa.array(best[i, j])], names=["query", "chip_location_id", "score"])

        rows = store.filter("chip_location_id IS NOT NULL").select("model_id", "chip_location_id", "embedding").mapInArrow(run, "query int, chip_location_id string, score double")
        best = rows.groupBy("query", "chip_location_id").agg(F.max("score").alias("score"))
        found.append(nearest.named(spark, best, [tuple(k) for k in keys], "key", "struct<model_id: string, concept: string>"))
    out = spark.createDataFrame([], "chip_location_id string, score double, key struct<model_id: string, concept: string>")
    for f in found:
        out = out.unionByName(f)
    return out.select("key.model_id", "key.concept", "chip_location_id", "score")


def ensemble_lists(store: DataFrame, queries: DataFrame, models: list[str], bands: str, primary: str, top_k: int = 20) -> DataFrame:
    """``ranked_lists`` of an ensemble: places by the mean over its models of their best score; a place may lack a model.

    The store must have vectors of exactly these models in the bands, the primary among them, else ValueError.
    """
    rows, asked = store.filter(F.col("bands") == bands), queries.filter((F.col("bands") == bands) & F.col("model_id").isin(*models))
    present = {r["model_id"] for r in rows.select("model_id").distinct().collect()}  # models
    search.check_ensemble(set(models), present, primary)
    mean = place_scores(rows, asked).groupBy("concept", "chip_location_id").agg(F.avg("score").alias("score"))
    w = Window.partitionBy("concept").orderBy(F.desc("score"), "chip_location_id")
    best = mean.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return best.select(F.lit(ensemble_name(models, bands)).alias("config"), "concept", "chip_location_id", "rank", "score")


def evaluate(store: DataFrame, queries: DataFrame, truth: DataFrame, top_k: int = 20, ensembles: list[tuple[list[str], str, str]] = (), ks: tuple[int, ...] = evaluation.KS) -> DataFrame:
    """The metric table (config, concept, n_gt, k, hit, recall, mrr) of all configurations of ``queries`` and of ensembles (models, bands, primary)."""
    lists = ranked_lists(store, queries, top_k)
    for models, bands, primary in ensembles:
        lists = lists.unionByName(ensemble_lists(store, queries, models, bands, primary, top_k))
    return evaluation.metrics(lists.select("config", "concept", "chip_location_id", "rank"), truth, ks)
