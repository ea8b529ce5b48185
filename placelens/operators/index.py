"""An inverted-file index of vectors: a coarse quantiser whose lists are partitions of a Parquet table.

Centroids are fitted by spherical k-means on a bounded sample; every row is written under the cell of its nearest centroid. A
query looks only at the cells of its nearest centroids, which prune partitions, and scores their rows exactly. All cells give the
exact result. Rows without a direction (null, zero or NaN vectors) are kept under cell -1; they are never hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from . import nearest, search

#: Rows that centroids are fitted on, about: a bound that does not grow with the table.
SAMPLE_ROWS = 100_000
#: Centroids travel to all tasks: at most so many bytes of doubles.
CENTROID_BYTES = 64 << 20
ROWS_A_FILE = 250_000


@dataclass(frozen=True)
class Index:
    """``rows``: the table with its column ``cell``; ``centroids``: one unit vector a cell."""

    rows: DataFrame
    centroids: np.ndarray

    def cells_of(self, query, probes: int) -> list[int]:
        """The ``probes`` cells nearest to a query, ties to the smaller cell."""
        return [int(c) for c in np.argsort(-(self.centroids @ np.asarray(query, np.float64)), kind="stable")[:probes]]


def has_direction(v) -> F.Column:
    length = vectors.norm(v)
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce((length > 0) & (length < float("inf")), F.lit(False))


def fit(rows: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """At most ``cells`` unit centroids of the vectors of one length, from about ``sample_rows`` rows that a hash picks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = rows.select("chip_id", "embedding").filter(has_direction(F.col("embedding")))
    facts = some.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if not facts["n"]:
        raise ValueError("no vector with a direction: nothing to index")
    if facts["least"] != facts["most"]:
        raise ValueError("an index holds vectors of one length")
    if cells * facts["most"] * 8 > CENTROID_BYTES:
        raise ValueError(f"at most {CENTROID_BYTES // (facts['most'] * 8)} cells of {facts['most']} components")
    share = min(1.0, sample_rows / facts["n"])
    picked = some.filter(F.pmod(F.xxhash64("chip_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    model = KMeans(featuresCol="u", k=cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(picked.select(array_to_vector(vectors.normalise(F.col("embedding"))).alias("u")))
    centres = np.array(model.clusterCenters(), np.float64)
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def with_cell(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with ``cell``, the number of the nearest centroid by cosine (ties: the smaller), -1 without direction."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for b in batches:
            at, v = nearest.matrix_of(b.column("embedding"), c.shape[1])
            cell = np.full(b.num_rows, -1, np.int32)
            good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            cell[at[good]] = (v[good] @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, cell int")


def build(spark: SparkSession, rows: DataFrame, folder: str, cells: int = 256, sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Index:
    """Write the index of ``rows`` (the columns of the store, one model and bands) to ``folder``; every row is indexed.

    A cell is dealt to as many files as its rows need, so a cell with a third of all rows is no single task.
    """
    centroids = fit(rows, cells, sample_rows, seed)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    placed = with_cell(rows, centroids)
    placed.write.parquet(f"{folder}/placed")  # assigned once, as the counts and the rows are both read from it
    placed = spark.read.schema(placed.schema).parquet(f"{folder}/placed")
    files = placed.groupBy("cell").agg(F.ceil(F.count("*") / ROWS_A_FILE).cast("int").alias("files"))  # a row a cell
    dealt = placed.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("chip_id"), F.col("files")))
    dealt.repartition("cell", "file").drop("file", "files").write.partitionBy("cell").parquet(f"{folder}/rows")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/placed")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return read(spark, folder)


def read(spark: SparkSession, folder: str) -> Index:
    centroids = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()  # at most CENTROID_BYTES
    return Index(spark.read.parquet(f"{folder}/rows"), np.array([r["centroid"] for r in centroids]))


def search_index(index: Index, query, request: search.Request | None = None, probes: int | None = None) -> DataFrame:
    """``search`` over the rows of the ``probes`` nearest cells; None: all cells, the exact result."""
    query = vectors.check_query(query)
    rows = index.rows if probes is None else index.rows.filter(F.col("cell").isin(*index.cells_of(query, probes)))
    return search.search(rows.drop("cell"), query, request)


def search_index_batch(index: Index, queries: DataFrame, request: search.Request | None = None, probes: int | None = None, key: str = "concept") -> DataFrame:
    """``search_batch`` where each query looks at its ``probes`` nearest cells only; cells that no query looks at are not read."""
    if probes is None:
        return search.search_batch(index.rows.drop("cell"), queries, request, key)
    request = (request or search.Request()).checked()
    rows, parts = search.filtered(index.rows, request), []
    for keys, q in nearest.parts_of(queries, key):
        looks: dict[int, list[int]] = {}
        for i, v in enumerate(q):
            for c in index.cells_of(v, probes) if np.isfinite(v).all() else []:
                looks.setdefault(c, []).append(i)
        near = rows.filter(F.col("cell").isin(*looks))
        parts.append((keys, nearest.hits_of_tasks(near, q, request.top_k, {c: np.array(w) for c, w in looks.items()})))
    return search.ranked_places(rows, parts, key, dict(queries.dtypes)[key], request.top_k)


def probes_for(index: Index, target: float = 0.95, request: search.Request | None = None, asked: int = 64, seed: int = 1) -> int:
    """The fewest probes that find a share of ``target`` of the exact hits of about ``asked`` indexed vectors.

    One exact search of those vectors tells in which cells their hits lie, and how many cells of each query come before.
    """
    request = (request or search.Request()).checked()
    rows = search.filtered(index.rows, request).filter("cell >= 0")
    n = rows.count()
    order = F.pmod(F.xxhash64("chip_id", F.lit(seed)), F.lit(1 << 30))
    some = rows.filter(order < int(min(1.0, 2 * asked / max(n, 1)) * (1 << 30))).orderBy(order, "chip_id").limit(asked).select(F.col("chip_id").alias("concept"), F.col("embedding").alias("q")).dropDuplicates(["concept"])
    queries = some.collect()  # at most ``asked``
    if not queries:
        return 1
    asked_again = index.rows.sparkSession.createDataFrame(queries, some.schema)
    hits = search.search_batch(rows.drop("cell"), asked_again, request)
    at = hits.select("concept", "chip_location_id", F.col("winning_cycle").alias("source_cycle")).join(rows.select("chip_location_id", "source_cycle", "cell"), ["chip_location_id", "source_cycle"])
    places = {r["concept"]: {c: i for i, c in enumerate(index.cells_of(r["q"], len(index.centroids)))} for r in queries}
    needed = sorted(places[r["concept"]][r["cell"]] + 1 for r in at.select("concept", "chip_location_id", "cell").distinct().collect())
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]


def recall(found: DataFrame, exact: DataFrame, key: str = "concept") -> DataFrame:
    """key, n, recall: how many of the exact places of each query were found."""
    met = exact.select(key, "chip_location_id").join(found.select(key, "chip_location_id", F.lit(1).alias("hit")), [key, "chip_location_id"], "left")
    return met.groupBy(key).agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))
