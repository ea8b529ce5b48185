"""The best places of many queries: one matrix product a batch of rows, the best ``k`` places of each query kept in each task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTES = ["cx", "cy", "xmin", "ymin", "xmax", "ymax"]
#: Query vectors of a part are sent to all tasks: at most so many bytes, more queries make more parts.
BATCH_BYTES = 8 << 20
HITS = "query int, chip_location_id string, source_cycle string, score double, " + ", ".join(f"{a} double" for a in ATTRIBUTES)


class Best:
    """The ``k`` best places so far of each query, each by its best row: score, then place; within a place score, then cycle."""

    def __init__(self, queries: np.ndarray, k: int):
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in queries]
        self.least = np.full(len(queries), -np.inf)

    def see(self, vectors: np.ndarray, places: np.ndarray, cycles: np.ndarray, attributes: list[np.ndarray], asked: np.ndarray | None = None) -> None:
        """Rows, and the numbers of the queries that they are held against (None: all)."""
        asked = np.arange(len(self.unit)) if asked is None else asked
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            scores = vectors @ self.unit[asked].T / np.linalg.norm(vectors, axis=1)[:, None]
        scores[~np.isfinite(scores)] = -np.inf
        near = (scores >= self.least[asked]) & (scores > -np.inf)
        place, cycle = (np.unique(x, return_inverse=True)[1] for x in (places, cycles))
        for j in np.flatnonzero(near.any(axis=0)):
            at, q = np.flatnonzero(near[:, j]), int(asked[j])
            at = at[np.lexsort((cycle[at], place[at], -scores[at, j]))]
            at = at[np.sort(np.unique(place[at], return_index=True)[1])[: self.k]]
            rows = self.held[q] + [(-scores[i, j], places[i], cycles[i], *(a[i] for a in attributes)) for i in at]
            best: dict[str, tuple] = {}
            for r in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
                best.setdefault(r[1], r)
            self.held[q] = sorted(best.values(), key=lambda r: r[:2])[: self.k]
            if len(self.held[q]) == self.k:
                self.least[q] = -self.held[q][-1][0]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, r[1], r[2], -r[0], *r[3:]) for q, held in enumerate(self.held) for r in held]
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.float64()] * (1 + len(ATTRIBUTES))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t, from_pandas=True) for i, t in enumerate(kinds)], names=[f.split()[0] for f in HITS.split(", ")])


def matrix_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows with ``dim`` components, their vectors in doubles; null components are NaN)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    rows = np.flatnonzero(sizes == dim)
    starts = (np.cumsum(sizes) - sizes)[rows]
    return rows, flat[starts[:, None] + np.arange(dim)]


def hits_of_tasks(rows: DataFrame, queries: np.ndarray, k: int, cells: dict[int, np.ndarray] | None = None) -> DataFrame:
    """HITS: the best ``k`` places of each query among the rows of each task; no vector leaves its task.

    ``cells``: for each value of the rows' column ``cell``, the numbers of the queries that look there (None: all look everywhere).
    """
    shared = rows.sparkSession.sparkContext.broadcast((queries, cells))
    keep = ["embedding", "chip_location_id", "source_cycle", *ATTRIBUTES, *(["cell"] if cells is not None else [])]

    def run(batches):
        q, looks = shared.value
        best = Best(q, k)
        for b in batches:
            at, vectors = matrix_of(b.column("embedding"), q.shape[1])
            if not len(at):
                continue
            names = [np.array(b.column(c).to_pylist(), object)[at] for c in ("chip_location_id", "source_cycle")]
            others = [b.column(c).to_numpy(zero_copy_only=False)[at] for c in ATTRIBUTES]
            if looks is None:
                best.see(vectors, *names, others)
                continue
            cell = b.column("cell").to_numpy(zero_copy_only=False)[at]
            for c in np.unique(cell):
                if len(asked := looks.get(int(c), ())):
                    own = cell == c
                    best.see(vectors[own], *(n[own] for n in names), [o[own] for o in others], asked)
        yield best.batch()

    return rows.filter("chip_location_id IS NOT NULL AND source_cycle IS NOT NULL").select(*keep).mapInArrow(run, HITS)


def parts_of(queries: DataFrame, key: str) -> list[tuple[list, np.ndarray]]:
    """(keys, matrix) of queries (key, q) of one length, at most ``BATCH_BYTES`` each."""
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    parts = max(1, -(-sizes["n"] * 8 * max(sizes["d"] or 1, 1) // BATCH_BYTES))
    out = []
    for p in range(parts):
        rows = (queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p) if parts > 1 else queries).select(key, "q").filter("q IS NOT NULL").collect()
        for d in sorted({len(r["q"]) for r in rows} - {0}):
            own = [r for r in rows if len(r["q"]) == d]
            out.append(([r[key] for r in own], np.array([[np.nan if x is None else x for x in r["q"]] for r in own], np.float64)))
    return out


def named(spark: SparkSession, hits: DataFrame, keys: list, key: str, kind: str) -> DataFrame:
    """``hits`` with the key of its query in place of its number."""
    names = spark.createDataFrame(list(enumerate(keys)), f"query int, `{key}` {kind}")  # the queries of a part
    return hits.join(F.broadcast(names), "query").drop("query")
