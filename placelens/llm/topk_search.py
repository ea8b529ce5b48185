"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are scaled to integers, ``floor(scale * x)``. For a segment of L components with means m and deviations s, the inner
product of two segments is at most L * (m1 * m2 + s1 * s2) (Cauchy-Schwarz on the centred parts), so the squared distance is
at least |q|^2 + |v|^2 - 2 * sum of that. Bounds go from one segment over the whole vector to ever finer ones; a pair is
dropped once its bound is below the query's k-th best exact score so far, and only survivors are scored, in integers.

Vectors stay where they are: queries are sent to them in blocks of bounded size, ``blocks`` of them a pass over the table, each
query with a first threshold, its k-th best score among about ``seeds`` rows. A task keeps the k best of each query, the final
ranking sees k rows a task and query.

How much the bounds skip depends on the vectors. Where components are nearly independent, coarse levels skip a few per cent
and the finest two most pairs, at about the price of the products they save (see ``Search.scored`` and the README).

Defined results: vectors that are null, empty, or hold null, NaN or infinite components take no part, nor do rows without
id; a component that overflows a double when scaled counts as infinite; only vectors of the same dimension are compared; a row
never is a candidate of a query with its id; repeated rows are candidates each, a repeated query is asked once; ties go to the
smaller id; products are exact whatever the size of components, scores beyond 64 bits are cut to them; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FOUND = "query_id long, q_key long, vec_id long, score long"


def levels(dim: int) -> list[int]:
    """Segment counts, coarse to fine."""
    return sorted({s for s in (1, 4, 16, dim // 2, 3 * dim // 4) if 0 < s < dim})


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment, sqrt(L) times mean and deviation: the product of two rows bounds their inner product."""
    edges = np.array([len(p) for p in np.array_split(np.arange(x.shape[1]), segments)])
    starts, root = np.cumsum(edges) - edges, np.sqrt(edges)
    mean = np.add.reduceat(x, starts, axis=1) / edges
    square = np.add.reduceat((x - np.repeat(mean, edges, axis=1)) ** 2, starts, axis=1) / edges
    return np.concatenate([root * mean, root * np.sqrt(square)], axis=1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of arrays of whole numbers (doubles), pair by pair, exact and cut to 64 bits."""
    with np.errstate(over="ignore"):
        most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**53:  # every partial sum is a whole number that a double holds
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(v).max()) < 2.0**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), v.astype(np.int64))
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q.tolist(), v.tolist(), strict=True)], np.int64)


def vector_key(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63


class Search:
    """The k best rows so far for each query of a block, by score, then id; all vectors of one dimension, whole numbers."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.stats = [statistics(q, s) for s in levels(q.shape[1])]
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.who, self.names, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.pairs = self.scored = 0

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        alive = ids[None, :] != self.ids[:, None]
        self.pairs += int(alive.sum())
        rows = np.arange(len(v))
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * (float(np.abs(self.q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1] + 1)
            for s, q in zip(levels(v.shape[1]), self.stats, strict=True):
                bound = ~(q @ statistics(v[rows], s).T + slack < self.floor[:, None])  # a bound beyond doubles cuts nothing
                alive = alive[:, bound.any(axis=0)] & bound[:, bound.any(axis=0)]
                rows = rows[bound.any(axis=0)]
        a, b = np.nonzero(alive)
        b = rows[b]
        self.scored += len(a)
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            got = products(self.q[x], v[y])
            near = got >= self.floor[x]
            self.add(x[near], ids[y[near]], got[near])

    def add(self, who: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        who, names, scores = (np.concatenate(x) for x in ((self.who, who), (self.names, names), (self.scores, scores)))
        order = np.lexsort((names, np.bitwise_not(scores), who))
        who = who[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        self.who, self.names, self.scores = who[first], names[order][first], scores[order][first]
        full = np.flatnonzero(np.bincount(self.who, minlength=len(self.ids)) == self.k)
        last = np.searchsorted(self.who, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.scores[last].astype(np.float64) * (1 - 1e-15 * np.sign(self.scores[last])))


def nearest(rows: DataFrame, block: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, row_block: int) -> DataFrame:
    """FOUND: the k best rows of each task for each query; block: ids, vectors of one dimension and first thresholds, several times."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        searches = [Search(ids, q, k, floor.copy()) for ids, q, floor in shared.value]
        for whole in batches:
            for b in (whole.slice(i, row_block) for i in range(0, whole.num_rows, row_block)):
                ids, dims = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dim"))
                flat, ends = b.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    v = flat[(ends[at] - d)[:, None] + np.arange(d)]
                    for s in searches:
                        if s.q.shape[1] == d:
                            s.see(ids[at], v)
        for s in searches:
            # Different vectors under one id are queries of their own.
            key = np.array([vector_key(x) for x in s.q], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.ids[s.who], key[s.who], s.names, s.scores)], names=["query_id", "q_key", "vec_id", "score"])

    return rows.select("vec_id", "dim", "v").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def blocks_of(rows: list, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and empty thresholds of queries, in blocks of one dimension and at most ``size`` rows."""
    out = []
    for d in sorted({r["dim"] for r in rows}):
        own = [r for r in rows if r["dim"] == d]
        for x in (own[i : i + size] for i in range(0, len(own), size)):
            out.append((np.array([r["vec_id"] for r in x], np.int64), np.array([r["v"] for r in x]), np.full(len(x), -np.inf)))
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, query_block: int = 4096, blocks: int = 8, row_block: int = 1024, seeds: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    scaled = lambda x: x.cast("double") * scale
    # Doubles of 2^52 and more are whole numbers already.
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite & (F.size("embedding") > 0))
    rows = materialise(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), whole.alias("v")), "search-rows")
    queries = materialise(rows.filter(F.col("vec_id") % every == 0).distinct(), "search-queries")
    n_rows, n_queries = rows.count(), queries.count()
    passes, out = max(1, -(-n_queries // (query_block * blocks))), []
    some = materialise(rows.filter(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(max(1, n_rows // seeds))) == 0), "search-seeds")
    for p in range(passes):  # each meets the table once, with about query_block * blocks vectors
        asked = blocks_of(queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect(), query_block)
        best = ranked(nearest(some, asked, k, row_block), k).filter(F.col("rank") == k).collect()
        known = {(r["query_id"], r["q_key"]): float(r["score"]) for r in best}
        for ids, q, floor in asked:
            floor[:] = [known.get((int(i), vector_key(x)), -np.inf) for i, x in zip(ids, q, strict=True)]
            floor -= 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0))
        found = nearest(rows, asked, k, row_block)
        out.append(materialise(found, "search-found") if passes > 1 else found)  # a plan of one scan, and its vectors may go
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
