"""Jaccard self-join of documents on word n-grams by MinHash banding.

Documents with the same set of ``width``-word shingles are one unit with a number of copies. A unit has ``bands`` hashes
of ``rows`` minima each, chosen so that a pair at the threshold shares a band with probability ``recall`` at least. Units are
shuffled by band hash and tied to the smallest unit of their bucket; what hangs together that way is a candidate family.
All pairs of a family are verified on their full sets of 64-bit shingle hashes. A family of more than ``block`` units or
``weight`` shingles is cut into chunks of units with the same smallest bucket mate, and only chunks that share a band meet.
So a task sees at most two chunks at once; it returns the links of each unit and a spanning forest, never pairs.

Defined results: null text takes no part (a class of its own, no links); a text without words is similar only to equal
texts; a text of less than ``width`` words is one shingle; repeated rows are documents of their own and each other's
copies; null ids keep their rows, class ids fall on the smallest id of the class (null if it has none); an empty table gives
an empty result; other columns are not read, ``one_of_each`` passes them through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, sent_if_small
from .graph import components

PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` minima that a pair at the threshold shares with probability ``recall``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))), rows


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; none without words."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], np.uint64)
    n = max(len(w) - width + 1, 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        h = mix(h * PRIME + w[i : i + n])
    return np.unique(h)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """A hash of the minima of each band."""
    minima = np.full(len(a), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        minima = np.minimum(minima, (s[at : at + 4096, None] * a + b).min(axis=0))
    h = np.arange(bands, dtype=np.uint64)
    for row in minima.reshape(bands, -1).T:
        h = mix(h * PRIME + row)
    return h.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """row, doc_id, unit_key, weight (shingles), bands: one row for each document with a text."""

    def run(batches):
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**64, bands * rows, np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**64, bands * rows, np.uint64)
        for batch in batches:
            keys, sizes, out = [], [], []
            for t in batch.column("text"):
                t = t.as_py()
                s = shingles(t, width)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes() if len(s) else b"text" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                out.append(signature(s, a, b, bands).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["row", "doc_id", "unit_key", "weight", "bands"])

    return docs.filter("text is not null").select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, unit_key binary, weight long, bands array<long>")


def links_within(units: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked documents of each unit, and a spanning forest, over pairs of a ``left`` and a ``right`` unit.

    Shingles that many sets hold are counted by a matrix product, the others by their few pairs.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, token = np.unique(tokens, return_inverse=True)
    df = np.bincount(token)
    common = np.zeros((n, n), np.float32)
    wide = np.flatnonzero(df > 24)
    place = np.full(len(df), -1)
    for at in range(0, len(wide), 4096):
        place[:] = -1
        place[wide[at : at + 4096]] = np.arange(min(4096, len(wide) - at))
        on = place[token] >= 0
        x = np.zeros((n, min(4096, len(wide) - at)), np.float32)
        x[owner[on], place[token[on]]] = 1
        common += x @ x.T
    few = (df[token] > 1) & (df[token] <= 24)
    order = np.argsort(token[few], kind="stable")
    t, o = token[few][order], owner[few][order]
    for gap in range(1, 24):
        same = t[gap:] == t[:-gap]
        if not same.any():
            break
        np.add.at(common, (o[:-gap][same], o[gap:][same]), 1)
        np.add.at(common, (o[gap:][same], o[:-gap][same]), 1)
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    np.fill_diagonal(near, False)
    near &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    forest, root = [], np.arange(n)
    todo = set(np.flatnonzero(near.any(axis=1)).tolist())
    while todo:  # breadth first
        start = todo.pop()
        wave = [start]
        while wave:
            i = wave.pop()
            for j in [j for j in np.flatnonzero(near[i]).tolist() if j in todo]:
                todo.discard(j)
                forest.append((int(units[i]), int(units[j])))
                wave.append(j)
    return near @ copies, forest


def verify(members: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """u, v, n: a link of the forest if v is there, else n linked documents of unit u.

    members: i, j, chunk, unit, copies, set; units of chunks i and j meet, within i only if i = j.
    """

    def close(key, group):
        if not group or (key[0] != key[1] and len({g[0] for g in group}) < 2):
            return []
        chunk, units, copies = (np.array([g[k] for g in group], np.int64) for k in (0, 1, 2))
        left = chunk == key[0]
        right = left if key[0] == key[1] else ~left
        n, forest = links_within(units, copies.astype(np.float64), [np.frombuffer(g[3], np.uint64) for g in group], left, right, threshold)
        return [(int(units[i]), None, int(n[i])) for i in np.flatnonzero(n)] + [(u, v, 0) for u, v in forest]

    def run(batches):
        key, group, out = None, [], []
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            for i, j, *row in zip(*(b.column(c).to_pylist() for c in ("i", "j", "chunk", "unit", "copies", "set")), strict=True):
                if (i, j) != key:
                    out += close(key, group)
                    key, group = (i, j), []
                group.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        out += close(key, group)
        yield batch_of(out)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["u", "v", "n"])

    dealt = members.repartition(tasks, "i", "j").sortWithinPartitions("i", "j")
    return dealt.mapInArrow(run, "u long, v long, n long")


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, block: int = 512, weight: int = 1 << 20, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, unit of each document with a text; unit, label, links, copies, least id of each unit); docs: row, doc_id, text, written."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialise(sketches(docs, width, bands, rows, seed), "join-sketches")
    # Weight and bands follow from the key; as parts of it they are grouped without a sort.
    units = seen.groupBy("unit_key", "weight", "bands").agg(F.min("row").alias("unit"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    units = materialise(units, "join-units")

    buckets = units.select("unit", F.explode("bands").alias("hash"))  # a hash is of its band
    heads = buckets.groupBy("hash").agg(F.min("unit").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = materialise(buckets.join(heads, "hash").filter("unit != head").select(F.col("unit").alias("u"), F.col("head").alias("v")).distinct(), "join-stars")
    family = components(stars, "join-family").withColumnsRenamed({"node": "unit", "label": "family"})
    family = materialise(family.join(units.select("unit", "copies", "weight"), "unit"), "join-families")
    large = family.groupBy("family").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).filter((F.col("n") > block) | (F.col("w") > weight)).select("family")
    large = materialise(large, "join-large")

    # Chunks of large families: units with the same head, as many parts as it takes; a small family is a chunk of its own.
    cut = family.join(sent_if_small(large), "family").join(stars.groupBy("u").agg(F.min("v").alias("head")).withColumnRenamed("u", "unit"), "unit", "left")
    cut = materialise(cut.select("unit", "weight", F.coalesce("head", "unit").alias("head")), "join-cut")
    parts = cut.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("weight") / weight)).cast("long").alias("parts"))
    cut = materialise(cut.join(sent_if_small(parts), "head").select("unit", F.xxhash64("head", F.pmod(F.xxhash64("unit"), "parts")).alias("chunk")), "join-chunks")
    shared = buckets.join(sent_if_small(cut), "unit").select("hash", "chunk").distinct()
    x, y = shared.alias("x"), shared.alias("y")
    met = x.join(y, F.col("x.hash") == F.col("y.hash")).filter(F.col("x.chunk") < F.col("y.chunk")).select(F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j")).distinct()
    own = cut.select(F.col("chunk").alias("i"), F.col("chunk").alias("j")).distinct()
    met = met.select(F.col("i").alias("chunk"), "i", "j").union(met.select(F.col("j").alias("chunk"), "i", "j")).union(own.select(F.col("i").alias("chunk"), "i", "j"))
    met = materialise(met, "join-met")
    named = family.select("unit", "family", "copies").join(sent_if_small(cut), "unit", "left").select("unit", "copies", F.coalesce("chunk", "family").alias("chunk"))

    def encode(batches):
        for b in batches:
            sets = [shingles(t.as_py(), width).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("chunk", "unit", "copies")), pa.array(sets, pa.binary())], names=["chunk", "unit", "copies", "set"])

    named = materialise(named.withColumnRenamed("unit", "row"), "join-named")
    texts = docs.select("row", "text").join(sent_if_small(named), "row").select("chunk", F.col("row").alias("unit"), "copies", "text")
    sets = texts.mapInArrow(encode, "chunk long, unit long, copies long, set binary")
    members = sets.join(sent_if_small(met), "chunk", "left").select(F.coalesce("i", "chunk").alias("i"), F.coalesce("j", "chunk").alias("j"), "chunk", "unit", "copies", "set")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = materialise(verify(members, threshold, tasks), "join-links")

    links = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "unit")
    label = components(found.filter("v is not null").select("u", "v"), "join-class").withColumnRenamed("node", "unit")
    out = units.select("unit", "copies", "least").join(label, "unit", "left").join(links, "unit", "left")
    out = materialise(out.select("unit", "copies", "least", F.coalesce("label", "unit").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "join-classes")
    # Only texts that occur again need a look at their unit: others are their own.
    again = units.filter("copies > 1").select("unit_key", F.col("unit").alias("first"))
    return seen.select("row", "doc_id", "unit_key").join(sent_if_small(again), "unit_key", "left").select("row", "doc_id", F.coalesce("first", "row").alias("unit")), out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, block: int = 512) -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and links (documents at least as similar as ``threshold``) of every row."""
    docs, _ = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    rows, units = classes(docs, threshold, width, recall, block)
    # Classes of several units take their name from an aggregation; other units have it themselves.
    several = materialise(units.groupBy("label").agg(F.count("*").alias("n"), F.min("least").alias("class_id")).filter("n > 1").drop("n"), "join-names")
    named = units.join(sent_if_small(several), "label", "left").select("unit", F.coalesce("class_id", "least").alias("class_id"), "links")
    out = rows.join(named, "unit").select("doc_id", "class_id", "links")
    return out.unionByName(docs.filter("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def one_of_each(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, block: int = 512) -> DataFrame:
    """The rows of ``docs`` without those of a class but one, the one of smallest id; rows without text stay."""
    own, row = numbered(docs)
    rows, units = classes(own.select(F.col(row).alias("row"), "doc_id", "text"), threshold, width, recall, block)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    kept = rows.join(units.select("unit", "label"), "unit").groupBy("label").agg(F.min(place).alias("p")).select(F.col("p.row").alias(row))
    gone = materialise(rows.select(F.col("row").alias(row)).join(kept, row, "left_anti"), "join-gone")
    return own.join(sent_if_small(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
