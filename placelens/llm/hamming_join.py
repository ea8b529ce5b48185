"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A document is the set of its ``width``-word shingles; documents of one set are one unit. A unit's signature has ``symbols`` minima of
``bits`` bits. The signatures of two sets of similarity J differ in a symbol with probability (1 - J)(1 - 2^-bits), so a pair at the
threshold differs in more than ``distance`` symbols with probability 1 - ``recall`` at most (``allowed``).

Signatures are split into ``distance // 2 + 1`` chunks. By pigeonhole a pair within the distance has a chunk with one wrong symbol at
most. Each chunk gives one key for each of its symbols, the chunk without that symbol, so the pair has a key in common:
``symbols`` keys a unit, and no pair within the distance is missed. What shares a key is a bucket.

Every unit goes home to the least unit of its buckets it shares most keys with; units of one home are verified against each other on
their full sets (parts of at most ``block`` units or ``weight`` shingles), which joins most families of copies. Then signatures are
compared within buckets that still hold several components over several parts; only the units of pairs within the distance
travel, with the numbers of the two parts, and are verified there. Pairs are never rows; links form a forest, and components
follow by star steps. A bucket of over ``bucket`` units is dealt over tasks by pairs of its parts.

Defined results: A-Z are lower-cased; null texts and texts without a word have no shingle and are linked with nothing; a
text of fewer than ``width`` words is one shingle; repeated rows and equal sets are linked; the component's id is its least
doc_id (null if it has none), and a row is kept if it has that id, so rows repeated under that id are all kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, sent_if_small
from .graph import components
from .ngram_join import PRIME, mix, verify


def allowed(threshold: float, recall: float, symbols: int, bits: int) -> int:
    """The least distance that signatures of sets at the threshold keep with probability ``recall``."""
    p, total = (1 - threshold) * (1 - 2.0**-bits), 0.0
    for d in range(symbols + 1):
        total += math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if total >= recall:
            return d
    return symbols


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the text in lower case; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], np.uint64)
    n = max(len(w) - width + 1, 1)
    h = np.full(n, min(width, len(w)), np.uint64)
    for i in range(min(width, len(w))):
        h = mix(h * PRIME + w[i : i + n])
    return np.unique(h)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    minima = np.full(len(a), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        minima = np.minimum(minima, (s[at : at + 4096, None] * a + b).min(axis=0))
    return (mix(minima) >> np.uint64(64 - bits)).astype(np.uint16)


def sketches(docs: DataFrame, width: int, symbols: int, bits: int, seed: int) -> DataFrame:
    """row, doc_id, set_key, n_shingles, signature (null without shingles) of each document."""

    def run(batches):
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**64, symbols, np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**64, symbols, np.uint64)
        for batch in batches:
            keys, sizes, out = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py() or "", width)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out.append(signature(s, a, b, bits).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["row", "doc_id", "set_key", "n_shingles", "signature"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, set_key binary, n_shingles long, signature binary")


def chunk_keys(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """The keys of each row of symbols: for each chunk and each of its symbols, a hash of the chunk's others and their places."""
    out = []
    for chunk in np.array_split(np.arange(signatures.shape[1]), chunks):
        for left_out in chunk:
            h = np.full(len(signatures), left_out + 1, np.uint64)
            for c in chunk:
                if c != left_out:
                    h = mix(h * PRIME + signatures[:, c].astype(np.uint64))
            out.append(h.view(np.int64))
    return np.stack(out, axis=1)


def symbols_of(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, symbols)


def bucket_keys(units: DataFrame, symbols: int, chunks: int) -> DataFrame:
    """key, unit: all keys of each unit."""

    def run(batches):
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            keys = chunk_keys(symbols_of(b.column("signature"), symbols), chunks)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("unit").to_numpy(), keys.shape[1]))], names=["key", "unit"])

    return units.select("unit", "signature").mapInArrow(run, "key long, unit long")


def close(part: np.ndarray, label: np.ndarray, sig: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket of different parts and components within the distance."""
    found = []
    for at in range(0, len(sig), 128):
        apart = np.zeros((len(sig[at : at + 128]), len(sig)), np.uint16)
        for s in range(sig.shape[1]):
            apart += sig[at : at + 128, s, None] != sig[None, :, s]
        near = (apart <= distance) & (part[at : at + 128, None] < part[None, :]) & (label[at : at + 128, None] != label[None, :])
        x, y = np.nonzero(near)
        found.append((x + at, y))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def meetings(rows: DataFrame, symbols: int, distance: int, tasks: int) -> DataFrame:
    """i, j, part, unit: units of pairs within the distance, with the two parts of the pair; rows: key, p, q, part, label, unit, signature.

    Buckets give lists of units, which are united before they become rows: a part has few units, each in ``symbols`` buckets at most.
    """

    def met(group: pa.Table):
        part, label, unit = (group.column(c).to_numpy() for c in ("part", "label", "unit"))
        x, y = close(part, label, symbols_of(group.column("signature"), symbols), distance)
        return np.unique(np.concatenate([np.stack([part[x], part[y], part[z], unit[z]], axis=1) for z in (x, y)]), axis=0)

    def run(batches):
        held = None
        for b in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks() if held is not None else pa.Table.from_batches([b])
            names = np.stack([held.column(c).to_numpy() for c in ("key", "p", "q")], axis=1)
            ends = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            if len(ends):
                yield from several([met(held.slice(s, e - s)) for s, e in zip([0, *ends[:-1]], ends, strict=True)])
                held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield from several([met(held)])

    def several(found):
        rows = np.unique(np.concatenate(found), axis=0)
        if len(rows):
            first = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1])
            units = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), pa.array(rows[:, 3]))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[first, c]) for c in range(3)), units], names=["i", "j", "part", "units"])

    found = rows.repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "i long, j long, part long, units array<long>")
    united = found.groupBy("i", "j", "part").agg(F.array_distinct(F.flatten(F.collect_list("units"))).alias("units"))
    return united.select("i", "j", "part", F.explode("units").alias("unit"))


def groups(docs: DataFrame, threshold: float, width: int, recall: float, symbols: int, bits: int, block: int, weight: int, bucket: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, set_key, n_shingles of each document; unit, set_key, label, least id of each unit); docs: row, doc_id, text, written."""
    distance = allowed(threshold, recall, symbols, bits)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    seen = materialise(sketches(docs, width, symbols, bits, seed), "hamming-sketches")
    # The size and signature follow from the set; as parts of the key they are grouped without a sort.
    units = seen.filter("n_shingles > 0").groupBy("set_key", "n_shingles", "signature").agg(F.min("row").alias("unit"), F.min("doc_id").alias("least"))
    units = materialise(units, "hamming-units")

    keys = bucket_keys(units, symbols, distance // 2 + 1)
    heads = materialise(keys.groupBy("key").agg(F.min("unit").alias("head"), F.count("*").alias("n")).filter("n > 1"), "hamming-heads")
    members = materialise(keys.join(sent_if_small(heads), "key"), "hamming-members")
    home = members.groupBy("unit", "head").agg(F.count("*").alias("c")).groupBy("unit").agg(F.max_by("head", F.struct("c", -F.col("head"))).alias("home"))
    home = materialise(home.join(units.select("unit", "n_shingles"), "unit"), "hamming-homes")
    parts = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / weight)).cast("long").alias("parts"), F.count("*").alias("n"))
    placed = home.join(parts, "home").select("unit", "n", F.xxhash64("home", F.pmod(F.xxhash64("unit"), "parts")).alias("part"))
    placed = materialise(placed, "hamming-parts")

    def verified(dealt: DataFrame, name: str) -> DataFrame:
        """u, v of a forest of links among the units dealt to each pair of parts; dealt: i, j, part, unit."""

        def encode(batches):
            for b in batches:
                sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sets, pa.binary())], names=["unit", "set"])

        wanted = sent_if_small(materialise(dealt.select(F.col("unit").alias("row")).distinct(), f"{name}-wanted"))
        sets = docs.select("row", "text").join(wanted, "row").mapInArrow(encode, "unit long, set binary")
        rows = sets.join(sent_if_small(dealt), "unit").select("i", "j", F.col("part").alias("chunk"), "unit", F.lit(1).cast("long").alias("copies"), "set")
        return materialise(verify(rows, threshold, tasks).filter("v IS NOT NULL").select("u", "v"), name)

    near = verified(placed.filter("n > 1").select(F.col("part").alias("i"), F.col("part").alias("j"), "part", "unit"), "hamming-near")
    label = components(near, "hamming-first").withColumnRenamed("node", "unit")
    at = materialise(placed.select("unit", "part").join(label, "unit", "left").select("unit", "part", F.coalesce("label", "unit").alias("label")), "hamming-labels")
    here = members.select("key", "unit", "n").join(sent_if_small(at), "unit")
    mixed = here.groupBy("key").agg(F.min("part").alias("i"), F.max("part").alias("j"), F.min("label").alias("u"), F.max("label").alias("v")).filter("i < j AND u < v").select("key")
    mixed = materialise(mixed, "hamming-mixed")
    dealt = F.greatest(F.ceil(F.col("n") / bucket), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("unit", F.lit(1)), dealt)
    rows = here.join(sent_if_small(mixed), "key").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), dealt - 1))})
    rows = rows.join(units.select("unit", "signature"), "unit").select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "part", "label", "unit", "signature")
    met = materialise(meetings(rows, symbols, distance, tasks), "hamming-met")
    links = materialise(near.union(verified(met, "hamming-far")), "hamming-links")
    label = components(links, "hamming-last").withColumnRenamed("node", "unit")
    return seen, units.join(label, "unit", "left").select("unit", "set_key", "least", F.coalesce("label", "unit").alias("label"))


def near_duplicate_groups(docs: DataFrame, threshold: float = 0.85, width: int = 3, recall: float = 0.9999, symbols: int = 64, bits: int = 16, block: int = 512, weight: int = 1 << 20, bucket: int = 2048, seed: int = 29) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text)."""
    if not 1 <= bits <= 16:
        raise ValueError("bits must be from 1 to 16")
    docs, _ = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    seen, units = groups(docs, threshold, width, recall, symbols, bits, block, weight, bucket, seed)
    names = units.groupBy("label").agg(F.min("least").alias("component_id"))
    named = units.select("set_key", "label").join(names, "label").select("set_key", "component_id")
    out = seen.filter("n_shingles > 0").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = seen.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
