"""Nearest-centroid language identification.

A text is a bag of byte trigrams of its lower-cased letters (everything else a blank), hashed to ``DIM`` dimensions,
weighted by log counts and inverse document frequencies and normalised. Spherical k-means gives each language several
centroids; the language of the centroid with the largest cosine is predicted. A text is rejected if that cosine is below
``margin`` times the low quantile that texts of its length reach in training. Lengths with fewer than 30 sampled rows are
pooled with their neighbours, as widely as it takes, so every length has such a floor.

Document frequencies cover all training rows. Centroids are fitted on a bounded sample: ``per_language`` rows of each
language, ``sample`` in all but 20 of each language at least, taken in the order of a seeded hash of id and text. Every language
is learnt; the model has ``clusters`` centroids for each.

Defined results: null text and text without a letter give ``und``, score 0, rejected; a null id is neither learnt from nor
held out; repeated rows are rows of their own; without training rows every text is ``und``; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, sent_if_small

DIM_BITS = 13
DIM = 1 << DIM_BITS
_BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the text, blanks squeezed."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((a[:-2] | a[1:-1] << np.uint32(8) | a[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the number of trigrams, of texts that hold a letter."""
    out, size = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        g = trigrams(t)
        size[i] = len(g)
        out[i] = np.bincount(g, minlength=DIM)
    np.log1p(out, out=out)
    out *= idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, size


def length_bin(size: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 15)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def train(rows: DataFrame, per_language: int, sample: int, clusters: int, margin: float, quantile: float) -> dict:
    """rows: text and lang, neither null, and point: the order in which a language's rows are taken, copies of a row once. The model: languages, owner of each centroid, centroids, idf and floors."""
    langs = rows.select("lang").distinct().count()
    if not langs:
        return {"langs": []}

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column("text"):
                df[np.unique(trigrams(t.as_py()))] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.append(n, df))], names=["dim", "n"])

    df = {r["dim"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = df[-1]
    idf = np.array([np.log((1 + total) / (1 + df[d])) + 0.1 for d in range(DIM)], np.float32)

    each = max(20, min(per_language, sample // langs))
    cuts = rows.select("lang", "point").distinct().withColumn("p", F.row_number().over(Window.partitionBy("lang").orderBy("point"))).filter(F.col("p") <= each).groupBy("lang").agg(F.max("point").alias("last"))
    cuts = sent_if_small(rows.sparkSession.createDataFrame(cuts.collect(), "lang string, last long"))
    picked = rows.join(cuts, "lang").filter("point <= last").dropDuplicates(["lang", "point"]).select("lang", "text")

    def encode(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                v, size = vectors([text], idf)
                at = np.flatnonzero(v[0])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array(size), pa.array([at.astype("<u4").tobytes()]), pa.array([v[0][at].tobytes()])], names=["lang", "size", "at", "v"])

    got = sorted(picked.mapInArrow(encode, "lang string, size long, at binary, v binary").collect(), key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["v"])))
    names, groups, mine = [], [], []
    for lang, own in ((k, list(g)) for k, g in groupby(got, key=lambda r: r["lang"])):
        x = np.zeros((len(own), DIM), np.float32)
        for i, r in enumerate(own):
            x[i, np.frombuffer(r["at"], "<u4")] = np.frombuffer(r["v"], np.float32)
        names.append(lang)
        groups.append(cluster(x, clusters))
        mine.append((x @ groups[-1].T).max(axis=1))
    mine = np.concatenate(mine)
    centroids, of = np.concatenate(groups).astype(np.float32), np.repeat(np.arange(len(names)), [len(g) for g in groups])
    bins, floors = length_bin(np.array([r["size"] for r in got])), np.zeros(16)
    for b in range(16):  # longer texts come closer, so a shorter text's floor holds at least
        near = next(x for w in range(16) if len(x := mine[np.abs(bins - b) <= w]) >= 30 or w == 15)
        floors[b] = margin * float(np.quantile(near, quantile))
        if b and (bins < b).sum() >= 30:
            floors[b] = max(floors[b - 1], floors[b])
    return {"langs": names, "of": of, "centroids": centroids, "idf": idf, "floors": floors}


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, then language, score (cosine) and rejection of each row of ``docs``, under free names."""
    names = [free_name(docs, n) for n in ("__lang_pred", "__score", "__rejected")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x centroids, clusters of them a language

    def run(batches):
        m = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                texts = part.column("text").to_pylist()
                n = len(texts)
                lang, score, out = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
                at = [i for i, t in enumerate(texts) if m["langs"] and has_letter(t)]
                if at:
                    v, size = vectors([texts[i] for i in at], m["idf"])
                    cos = v @ m["centroids"].T
                    best = cos.argmax(axis=1)
                    lang[at] = np.array(m["langs"], object)[m["of"][best]]
                    score[at] = np.clip(cos[np.arange(len(at)), best], 0, 1)
                    out[at] = score[at] < m["floors"][length_bin(size)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*keep, *names])

    cols = list(dict.fromkeys([*keep, "text"]))
    kinds = [f"{n} {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True)]
    return docs.select(*[f"`{c}`" for c in cols]).mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in keep), *kinds]))


def fit(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = 600, sample: int = 4000, clusters: int = 4, margin: float = 0.6, quantile: float = 0.01, seed: int = 3) -> dict:
    """A model of the rows that are not held out."""
    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), fold_of(folds).alias("fold"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")).alias("point"))
    letters = F.col("text").rlike(r"\p{L}")
    rows = rows.filter((F.col("fold") != held) & F.col("lang").isNotNull() & F.col("text").isNotNull() & letters).select("text", "lang", "point")
    return train(rows, per_language, sample, clusters, margin, quantile)


def fold_of(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each row; learns from the rows that are not held out."""
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold_of(folds) == held, F.lit(False)).alias("held_out"))
    found = predict(marked, fit(docs, folds, held, **options), ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", *[F.col(n).alias(c) for n, c in zip(found.columns[-3:], ("lang_pred", "score", "rejected"), strict=True)])


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    found = predict(docs, fit(docs, **options), tuple(docs.columns))
    return found.filter(~F.col(found.columns[-1])).select(*[f"`{c}`" for c in docs.columns])
