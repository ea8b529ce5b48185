"""Pluggable text and chip encoders, run over Arrow batches. The default needs nothing but NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HashEncoder:
    """Character trigrams, hashed to signed buckets: a deterministic unit vector. Text without a trigram maps to the first axis."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def texts(self, values: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(values), self.dim), np.float32)
        for i, v in enumerate(values):
            padded = f"  {v.strip().lower()}  "
            for j in range(len(padded) - 2):
                h = zlib.crc32(padded[j : j + 3].encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        return self._unit(out)

    def images(self, arrays: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(arrays), self.dim), np.float32)
        for i, a in enumerate(map(check_image, arrays)):
            h = np.concatenate([np.histogram(band, bins=16, range=(0, 256))[0] for band in a]).astype(np.float32)
            out[i] = np.resize(h - h.mean(), self.dim)
        return self._unit(out)

    def _unit(self, m: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m[length[:, 0] == 0, 0] = 1
        return m / np.where(length == 0, 1, length)


def check_image(a: np.ndarray) -> np.ndarray:
    """(bands, h, w) uint8 with at least 3 bands; the first three are used."""
    if a.ndim != 3 or a.dtype != np.uint8 or a.shape[0] < 3:
        raise ValueError(f"expected (bands >= 3, h, w) uint8, got {a.shape} {a.dtype}")
    return a[:3]


#: Model id to (loader of an encoder, dimension). Register models with weights here; loaders run on the workers, once a task.
REGISTRY: dict[str, tuple[Callable[[], HashEncoder], int]] = {"hash-64": (lambda: HashEncoder(64), 64)}


def register(model_id: str, loader: Callable[[], HashEncoder], dim: int) -> None:
    REGISTRY[model_id] = (loader, dim)


def encoder(model_id: str) -> tuple[Callable[[], HashEncoder], int]:
    if model_id not in REGISTRY:
        raise KeyError(f"unknown model {model_id}; known: {sorted(REGISTRY)}")
    return REGISTRY[model_id]


def encode_texts(df: DataFrame, model_id: str = "hash-64", text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds the vector of ``text``; null text has none."""
    loader, _ = encoder(model_id)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for s in batches:
            vectors = iter(model.texts(s.dropna().tolist()))
            yield pd.Series([None if v is None else next(vectors) for v in s.where(s.notna(), None)])

    return df.withColumn(out, run(text))


def embed_chips(chips: DataFrame, model_id: str, bands: str, fresh: DataFrame | None = None) -> DataFrame:
    """Vectors of chips (cycle, chip_id, pixels: binary, n_bands, h, w); cells in ``fresh`` (model_id, bands, cycle) are skipped before any model is loaded."""
    loader, _ = encoder(model_id)
    if fresh is not None:
        done = fresh.filter((F.col("model_id") == model_id) & (F.col("bands") == bands)).select("cycle")
        chips = chips.join(done, "cycle", "left_anti")

    def run(batches):
        model = loader()
        for pdf in batches:
            arrays = [np.frombuffer(p, np.uint8).reshape(b, h, w) for p, b, h, w in zip(pdf["pixels"], pdf["n_bands"], pdf["h"], pdf["w"])]
            yield pd.DataFrame({"model_id": model_id, "bands": bands, "source_cycle": pdf["cycle"], "chip_id": pdf["chip_id"], "embedding": list(model.images(arrays))})

    return chips.mapInPandas(run, "model_id string, bands string, source_cycle string, chip_id string, embedding array<float>")
