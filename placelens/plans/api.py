"""Text search as a Python call: validation, prompts, encoding, search, and places in degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text, vectors
from ..operators.search import Request, search
from .encoders import encode_texts


def query_vector(spark: SparkSession, words: str, model_id: str) -> list[float]:
    """The mean direction of the text's prompts."""
    rows = spark.createDataFrame([(0, p) for p in text.prompts_for(words)], "key int, text string")
    return vectors.mean_directions(encode_texts(rows, model_id), "key").first()["q"]


def in_degrees(hits: DataFrame, bands: str) -> DataFrame:
    """Adds lat, lon, the box as a closed ring of (lat, lon), and the thumbnail key."""
    lon, lat = geo.to_degrees(F.col("cx"), F.col("cy"))
    return hits.withColumns({"lat": lat, "lon": lon, "ring": ring(), "thumbnail": text.thumbnail_key(F.col("chip_location_id"), F.col("winning_cycle"), F.lit(bands))})


def ring():
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    at = [geo.to_degrees(F.col(x), F.col(y)) for x, y in corners]
    return F.array(*[F.struct(la.alias("lat"), lo.alias("lon")) for lo, la in at])


def search_text(spark: SparkSession, store: DataFrame, words: str, top_k: int = 10, inside_aoi_only: bool = False, model_id: str = "hash-64", bands: str = "rgb") -> DataFrame:
    if not 1 <= len(words) <= 500:
        raise ValueError("text must have 1 to 500 characters")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be 1 to 100")
    request = Request(top_k=top_k, model_id=model_id, bands=bands, inside_aoi_only=inside_aoi_only)
    return in_degrees(search(store, query_vector(spark, words, model_id), request), bands)


def health(spark: SparkSession, store: DataFrame) -> dict:
    return {"status": "ok", "spark": spark.version, "has_rows": not store.isEmpty()}
