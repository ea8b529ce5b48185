"""Vector arithmetic as Column expressions. Products are taken in double whatever the stored type."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0, where the cosine is not defined."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalise(a: Column) -> Column:
    """Null for a zero vector."""
    length = F.nullif(norm(a), F.lit(0.0))
    return F.when(length.isNotNull(), F.transform(a, lambda x: x.cast("double") / length))


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_sql(column: str, vector: list[float]) -> str:
    """``cosine`` of a column and a constant vector as SQL text: one call to the JVM, where an expression of columns takes hundreds."""
    length = 0.0
    for x in vector:  # in the order of the sum over rows
        length += x * x
    q = f"cast(split('{','.join(repr(float(x)) for x in vector)}', ',') AS array<double>)"
    total = lambda values: f"aggregate({values}, 0D, (t, v) -> t + v)"
    norm_ = f"sqrt({total(f'transform({column}, x -> cast(x AS double) * cast(x AS double))')})"
    return f"{total(f'zip_with({column}, {q}, (x, y) -> cast(x AS double) * y)')} / nullif({norm_} * {math.sqrt(length)!r}D, 0D)"


def check_query(vector) -> list[float]:
    """A flat, non-empty list of numbers, or ValueError."""
    try:
        values = [float(x) for x in vector]
    except TypeError as e:
        raise ValueError("a query vector must be one-dimensional") from e
    if not values:
        raise ValueError("a query vector must not be empty")
    return values


def mean_directions(vectors: DataFrame, key: str, vector: str = "embedding", out: str = "q") -> DataFrame:
    """key and one array: the mean of the unit vectors of each key, normalised again. Partial sums are one array a key and task.

    Null and zero vectors have no direction and raise; so do a key whose mean is zero and one with vectors of several lengths.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    checked = F.when(norm(F.col(vector)) > 0, normalise(F.col(vector))).otherwise(F.raise_error(F.lit("a zero vector has no direction")))
    mean = vectors.groupBy(key).agg(Summarizer.mean(array_to_vector(checked)).alias("m")).select(key, vector_to_array("m").alias("m"))
    unit = F.when(norm(F.col("m")) > 0, normalise(F.col("m"))).otherwise(F.raise_error(F.lit("the mean of the vectors is zero")))
    return mean.select(key, unit.alias(out))


def ensemble(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, i, value: ``mean_directions`` in long form."""
    return mean_directions(vectors, key, vector).select(key, F.posexplode("q").alias("i", "value"))


def gather(long: DataFrame, key: str, out: str = "q") -> DataFrame:
    """One array a key from (key, i, value); the arrays are as long as vectors are, whatever the number of rows."""
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("s")).select(key, F.transform("s", lambda s: s["value"]).alias(out))


def quality(vectors: DataFrame, dim: int, tolerance: float = 1e-3, vector: str = "embedding") -> DataFrame:
    """One row: rows, wrong dimension, null or NaN components, zero vectors, and vectors whose norm is off 1."""
    v = F.col(vector)
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    length = norm(v)
    return vectors.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce(F.size(v), F.lit(-1)) != dim).alias("n_bad_dim"),
        F.count_if(bad).alias("n_bad_component"),
        F.count_if(~bad & (length == 0)).alias("n_zero"),
        F.count_if(~bad & (F.abs(length - 1) >= tolerance)).alias("n_bad_norm"),
    )
