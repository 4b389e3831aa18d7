"""Vector functions on array<float> columns: higher-order expressions in double precision, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    same = F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different dimension")))
    return F.when(a.isNotNull() & b.isNotNull(), same)


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(a, a, lambda x, y: x * y))


def dims(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a)).cast("bigint")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 where a norm is 0."""
    lengths = norm(a) * norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.when(lengths == 0, 1.0).otherwise(lengths)))
    return F.when(lengths == 0, 0.0).when(lengths.isNotNull(), value)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def normalize(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, x.cast("double")).otherwise(x / size))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "l2": l2_distance,
    "euclidean": l2_distance,
    "cosine": cosine_distance,
    "inner_product": lambda a, b: -inner_product(a, b),
    "ip": lambda a, b: -inner_product(a, b),
    "manhattan": l1_distance,
    "l1": l1_distance,
}


def vector_distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """A distance (smaller is nearer): the inner product is negated."""
    if metric.lower() not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric.lower()](a, b)
