"""Column expressions over fixed-width numeric arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: double-precision machine epsilon.
EPSILON = 2.220446049250313e-16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    Expressions inside a lambda run once per element, so a norm written there would
    make normalising quadratic in the vector width.
    """
    return F.transform(F.array(value), body)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def _divide(vec: Column, norm: Column) -> Column:
    return let(norm, lambda n: F.transform(doubles(vec), lambda x: x / n))


def l2_normalise(vec: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = l2_norm(vec)
    return _divide(vec, F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def l1_normalise(vec: Column) -> Column:
    """Absolute values sum to one; a zero vector is divided by machine epsilon."""
    norm = F.aggregate(doubles(vec), F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return _divide(vec, F.when(norm == 0, F.lit(EPSILON)).otherwise(norm))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def drop_dims(vec: Column, dims: Column) -> Column:
    """Vector without the positions listed in ``dims``."""
    return F.filter(vec, lambda _, i: ~F.array_contains(dims, i))
