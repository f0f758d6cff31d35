"""Arrays of doubles as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column | str, floor: float = 1e-8) -> Column:
    """``a`` over its length, where the length counts ``floor`` at least."""
    return F.transform(_col(a), lambda v: v / F.greatest(norm(a), F.lit(floor)))


def argmax(a: Column | str) -> Column:
    """The first place, from 0, of the largest entry."""
    return (F.array_position(_col(a), F.array_max(_col(a))) - 1).cast("int")


def vector_sum(column: str, width: int) -> Column:
    """Aggregate: the sum of arrays of ``width`` doubles, place by place, combined before the shuffle."""
    return F.array(*[F.sum(F.get(F.col(column), i)) for i in range(width)])
