"""Vectors and matrices as tuples of columns: arithmetic that stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def add(a: Vector, b: Vector) -> tuple[Column, ...]:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def subtract(a: Vector, b: Vector) -> tuple[Column, ...]:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vector, by: float | Column) -> tuple[Column, ...]:
    return tuple(p * by for p in a)


def dot(a: Vector, b: Vector) -> Column:
    first, *rest = [p * q for p, q in zip(a, b, strict=True)]
    for part in rest:
        first = first + part
    return first


def cross(a: Vector, b: Vector) -> tuple[Column, ...]:
    """Of three dimensions; of two, the one number that is its third part."""
    if len(a) == 2:
        return (a[0] * b[1] - a[1] * b[0],)
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> tuple[Column, ...]:
    """Of length one; null for a vector of length zero."""
    return tuple(F.try_divide(p, length(a)) for p in a)


def times(matrix: Sequence[Vector], a: Vector) -> tuple[Column, ...]:
    """A matrix, given as rows, by a vector."""
    return tuple(dot(row, a) for row in matrix)


def turned(a: Vector, angle: float | Column) -> tuple[Column, ...]:
    """Counter-clockwise in the plane."""
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    return times(((F.cos(angle), -F.sin(angle)), (F.sin(angle), F.cos(angle))), a)
