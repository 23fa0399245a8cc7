"""Vectors, rotations, translations and linear maps as structs and arrays of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _bound(*columns: Column, then) -> Column:
    """``then`` of the columns with each of them worked out once: nested vector formulas would repeat them beyond all bounds."""
    packed = F.struct(*(c.alias(f"b{k}") for k, c in enumerate(columns)))
    return F.get(F.transform(F.array(packed), lambda b: then(*(b[f"b{k}"] for k in range(len(columns))))), F.lit(0))


def as_vectors(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def vector(x: float, y: float, z: float) -> Column:
    return as_vectors(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return as_vectors(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return as_vectors(a["x"] * by, a["y"] * by, a["z"] * by)


def translated(a: Column, by: Column) -> Column:
    return as_vectors(a["x"] + by["x"], a["y"] + by["y"], a["z"] + by["z"])


def linear_transform(rows: list[list[float]]) -> Column:
    """Nine numbers, row by row."""
    return F.array(*(F.lit(float(v)) for row in rows for v in row))


def scaling_from_vector(a: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(a["x"], zero, zero, zero, a["y"], zero, zero, zero, a["z"])


def transformed(m: Column, a: Column) -> Column:
    def apply(m: Column, a: Column) -> Column:
        row = lambda k: F.get(m, F.lit(3 * k)) * a["x"] + F.get(m, F.lit(3 * k + 1)) * a["y"] + F.get(m, F.lit(3 * k + 2)) * a["z"]
        return as_vectors(row(0), row(1), row(2))

    return _bound(m, a, then=apply)


def product(m: Column, n: Column) -> Column:
    at = lambda x, i, j: F.get(x, F.lit(3 * i + j))
    return _bound(m, n, then=lambda m, n: F.array(*(at(m, i, 0) * at(n, 0, j) + at(m, i, 1) * at(n, 1, j) + at(m, i, 2) * at(n, 2, j) for i in range(3) for j in range(3))))


def affine_transform(m: Column, shift: Column) -> Column:
    return F.struct(m.alias("linear"), shift.alias("shift"))


def affine_transformed(t: Column, a: Column) -> Column:
    return translated(transformed(t["linear"], a), t["shift"])


def inverse(m: Column) -> Column:
    """Of nine numbers, by cofactors; null for a singular map."""
    return _bound(m, then=_inverse)


def _inverse(m: Column) -> Column:
    e = [F.get(m, F.lit(k)) for k in range(9)]
    minor = lambda i, j: [e[3 * r + c] for r in range(3) if r != i for c in range(3) if c != j]
    cofactor = [[(lambda p: (p[0] * p[3] - p[1] * p[2]) * (-1) ** (i + j))(minor(i, j)) for j in range(3)] for i in range(3)]
    det = e[0] * cofactor[0][0] + e[1] * cofactor[0][1] + e[2] * cofactor[0][2]
    return F.when(det != 0, F.array(*(F.try_divide(cofactor[j][i], det) for i in range(3) for j in range(3))))


def affine_inverse(t: Column) -> Column:
    back = inverse(t["linear"])
    return affine_transform(back, scaled(transformed(back, t["shift"]), F.lit(-1.0)))


def rotation(x: Column, y: Column, z: Column, w: Column) -> Column:
    """A unit quaternion, normalised."""
    size = F.sqrt(x * x + y * y + z * z + w * w)
    return F.struct(*(F.try_divide(v, size).alias(n) for n, v in (("x", x), ("y", y), ("z", z), ("w", w))))


def rotations_from_rotvecs(a: Column) -> Column:
    """From axis times angle in rad."""
    return _bound(a, norm(a), then=_from_rotvec)


def _from_rotvec(a: Column, angle: Column) -> Column:
    by = F.when(angle == 0, F.lit(0.5)).otherwise(F.try_divide(F.sin(angle / 2), angle))
    return F.struct((a["x"] * by).alias("x"), (a["y"] * by).alias("y"), (a["z"] * by).alias("z"), F.cos(angle / 2).alias("w"))


def rotation_as_rotvec(q: Column) -> Column:
    """Axis times angle in rad, the shorter way round."""
    return _bound(q, then=_as_rotvec)


def _as_rotvec(q: Column) -> Column:
    size = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    sign = F.when(q["w"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    by = F.when(size == 0, F.lit(2.0)).otherwise(F.try_divide(2 * F.atan2(size, q["w"] * sign), size)) * sign
    return as_vectors(q["x"] * by, q["y"] * by, q["z"] * by)


def rotated(q: Column, a: Column) -> Column:
    return _bound(q, a, then=lambda q, a: _bound(q, a, scaled(cross(q, a), F.lit(2.0)), then=_rotated))


def _rotated(q: Column, a: Column, t: Column) -> Column:
    return translated(translated(a, scaled(t, q["w"])), cross(q, t))


def rotation_inverse(q: Column) -> Column:
    return F.struct((-q["x"]).alias("x"), (-q["y"]).alias("y"), (-q["z"]).alias("z"), q["w"].alias("w"))
