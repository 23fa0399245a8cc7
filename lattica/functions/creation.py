"""Arrays out of nothing, made by the cluster: positions are a range, values are expressions of the position."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.array import LabelledArray, from_numpy
from ..operators.binning import dense_grid
from ..units import Unit, unit_of
from .quantity import SPARK, Quantity


def _grid(spark: SparkSession, sizes: dict[str, int], value: Column, unit: str | Unit | None, dtype: str, variance: Column | None = None) -> LabelledArray:
    df = dense_grid(spark, sizes).select(*sizes, value.cast(SPARK[dtype]).alias("value"), *([variance.cast("double").alias("variance")] if variance is not None else []))
    return LabelledArray(df, tuple(sizes), dict(sizes), {}, {}, unit_of(unit), dtype, variance is not None)


def full(spark: SparkSession, sizes: dict[str, int], value: object, variance: float | None = None, unit: str | Unit | None = "one", dtype: str = "float64") -> LabelledArray:
    return _grid(spark, sizes, F.lit(value), unit, dtype, None if variance is None else F.lit(variance))


def zeros(spark: SparkSession, sizes: dict[str, int], unit: str | Unit | None = "one", dtype: str = "float64", with_variances: bool = False) -> LabelledArray:
    return full(spark, sizes, 0, 0.0 if with_variances else None, unit, dtype)


def ones(spark: SparkSession, sizes: dict[str, int], unit: str | Unit | None = "one", dtype: str = "float64", with_variances: bool = False) -> LabelledArray:
    return full(spark, sizes, 1, 1.0 if with_variances else None, unit, dtype)


empty = zeros


def full_like(x: LabelledArray, value: object, variance: float | None = None, unit: str | Unit | None = "same", dtype: str | None = None) -> LabelledArray:
    kind = dtype or x.dtype
    return replace(x, df=x.df.select(*x.dims, F.lit(value).cast(SPARK[kind]).alias("value"), *([F.lit(float(variance)).alias("variance")] if variance is not None else [])), coords={}, masks={}, unit=x.unit if unit == "same" else unit_of(unit), dtype=kind, has_variance=variance is not None)


def zeros_like(x: LabelledArray, **options) -> LabelledArray:
    return full_like(x, 0, 0.0 if x.has_variance else None, **options)


def ones_like(x: LabelledArray, **options) -> LabelledArray:
    return full_like(x, 1, 1.0 if x.has_variance else None, **options)


empty_like = zeros_like


def scalar(value: object, variance: float | None = None, unit: str | Unit | None = "one") -> Quantity:
    from .quantity import quantity

    found = quantity(value, unit)
    return replace(found, variance=F.lit(float(variance))) if variance is not None else found


def index(value: int) -> Quantity:
    return Quantity(F.lit(value).cast("long"), None, None, "int64")


def array(spark: SparkSession, dims: Iterable[str], values, variances=None, unit: str | Unit | None = "one") -> LabelledArray:
    return from_numpy(spark, dims, np.asarray(values), variances, unit)


def linspace(spark: SparkSession, dim: str, start: float, stop: float, num: int, endpoint: bool = True, unit: str | Unit | None = "one") -> LabelledArray:
    parts = max(num - 1 if endpoint else num, 1)
    value = F.col(dim) * ((stop - start) / parts) + start
    return _grid(spark, {dim: num}, F.when(F.col(dim) == num - 1, F.lit(float(stop))).otherwise(value) if endpoint and num > 1 else value, unit, "float64")


def logspace(spark: SparkSession, dim: str, start: float, stop: float, num: int, base: float = 10.0, endpoint: bool = True, unit: str | Unit | None = "one") -> LabelledArray:
    return linspace(spark, dim, start, stop, num, endpoint, unit).map(lambda x: replace(x, value=F.pow(F.lit(base), x.value)))


def geomspace(spark: SparkSession, dim: str, start: float, stop: float, num: int, endpoint: bool = True, unit: str | Unit | None = "one") -> LabelledArray:
    ratio = stop / start
    return linspace(spark, dim, 0.0, 1.0, num, endpoint, unit).map(lambda x: replace(x, value=F.when(x.value == 1, F.lit(float(stop))).otherwise(F.pow(F.lit(ratio), x.value) * start)))


def arange(spark: SparkSession, dim: str, start: float, stop: float | None = None, step: float = 1, unit: str | Unit | None = "one", dtype: str | None = None) -> LabelledArray:
    start, stop = (0, start) if stop is None else (start, stop)
    whole = all(isinstance(x, int) for x in (start, stop, step))
    return _grid(spark, {dim: max(0, int(np.ceil((stop - start) / step)))}, F.col(dim) * step + start, unit, dtype or ("int64" if whole else "float64"))


def datetimes(spark: SparkSession, dim: str, values: list[str], unit: str = "s") -> LabelledArray:
    """Zone-less times as whole numbers of ``unit`` since 1970."""
    if any(v.endswith("Z") or "+" in v for v in values):
        raise ValueError("times with a zone are not taken")
    at = np.array(values, dtype=f"datetime64[{unit}]").astype(np.int64)
    return replace(from_numpy(spark, [dim], at, unit=unit), dtype="datetime")


def datetime(value: str, unit: str = "s") -> Quantity:
    return Quantity(F.lit(int(np.datetime64(value, unit).astype(np.int64))), None, unit_of(unit), "datetime")


def epoch(unit: str = "s") -> Quantity:
    return Quantity(F.lit(0).cast("long"), None, unit_of(unit), "datetime")


# CODATA 2018, (value, unit, standard uncertainty).
CONSTANTS = {
    "speed of light in vacuum": (299792458.0, "m/s", 0.0),
    "elementary charge": (1.602176634e-19, "C", 0.0),
    "Planck constant": (6.62607015e-34, "J*s", 0.0),
    "Boltzmann constant": (1.380649e-23, "J/K", 0.0),
    "Avogadro constant": (6.02214076e23, "1/mol", 0.0),
    "neutron mass": (1.67492749804e-27, "kg", 9.5e-37),
    "proton mass": (1.67262192369e-27, "kg", 5.1e-37),
    "electron mass": (9.1093837015e-31, "kg", 2.8e-40),
    "standard acceleration of gravity": (9.80665, "m/s^2", 0.0),
}


def physical_constants(key: str, with_variance: bool = False) -> Quantity:
    value, unit, error = CONSTANTS[key]
    return scalar(value, error**2 if with_variance else None, unit)
