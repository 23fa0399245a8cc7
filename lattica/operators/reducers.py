"""Aggregates with the semantics of labelled arrays: masks and NaN, identity elements for empty groups, variances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.quantity import NAN, SPARK, DTypeError, VariancesError
from ..units import Unit

#: Least and greatest of each type, the results of ``max`` and ``min`` over nothing.
LIMITS = {"float64": (-1.7976931348623157e308, 1.7976931348623157e308), "float32": (-3.4028234663852886e38, 3.4028234663852886e38), "int64": (-(2**63), 2**63 - 1), "int32": (-(2**31), 2**31 - 1), "bool": (False, True)}

NAMES = ("sum", "nansum", "mean", "nanmean", "min", "max", "nanmin", "nanmax", "all", "any", "median", "nanmedian")


def identity(op: str, dtype: str) -> object:
    if op in ("sum", "nansum"):
        return 0.0 if dtype.startswith("float") else 0
    if op in ("mean", "nanmean", "median", "nanmedian", "var", "std", "nanvar", "nanstd"):
        return NAN
    if op == "all":
        return True
    if op == "any":
        return False
    return LIMITS[dtype][op in ("min", "nanmin")]


def result_dtype(op: str, dtype: str) -> str:
    if op in ("sum", "nansum"):
        return "int64" if dtype == "bool" else dtype
    return "bool" if op in ("all", "any") else dtype if op in ("min", "max", "nanmin", "nanmax") else "float32" if dtype == "float32" else "float64"


def result_unit(op: str, unit: Unit | None) -> Unit | None:
    return unit * unit if op in ("var", "nanvar") and unit is not None else unit


def aggregate(op: str, value: Column, variance: Column | None, keep: Column | None, dtype: str, ddof: int | None = None) -> tuple[Column, Column | None]:
    """The aggregate of ``value`` and of its variance over the rows that ``keep`` (a column without nulls) admits."""
    is_float = dtype.startswith("float")
    skip_nan = op.startswith("nan")
    base = op.removeprefix("nan")
    if base in ("all", "any") and dtype != "bool":
        raise DTypeError(f"{op} needs booleans")
    if variance is not None and base in ("median", "var", "std"):
        raise VariancesError(f"{op} has no rule for variances")
    if skip_nan and is_float:
        keep = ~F.isnan(value) if keep is None else keep & ~F.isnan(value)
    number = value.cast("long") if dtype == "bool" and base == "sum" else value.cast("double") if dtype == "float32" else value
    kept = number if keep is None else F.when(keep, number)
    kept_variance = None if variance is None else variance if keep is None else F.when(keep, variance)
    empty = F.lit(identity(op, dtype))
    out = SPARK[result_dtype(op, dtype)]
    count = F.count(kept)
    spread = None
    if base == "sum":
        found = F.coalesce(F.sum(kept), F.lit(0))
        spread = None if variance is None else F.coalesce(F.sum(kept_variance), F.lit(0.0))
    elif base == "mean":
        found = F.when(count == 0, empty).otherwise(F.sum(kept.cast("double")) / F.nullif(count, F.lit(0)))
        spread = None if variance is None else F.when(count == 0, F.lit(NAN)).otherwise(F.sum(kept_variance) / F.nullif(count * count, F.lit(0)))
    elif base in ("min", "max"):
        pick = F.min if base == "min" else F.max
        found = pick(kept)
        if is_float and not skip_nan:  # NaN is contagious: it is the greatest value to max(), but min() has to be told
            found = F.when(F.max(F.isnan(kept)), F.lit(NAN)).otherwise(found)
        found = F.coalesce(found, empty)
        if variance is not None:
            by = F.min_by if base == "min" else F.max_by
            spread = F.coalesce(by(kept_variance, kept), F.lit(0.0))
    elif base == "all":
        found = F.coalesce(F.bool_and(kept), empty)
    elif base == "any":
        found = F.coalesce(F.bool_or(kept), empty)
    elif base == "median":
        found = F.coalesce(F.percentile(kept.cast("double"), F.lit(0.5)), empty)
        if is_float and not skip_nan:
            found = F.when(F.coalesce(F.max(F.isnan(kept)), F.lit(False)), F.lit(NAN)).otherwise(found)
    elif base in ("var", "std"):
        if ddof is None:
            raise TypeError(f"{op} needs ddof")
        found = F.when(count <= ddof, F.lit(NAN)).otherwise(F.var_pop(kept.cast("double")) * count / F.nullif(count - ddof, F.lit(0)))
        found = F.sqrt(found) if base == "std" else found
    else:
        raise ValueError(f"no such reduction: {op}")
    return found.cast(out), spread
