"""Lookup tables: the value of the bin that holds a point, of the point before it, or of the nearest one.

A table of at most ``DRIVER_ROWS`` entries becomes two constant arrays in the plan: a lookup is then arithmetic or a binary search
in a scan, without a shuffle. Larger tables are joined with ``asof_join`` or ``range_join``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import last_at_or_below, literal_array
from ..functions.quantity import NAN, Quantity
from ..units import Unit, UnitError
from .array import CoordError, LabelledArray
from .binning import Binned, bin_index

#: Entries of a table that go into the plan as constant arrays (about 16 bytes each).
DRIVER_ROWS = 4_000_000


@dataclass(frozen=True)
class Lookup:
    dim: str
    unit: Unit | None
    coord_unit: Unit | None
    breaks: np.ndarray
    values: list
    fill: object
    histogram: bool

    def column(self, x: Column) -> Column:
        """The looked-up value of a column of points; null points get the fill value."""
        n, fill = len(self.values), F.lit(self.fill)
        if not n:
            return fill
        table = literal_array(self.values)
        if self.histogram:
            return F.coalesce(F.get(table, bin_index(x, self.breaks).cast("int")), fill)
        place = last_at_or_below(x, self.breaks).cast("int")
        return F.when(x.isNull() | (x < float(self.breaks[0])), fill).otherwise(F.get(table, place))  # NaN is above all, so it gets the last

    def __getitem__(self, x: Quantity) -> Quantity:
        if x.unit != self.coord_unit:
            raise UnitError(f"points in {x.unit}, table in {self.coord_unit}")
        return Quantity(self.column(x.value), None, self.unit)

    def scale(self, binned: Binned, divide: bool = False) -> Binned:
        """Every event's value times (or over) the table at the event's coordinate; 0 outside the table."""
        e = binned.events
        factor = replace(self, fill=0.0)[e.coord(self.dim)]
        if divide:
            value = F.when(factor.value == 0, F.lit(0.0)).otherwise(e.quantity.value / F.nullif(factor.value, F.lit(0.0)))
            spread = None if e.quantity.variance is None else F.when(factor.value == 0, F.lit(0.0)).otherwise(e.quantity.variance / F.nullif(factor.value * factor.value, F.lit(0.0)))
            found = Quantity(value, spread, e.unit / self.unit)
        else:
            found = e.quantity * factor
        return replace(binned, events=replace(e, df=binned._keep_dims(found), unit=found.unit, dtype="float64"))


def lookup(array: LabelledArray, dim: str, mode: str = "nearest", fill_value: object = None) -> Lookup:
    """A table from a one-dim array: a histogram's bins, or points with ``mode`` "previous" or "nearest"."""
    c = array.coords.get(dim)
    if array.dims != (dim,) or c is None:
        raise CoordError("a table has one dim and its coordinate")
    applied = [m for m, own in array.masks.items() if dim in own]
    columns = [dim, "value", *(f"m_{m}" for m in applied)] + ([] if c.edges is not None else [f"c_{dim}"])
    if array.df.count() > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} entries: join with asof_join or range_join")
    rows = array.df.select(*columns).toArrow().sort_by(dim).to_pylist()
    fill = fill_value if fill_value is not None else {"bool": False, "int64": 0, "int32": 0}.get(array.dtype, NAN)
    hidden = [any(r[f"m_{m}"] for m in applied) for r in rows]
    if c.edges is not None:
        return Lookup(dim, array.unit, c.unit, np.asarray(c.edges), [fill if h else r["value"] for r, h in zip(rows, hidden, strict=True)], fill, True)
    points = sorted((r[f"c_{dim}"], r["value"]) for r, h in zip(rows, hidden, strict=True) if not h)
    at = np.array([p for p, _ in points])
    if mode == "nearest" and len(at):
        at = np.concatenate([[-np.inf], (at[:-1] + at[1:]) / 2])
    elif mode not in ("previous", "nearest"):
        raise ValueError(f"no such mode: {mode}")
    return Lookup(dim, array.unit, c.unit, at, [v for _, v in points], fill, False)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, value: str, by: list[str] | None = None, chunks: int = 64) -> DataFrame:
    """Each row of ``left`` with ``value`` of the last row of ``right`` at or before it (null before the first).

    Both sides are cut into ``chunks`` ranges of the key; within ``by`` and a range a window carries the last value on, and the
    last value of the ranges before comes from one aggregate row for each range. No key's rows need to meet in one task.
    Of rows of ``right`` with equal keys the greatest value counts.
    """
    by = by or []
    ends = right.agg(F.min(right_on).cast("double").alias("lo"), F.max(right_on).cast("double").alias("hi")).first()
    low, high = (0.0, 1.0) if ends["lo"] is None else (ends["lo"], max(ends["hi"], ends["lo"] + 1e-9))
    chunk = lambda x: F.when(x.isNull(), F.lit(-2)).otherwise(F.greatest(F.lit(-1), F.least(F.lit(chunks), F.floor((x.cast("double") - low) / (high - low) * chunks))).cast("int"))
    r = right.select(*by, F.col(right_on).alias("_k"), F.col(value).alias("_v")).where("_k IS NOT NULL").groupBy(*by, "_k").agg(F.max("_v").alias("_v")).withColumn("_c", chunk(F.col("_k")))
    last = r.groupBy(*by, "_c").agg(F.max_by("_v", "_k").alias("_last"))
    every = last.select(*by, "_c", "_last").unionByName(left.select(*by, chunk(F.col(left_on)).alias("_c")).distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)))
    every = every.groupBy(*by, "_c").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*by, "_c", F.last("_last", ignorenulls=True).over(before).alias("_carried"))  # at most chunks + 3 rows for each by
    l = left.withColumn("_k", F.col(left_on)).withColumn("_c", chunk(F.col(left_on))).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType))
    both = l.unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_c").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    on = [F.col(f"l.{b}").eqNullSafe(F.col(f"c.{b}")) for b in by] + [F.col("l._c") == F.col("c._c")]
    joined = found.alias("l").join(carried.alias("c"), on, "left")
    matched = F.when(F.col("l._k").isNotNull(), F.coalesce(F.col("l._found"), F.col("c._carried")))
    return joined.select(*(F.col(f"l.{c}") for c in left.columns), matched.alias(f"{value}_asof"))


def range_join(left: DataFrame, right: DataFrame, on: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose ``[low, high)`` holds them: an equi-join on cells of ``width``, then the exact test."""
    cells = right.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.withColumn("_cell", F.floor(F.col(on) / width)).join(cells, "_cell").where((F.col(on) >= F.col(low)) & (F.col(on) < F.col(high))).drop("_cell")
