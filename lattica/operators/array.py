"""Labelled arrays in long form: a row per element, positions and coordinates as columns, the rest as metadata of the driver.

``df`` has one bigint column per dim, ``value`` and perhaps ``variance``, ``c_<name>`` for each coordinate kept per element and
``m_<name>`` for each mask. Bin edges stay on the driver. Units, dims and coordinates are checked before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce as fold_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quantity as q
from ..functions.quantity import KINDS, Quantity
from ..plans.shared import checkpointed
from ..units import ONE, Unit, UnitError, unit_of
from . import reducers


#: Positions that one task of a running sum or of neighbours takes.
CHUNK = 1 << 17
#: The size of a dim whose rows have no positions.
UNKNOWN = -1


class DimensionError(RuntimeError):
    pass


class CoordError(RuntimeError):
    pass


class BinEdgeError(RuntimeError):
    pass


@dataclass(frozen=True)
class Coord:
    """A coordinate over ``dims``: a column of the frame, bin edges along one dim held here, or many labels of bins in a frame of label and place."""

    dims: tuple[str, ...]
    unit: Unit | None = ONE
    dtype: str = "float64"
    edges: np.ndarray | None = None
    aligned: bool = True
    labels: DataFrame | None = None


@dataclass(frozen=True)
class LabelledArray:
    df: DataFrame
    dims: tuple[str, ...]
    sizes: dict[str, int]
    coords: dict[str, Coord]
    masks: dict[str, tuple[str, ...]]
    unit: Unit | None = ONE
    dtype: str = "float64"
    has_variance: bool = False
    name: str = ""

    # -- inspection ---------------------------------------------------------------------------------------------------

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.sizes[d] for d in self.dims)

    @property
    def ndim(self) -> int:
        return len(self.dims)

    def size_of(self, dim: str) -> int:
        """The size of a dim whose rows have positions."""
        if dim not in self.sizes:
            raise DimensionError(f"no dim {dim!r} in {self.dims}")
        if self.sizes[dim] == UNKNOWN:
            raise DimensionError(f"the rows along {dim!r} have no positions: give table() an order")
        return self.sizes[dim]

    @property
    def quantity(self) -> Quantity:
        return Quantity(F.col("value"), F.col("variance") if self.has_variance else None, self.unit, self.dtype)

    def coord(self, name: str) -> Quantity:
        if name not in self.coords or self.coords[name].edges is not None:
            raise CoordError(f"no coordinate column {name!r}")
        return Quantity(F.col(f"c_{name}"), None, self.coords[name].unit, self.coords[name].dtype)

    def is_edges(self, name: str, dim: str | None = None) -> bool:
        return self.coords[name].edges is not None and (dim is None or dim in self.coords[name].dims)

    def to_numpy(self) -> np.ndarray:
        """The values on the driver; for arrays that fit there."""
        rows = self.df.select(*self.dims, "value").toPandas()
        out = np.full(self.shape, np.nan, dtype=object if self.dtype == "string" else None)
        out = out.astype(rows["value"].dtype) if len(rows) else out
        out[tuple(rows[d].to_numpy() for d in self.dims)] = rows["value"].to_numpy()
        return out

    def _columns(self) -> list[str]:
        return [*self.dims, *(f"c_{n}" for n, c in self.coords.items() if c.edges is None), *(f"m_{m}" for m in self.masks)]

    def _with(self, found: Quantity, **changes) -> LabelledArray:
        columns = [F.col(c) for c in self._columns()] + [found.value.alias("value")]
        if found.variance is not None:
            columns.append(found.variance.alias("variance"))
        return replace(self, df=self.df.select(*columns), unit=found.unit, dtype=found.dtype, has_variance=found.variance is not None, **changes)

    # -- element-wise -------------------------------------------------------------------------------------------------

    def map(self, function: Callable[..., Quantity], *args, **kwargs) -> LabelledArray:
        """Apply an element-wise function of ``functions.quantity``."""
        return self._with(function(self.quantity, *args, **kwargs))

    def _binary(self, function: Callable[..., Quantity], other: object, swapped: bool = False) -> LabelledArray:
        if not isinstance(other, LabelledArray):
            x, y = self.quantity, q.quantity(other) if not isinstance(other, Quantity) else other
            return self._with(function(y, x) if swapped else function(x, y))
        if not set(other.dims) <= set(self.dims):
            if set(self.dims) <= set(other.dims):
                return other._binary(function, self, not swapped)
            raise DimensionError(f"dims {self.dims} and {other.dims}: one has to hold the other")
        if other.df is self.df and other.dims == self.dims and set(other.masks) <= set(self.masks) and set(other.coords) <= set(self.coords):
            return self._with(function(other.quantity, self.quantity) if swapped else function(self.quantity, other.quantity))
        if any(self.sizes[d] == UNKNOWN or other.sizes[d] == UNKNOWN for d in other.dims):
            raise DimensionError("rows of a table without order have no positions to meet by: give table() an order, or use columns of one frame")
        if any(self.sizes[d] != other.sizes[d] for d in other.dims):
            raise DimensionError("sizes differ")
        if other.has_variance and len(other.dims) < len(self.dims):
            raise q.VariancesError("variances cannot be broadcast: the results would be correlated")
        coords = self._matched(other)
        keep = {n: c for n, c in coords.items()}
        theirs = other.df.select(*(F.col(d).alias(f"_{d}") for d in other.dims), F.col("value").alias("_value"), *([F.col("variance").alias("_variance")] if other.has_variance else []), *(F.col(f"m_{m}").alias(f"_m_{m}") for m in other.masks), *(F.col(f"c_{n}") for n, c in keep.items() if c.edges is None and n not in self.coords))
        on = [F.col(d) == F.col(f"_{d}") for d in other.dims] or [F.lit(True)]
        joined = self.df.join(theirs, fold_left(lambda a, b: a & b, on))
        y = Quantity(F.col("_value"), F.col("_variance") if other.has_variance else None, other.unit, other.dtype)
        found = function(y, self.quantity) if swapped else function(self.quantity, y)
        masks = {**other.masks, **self.masks}
        mask_columns = []
        for m in masks:
            mine, its = F.col(f"m_{m}") if m in self.masks else None, F.col(f"_m_{m}") if m in other.masks else None
            mask_columns.append((mine if its is None else its if mine is None else mine | its).alias(f"m_{m}"))
        columns = [*(F.col(d) for d in self.dims), *(F.col(f"c_{n}") for n, c in keep.items() if c.edges is None), *mask_columns, found.value.alias("value")]
        if found.variance is not None:
            columns.append(found.variance.alias("variance"))
        return replace(self, df=joined.select(*columns), coords=keep, masks=masks, unit=found.unit, dtype=found.dtype, has_variance=found.variance is not None)

    def _matched(self, other: LabelledArray) -> dict[str, Coord]:
        """The union of coordinates: aligned ones in both have to be equal, others that differ are dropped."""
        out = dict(self.coords)
        for name, theirs in other.coords.items():
            mine = self.coords.get(name)
            if mine is None:
                out[name] = theirs
                continue
            same = mine.unit == theirs.unit and mine.dims == theirs.dims
            if same and mine.edges is not None:
                same = theirs.edges is not None and np.array_equal(mine.edges, theirs.edges, equal_nan=mine.edges.dtype.kind == "f")
            elif same:
                same = self.df is other.df or self._equal_columns(other, name, mine.dims)
            if not same:
                if mine.aligned and theirs.aligned:
                    raise CoordError(f"coordinate {name!r} differs")
                out.pop(name)
        return out

    def _equal_columns(self, other: LabelledArray, name: str, dims: tuple[str, ...]) -> bool:
        mine, theirs = self.df.select(*dims, F.col(f"c_{name}").alias("a")).distinct(), other.df.select(*dims, F.col(f"c_{name}").alias("b")).distinct()
        joined = mine.join(theirs, list(dims), "full") if dims else mine.crossJoin(theirs)
        return joined.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()

    def __add__(self, other): return self._binary(q.add, other)
    def __sub__(self, other): return self._binary(q.subtract, other)
    def __mul__(self, other): return self._binary(q.multiply, other)
    def __truediv__(self, other): return self._binary(q.divide, other)
    def __floordiv__(self, other): return self._binary(q.floor_divide, other)
    def __mod__(self, other): return self._binary(q.mod, other)
    def __pow__(self, other): return self.map(q.pow, other) if not isinstance(other, LabelledArray) else self._binary(q.pow, other)
    def __radd__(self, other): return self._binary(q.add, other, True)
    def __rsub__(self, other): return self._binary(q.subtract, other, True)
    def __rmul__(self, other): return self._binary(q.multiply, other, True)
    def __rtruediv__(self, other): return self._binary(q.divide, other, True)
    def __rfloordiv__(self, other): return self._binary(q.floor_divide, other, True)
    def __rmod__(self, other): return self._binary(q.mod, other, True)
    def __rpow__(self, other): return self._binary(q.pow, other, True)
    def __lt__(self, other): return self._binary(q.less, other)
    def __gt__(self, other): return self._binary(q.greater, other)
    def __le__(self, other): return self._binary(q.less_equal, other)
    def __ge__(self, other): return self._binary(q.greater_equal, other)
    def __and__(self, other): return self._binary(q.logical_and, other)
    def __or__(self, other): return self._binary(q.logical_or, other)
    def __xor__(self, other): return self._binary(q.logical_xor, other)
    def __invert__(self): return self.map(q.logical_not)
    def __neg__(self): return self.map(q.negative)
    def __abs__(self): return self.map(q.absolute)

    def equal(self, other) -> LabelledArray:
        return self._binary(q.equal, other)

    def not_equal(self, other) -> LabelledArray:
        return self._binary(q.not_equal, other)

    def isclose(self, other, **options) -> LabelledArray:
        return self._binary(lambda a, b: q.isclose(a, b, **options), other)

    def allclose(self, other, **options) -> bool:
        return bool(self.isclose(other, **options).all().df.first()["value"])

    def identical(self, other: LabelledArray, equal_nan: bool = False) -> bool:
        """Whether everything is the same: dims, sizes, unit, dtype, coordinates, masks, values and variances."""
        meta = lambda x: (x.dims, x.sizes, x.unit, x.dtype, x.has_variance, x.masks, x.name, {n: (c.dims, c.unit, c.dtype, c.aligned, None if c.edges is None else c.edges.tolist()) for n, c in x.coords.items()})
        if meta(self) != meta(other):
            return False
        columns = sorted(set(self.df.columns) - set(self.dims))
        joined = self.df.join(other.df.select(*self.dims, *(F.col(c).alias(f"_{c}") for c in columns)), list(self.dims), "full") if self.dims else self.df.crossJoin(other.df.select(*(F.col(c).alias(f"_{c}") for c in columns)))
        differs = F.lit(False)
        for c in columns:
            same = F.col(c).eqNullSafe(F.col(f"_{c}"))
            if not equal_nan and dict(self.df.dtypes)[c] in ("double", "float"):
                same = same & ~F.isnan(F.col(c))
            differs = differs | ~same
        return joined.where(differs).isEmpty()

    def to(self, unit: str | Unit | None = None, dtype: str | None = None) -> LabelledArray:
        return self.map(q.to, unit, dtype)

    def astype(self, dtype: str) -> LabelledArray:
        return self.map(q.astype, dtype)

    # -- metadata -----------------------------------------------------------------------------------------------------

    def assign_data(self, value: Quantity) -> LabelledArray:
        return self._with(value)

    def assign_coords(self, coords: dict[str, Quantity | Coord] | None = None, **more: Quantity | Coord) -> LabelledArray:
        """Quantities of this frame's columns, or edges as a :class:`Coord`."""
        df, known = self.df, dict(self.coords)
        for name, c in {**(coords or {}), **more}.items():
            if isinstance(c, Coord):
                if c.edges is None or len(c.edges) != self.sizes[c.dims[0]] + 1:
                    raise BinEdgeError(f"{name!r} needs one edge more than there are bins")
                known[name] = c
            else:
                df, known[name] = df.withColumn(f"c_{name}", c.value), Coord(self.dims, c.unit, c.dtype)
        return replace(self, df=df, coords=known)

    def assign_masks(self, masks: dict[str, Quantity] | None = None, **more: Quantity) -> LabelledArray:
        df, known = self.df, dict(self.masks)
        for name, m in {**(masks or {}), **more}.items():
            if m.dtype != "bool":
                raise q.DTypeError("a mask is boolean")
            df, known[name] = df.withColumn(f"m_{name}", m.value), self.dims
        return replace(self, df=df, masks=known)

    def drop_coords(self, *names: str) -> LabelledArray:
        return replace(self, df=self.df.drop(*(f"c_{n}" for n in names)), coords={n: c for n, c in self.coords.items() if n not in names})

    def drop_masks(self, *names: str) -> LabelledArray:
        return replace(self, df=self.df.drop(*(f"m_{n}" for n in names)), masks={n: c for n, c in self.masks.items() if n not in names})

    def set_aligned(self, name: str, aligned: bool) -> LabelledArray:
        return replace(self, coords={**self.coords, name: replace(self.coords[name], aligned=aligned)})

    def rename_dims(self, **names: str) -> LabelledArray:
        if len(set(d := [names.get(x, x) for x in self.dims])) < len(d):
            raise DimensionError("two dims would have one name")
        swap = lambda dims: tuple(names.get(x, x) for x in dims)
        return replace(self, df=self.df.withColumnsRenamed(names), dims=swap(self.dims), sizes={names.get(k, k): v for k, v in self.sizes.items()}, coords={n: replace(c, dims=swap(c.dims)) for n, c in self.coords.items()}, masks={n: swap(m) for n, m in self.masks.items()})

    def rename(self, **names: str) -> LabelledArray:
        """Dims and the coordinates of the same names."""
        out = self.rename_dims(**{k: v for k, v in names.items() if k in self.dims})
        return replace(out, df=out.df.withColumnsRenamed({f"c_{k}": f"c_{v}" for k, v in names.items()}), coords={names.get(n, n): c for n, c in out.coords.items()})

    def transpose(self, dims: Iterable[str] | None = None) -> LabelledArray:
        dims = tuple(dims) if dims is not None else self.dims[::-1]
        if set(dims) != set(self.dims):
            raise DimensionError(f"{dims} is no order of {self.dims}")
        return replace(self, dims=dims)

    def squeeze(self, dim: str | None = None) -> LabelledArray:
        out = self
        for d in [dim] if dim else [d for d in self.dims if self.sizes[d] == 1]:
            if self.sizes[d] != 1:
                raise DimensionError(f"{d!r} has not the size 1")
            out = out[d, 0]
        return out

    def broadcast(self, **sizes: int) -> LabelledArray:
        """New leading dims of the given sizes."""
        if self.has_variance:
            raise q.VariancesError("variances cannot be broadcast")
        df = self.df
        for d, n in sizes.items():
            df = df.withColumn(d, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return replace(self, df=df, dims=(*sizes, *self.dims), sizes={**sizes, **self.sizes})

    # -- selection ----------------------------------------------------------------------------------------------------

    def __getitem__(self, key) -> LabelledArray:
        """``x["d", 3]``, ``x["d", 1:5:2]``, ``x["d", [4, 0]]``, ``x["d", 1.5:3.0]`` and ``x["d", 1.5]`` by label (or ``(50, "m")``, to have the unit checked), ``x[condition]``."""
        if key is Ellipsis:
            return self
        if isinstance(key, Column | Quantity):
            return self._where(key.value if isinstance(key, Quantity) else key)
        if not isinstance(key, tuple):
            if self.ndim != 1:
                raise DimensionError("say along which dim")
            key = (self.dims[0], key)
        dim, at = key
        if dim not in self.dims:
            raise DimensionError(f"no dim {dim!r} in {self.dims}")
        n = self.size_of(dim)
        if isinstance(at, int):
            if not -n <= at < n:
                raise IndexError(f"{at} is out of range for {dim!r} of size {n}")
            return self._point(dim, at % n)
        if isinstance(at, list):
            old = [x % n for x in at]
            if any(not -n <= x < n for x in at):
                raise IndexError("an index is out of range")
            wanted = self.df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(old)], "_new long, _old long")
            df = self.df.join(F.broadcast(wanted), F.col(dim) == F.col("_old")).drop(dim, "_old").withColumnRenamed("_new", dim)  # no longer than the list given
            return replace(self, df=df.select(*self.df.columns), sizes={**self.sizes, dim: len(at)}, coords=self._without_edges(dim))
        if isinstance(at, slice) and not any(isinstance(x, tuple | float) for x in (at.start, at.stop)):
            start, stop, step = at.indices(n)
            if step < 1:
                raise IndexError("steps go forward")
            size = max(0, -(-(stop - start) // step))
            d = F.col(dim)
            df = self.df.where((d >= start) & (d < stop) & ((d - start) % step == 0)).withColumn(dim, ((d - start) / step).cast("long"))
            coords = {k: replace(c, edges=c.edges[start : start + size + 1]) if c.edges is not None and dim in c.dims and step == 1 else c for k, c in (self.coords if step == 1 else self._without_edges(dim)).items()}
            return replace(self, df=df, sizes={**self.sizes, dim: size}, coords=coords)
        return self._by_label(dim, at)

    def _without_edges(self, dim: str) -> dict[str, Coord]:
        return {k: c for k, c in self.coords.items() if c.edges is None or dim not in c.dims}

    def _point(self, dim: str, at: int) -> LabelledArray:
        rest = tuple(d for d in self.dims if d != dim)
        coords = {k: replace(c, dims=tuple(d for d in c.dims if d != dim), aligned=c.aligned and dim not in c.dims) for k, c in self._without_edges(dim).items()}
        return replace(self, df=self.df.where(F.col(dim) == at).drop(dim), dims=rest, sizes={d: self.sizes[d] for d in rest}, coords=coords, masks={m: tuple(d for d in dims if d != dim) for m, dims in self.masks.items()})

    def _where(self, condition: Column) -> LabelledArray:
        if self.ndim != 1:
            raise DimensionError("a condition selects along a single dim")
        dim = self.dims[0]
        df = renumbered(self.df.where(condition), dim)
        return replace(self, df=df, sizes={dim: df.count()}, coords=self._without_edges(dim))

    def _by_label(self, dim: str, at) -> LabelledArray:
        c = self.coords.get(dim)
        if c is None or c.dims != (dim,):
            raise CoordError(f"no coordinate {dim!r} along {dim!r}")
        number = lambda x: None if x is None else _label(x, c.unit)
        if c.edges is not None:
            if not isinstance(at, slice):
                bins = np.flatnonzero((c.edges[:-1] <= number(at)) & (number(at) < c.edges[1:]))
                if len(bins) != 1:
                    raise IndexError(f"{at} is in no bin")
                return self._point(dim, int(bins[0]))
            low, high = number(at.start), number(at.stop)
            up = c.edges[0] <= c.edges[-1]
            left, right = (c.edges[:-1], c.edges[1:]) if up else (c.edges[1:], c.edges[:-1])
            inside = (True if low is None else (right > low if up else left <= low)) & (True if high is None else (left < high if up else right >= high)) & np.ones(len(left), bool)
            at_ = np.flatnonzero(inside)
            return self[dim, int(at_[0]) : int(at_[-1]) + 1] if len(at_) else self[dim, 0:0]
        column = F.col(f"c_{dim}")
        if not isinstance(at, slice):
            found = self.df.where(column == number(at)).select(dim).distinct().limit(2).collect()
            if len(found) != 1:
                raise IndexError(f"{at} marks {'no' if not found else 'more than one'} position")
            return self._point(dim, found[0][0])
        ends = self.df.agg(F.min_by(column, dim).alias("first"), F.max_by(column, dim).alias("last")).first()
        up = ends["first"] is None or ends["first"] <= ends["last"]
        if not self.is_sorted(dim, dim, "ascending" if up else "descending"):
            raise CoordError(f"coordinate {dim!r} is not sorted")
        low, high = number(at.start), number(at.stop)
        condition = F.lit(True)
        if low is not None:
            condition = condition & (column >= low if up else column <= low)
        if high is not None:
            condition = condition & (column < high if up else column > high)
        df = self.df.where(condition)
        edge = df.agg(F.min(dim).alias("a"), F.max(dim).alias("b")).first()
        start, stop = (edge["a"], edge["b"] + 1) if edge["a"] is not None else (0, 0)
        return self[dim, start:stop]

    def set_slice(self, dim: str, start: int, stop: int, value: object) -> LabelledArray:
        """A new array with ``value`` (a number or quantity) where ``start <= position < stop``."""
        inside = (F.col(dim) >= start) & (F.col(dim) < stop)
        return self.map(lambda x: q.where(Quantity(inside, None, None, "bool"), q.quantity(value, self.unit), x))

    def is_sorted(self, name: str, dim: str, order: str = "ascending") -> bool:
        """Whether a coordinate is monotonic along ``dim`` in every slice."""
        now, after = F.col(f"c_{name}"), F.col("_next")
        wrong = now > after if order == "ascending" else now < after
        return with_next(self.df, dim, [d for d in self.dims if d != dim], f"c_{name}").where(wrong).isEmpty()

    def issorted(self, dim: str, order: str = "ascending") -> LabelledArray:
        rest = tuple(d for d in self.dims if d != dim)
        now, after = F.col("value"), F.col("_next")
        fine = F.coalesce(now <= after if order == "ascending" else now >= after, F.lit(True))
        df = with_next(self.df, dim, rest, "value").select(*rest, fine.alias("fine")).groupBy(*rest).agg(F.bool_and("fine").alias("value"))
        return LabelledArray(df, rest, {d: self.sizes[d] for d in rest}, {}, {}, None, "bool")

    def allsorted(self, dim: str, order: str = "ascending") -> bool:
        return bool(self.issorted(dim, order).df.agg(F.bool_and("value")).first()[0])

    def islinspace(self, dim: str) -> bool:
        """Whether steps along ``dim`` are equal but for four units in the last place of the largest value."""
        steps = with_next(self.df, dim, [d for d in self.dims if d != dim], "value").select((F.col("_next") - F.col("value")).alias("s"), F.abs("value").alias("v"))
        r = steps.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("v").alias("v")).first()
        return r["lo"] is None or (r["lo"] != 0 and r["hi"] - r["lo"] <= 4 * np.finfo(float).eps * max(r["v"], 1e-300))

    def sort(self, key: str | Quantity, order: str = "ascending") -> LabelledArray:
        """Sort along the single dim by a coordinate; NaN goes last when ascending; ties keep their order."""
        if self.ndim != 1:
            raise DimensionError("sort needs one dim")
        dim = self.dims[0]
        by = key.value if isinstance(key, Quantity) else F.col(f"c_{key}")
        ordered = [by.asc() if order == "ascending" else by.desc(), F.col(dim).asc()]
        return replace(self, df=renumbered(self.df, dim, ordered), coords=self._without_edges(dim))

    # -- shape --------------------------------------------------------------------------------------------------------

    def fold(self, dim: str, **sizes: int) -> LabelledArray:
        """Split a dim into several, row-major; one size may be -1."""
        known, whole = int(np.prod([n for n in sizes.values() if n != -1])), self.size_of(dim)
        sizes = {d: whole // known if n == -1 else n for d, n in sizes.items()}
        if int(np.prod(list(sizes.values()))) != self.sizes[dim]:
            raise DimensionError(f"{sizes} does not hold {self.sizes[dim]} elements")
        df, step = self.df.withColumnRenamed(dim, "_flat"), self.sizes[dim]
        for d, n in sizes.items():
            step //= n
            df = df.withColumn(d, F.call_function("div", F.col("_flat"), F.lit(step).cast("long")) % n)
        at = self.dims.index(dim)
        swap = lambda dims: tuple(x for d in dims for x in (sizes if d == dim else [d]))
        return replace(self, df=df.drop("_flat"), dims=(*self.dims[:at], *sizes, *self.dims[at + 1 :]), sizes={**{d: s for d, s in self.sizes.items() if d != dim}, **sizes}, coords={k: replace(c, dims=swap(c.dims)) for k, c in self._without_edges(dim).items()}, masks={m: swap(d) for m, d in self.masks.items()})

    def flatten(self, to: str, dims: Iterable[str] | None = None) -> LabelledArray:
        """Merge neighbouring dims into one, row-major."""
        dims = tuple(dims) if dims is not None else self.dims
        at = self.dims.index(dims[0]) if dims else 0
        if self.dims[at : at + len(dims)] != dims:
            raise DimensionError(f"{dims} are not neighbours in {self.dims}")
        flat, size = F.lit(0).cast("long"), 1
        for d in dims:
            flat, size = flat * self.sizes[d] + F.col(d), size * self.sizes[d]
        df = self.df.withColumn("_flat", flat).drop(*dims).withColumnRenamed("_flat", to)
        swap = lambda own: (to,) if set(own) & set(dims) else own
        coords = {k: replace(c, dims=(*(d for d in c.dims if d not in dims), *swap(c.dims)) if set(c.dims) & set(dims) else c.dims) for k, c in self.coords.items() if c.edges is None or not set(c.dims) & set(dims)}
        return replace(self, df=df, dims=(*self.dims[:at], to, *self.dims[at + len(dims) :]), sizes={**{d: s for d, s in self.sizes.items() if d not in dims}, to: size}, coords=coords, masks={m: (*(d for d in own if d not in dims), *swap(own)) if set(own) & set(dims) else own for m, own in self.masks.items()})

    def collapse(self, keep: str) -> DataFrame:
        """One row for each slice along ``keep``: the other positions and the values in order."""
        rest = [d for d in self.dims if d != keep]
        rows = self.df.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(keep, "value"))).alias("v"))
        return rows.select(*rest, F.transform("v", lambda x: x.value).alias("values"))

    def slices(self, dim: str) -> dict[str, LabelledArray]:
        return {f"{dim}:{k}": self[dim, k] for k in range(self.size_of(dim))}

    def midpoints(self, dim: str | None = None) -> LabelledArray:
        dim = dim or (self.dims[0] if self.ndim == 1 else None)
        if dim is None:
            raise DimensionError("say along which dim")
        if self.has_variance:
            raise q.VariancesError("midpoints have no variances")
        after, now = F.col("_next"), F.col("value")
        value = now + F.floor((after - now) / 2) if self.dtype == "datetime" else (now + after) / 2
        near = with_next(self.df, dim, [d for d in self.dims if d != dim], "value")
        kept = near.withColumn("_mid", value).where(F.col(dim) < self.size_of(dim) - 1)
        kept = kept.select(*self.dims, F.col("_mid").alias("value"))
        return LabelledArray(kept, self.dims, {**self.sizes, dim: max(0, self.sizes[dim] - 1)}, {}, {}, self.unit, "datetime" if self.dtype == "datetime" else "float64")

    # -- reductions ---------------------------------------------------------------------------------------------------

    def reduce(self, op: str, dim: str | Iterable[str] | None = None, ddof: int | None = None) -> LabelledArray:
        """Reduce over a dim, several, or all. Masks that depend on a reduced dim are applied, others stay."""
        gone = self.dims if dim is None else (dim,) if isinstance(dim, str) else tuple(dim)
        if not set(gone) <= set(self.dims):
            raise DimensionError(f"no dims {gone} in {self.dims}")
        rest = tuple(d for d in self.dims if d not in gone)
        applied = [m for m, own in self.masks.items() if set(own) & set(gone)]
        keep = fold_left(lambda a, b: a & b, [~F.col(f"m_{m}") for m in applied]) if applied else None
        median = op in ("median", "nanmedian")
        value, variance = reducers.aggregate("nanmax" if median else op, F.col("value"), F.col("variance") if self.has_variance and not median else None, keep, self.dtype, ddof)
        if median and self.has_variance:
            raise q.VariancesError(f"{op} has no rule for variances")
        coords = {n: c for n, c in self.coords.items() if not set(c.dims) & set(gone)}
        masks = {m: own for m, own in self.masks.items() if m not in applied}
        carried = [F.first(f"c_{n}").alias(f"c_{n}") for n, c in coords.items() if c.edges is None] + [F.first(f"m_{m}").alias(f"m_{m}") for m in masks]
        aggregates = [value.alias("value"), *([variance.alias("variance")] if variance is not None else []), *carried]
        df = self.df.groupBy(*rest).agg(*aggregates) if rest else self.df.agg(*aggregates)
        if median:
            df = with_median(df.drop("value"), self.df, rest, op, keep, self.dtype, "value")
        return LabelledArray(df, rest, {d: self.sizes[d] for d in rest}, coords, masks, reducers.result_unit(op, self.unit), reducers.result_dtype(op, self.dtype), variance is not None, self.name)

    def cumsum(self, dim: str | None = None, mode: str = "inclusive") -> LabelledArray:
        """A running sum along ``dim``, or over all elements in row-major order."""
        if self.has_variance:
            raise q.VariancesError("cumsum has no rule for variances")
        order = [dim] if dim else list(self.dims)
        for d in order:
            self.size_of(d)
        rest = [d for d in self.dims if d not in order]
        flat = F.lit(0).cast("long")
        for d in order:
            flat = flat * self.sizes[d] + F.col(d)
        df = self.df.withColumn("_at", flat).withColumn("_chunk", F.call_function("div", F.col("_at"), F.lit(CHUNK).cast("long")))
        zero = F.lit(0).cast("double" if self.dtype.startswith("float") else "long")
        before = Window.partitionBy(*rest).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        ahead = df.groupBy(*rest, "_chunk").agg(F.sum("value").alias("_s")).select(*rest, "_chunk", F.coalesce(F.sum("_s").over(before), zero).alias("_ahead"))  # a row for each chunk
        inside = Window.partitionBy(*rest, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if mode == "inclusive" else -1)
        df = df.withColumn("_own", F.coalesce(F.sum("value").over(inside), zero)).join(ahead, [*rest, "_chunk"])
        total = (F.col("_own") + F.col("_ahead")).cast("double" if self.dtype.startswith("float") else "long")
        return replace(self, df=df)._with(Quantity(total, None, self.unit, self.dtype))

    def reduce_many(self, **ops: str | tuple[str, int]) -> DataFrame:
        """One row with a column for each named reduction over all dims (``("var", 1)`` names its ddof), all but medians in one pass."""
        keep = fold_left(lambda a, b: a & b, [~F.col(f"m_{m}") for m in self.masks]) if self.masks else None
        named = {n: (op, None) if isinstance(op, str) else op for n, op in ops.items()}
        medians = {n: op for n, (op, _) in named.items() if op in ("median", "nanmedian")}
        df = self.df.agg(F.count(F.lit(1)).alias("_rows"), *(reducers.aggregate(op, F.col("value"), None, keep, self.dtype, ddof)[0].alias(n) for n, (op, ddof) in named.items() if n not in medians))
        for n, op in medians.items():
            df = with_median(df, self.df, (), op, keep, self.dtype, n)
        return df.select(*named)


for _name in ("sum", "nansum", "mean", "nanmean", "min", "max", "nanmin", "nanmax", "all", "any", "median", "nanmedian"):
    setattr(LabelledArray, _name, (lambda op: lambda self, dim=None: self.reduce(op, dim))(_name))
for _name in ("floor", "ceil", "round", "sqrt", "exp", "log", "log10", "reciprocal", "nan_to_num"):
    setattr(LabelledArray, _name, (lambda f: lambda self, *args, **options: self.map(f, *args, **options))(getattr(q, _name)))
for _name in ("var", "nanvar", "std", "nanstd"):
    setattr(LabelledArray, _name, (lambda op: lambda self, dim=None, *, ddof: self.reduce(op, dim, ddof))(_name))


def _label(x: object, unit: Unit | None) -> float:
    """A number in the coordinate's unit; a quantity has to be in that very unit."""
    if isinstance(x, tuple):
        x, given = x
        if unit_of(given) != unit:
            raise UnitError(f"the label is in {given}, the coordinate in {unit}")
    return x


def with_next(df: DataFrame, dim: str, rest: Iterable[str], column: str) -> DataFrame:
    """``df`` with ``_next``, the ``column`` of the next position along ``dim``.

    Positions go by chunks, whose first row is seen by the chunk before too, so a long dim is no single task.
    """
    chunk = F.call_function("div", F.col(dim), F.lit(CHUNK).cast("long"))
    seen = F.when((F.col(dim) % CHUNK == 0) & (F.col(dim) > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    w = Window.partitionBy(*rest, "_chunk").orderBy(dim)
    return df.withColumn("_chunk", F.explode(seen)).withColumn("_next", F.lead(column).over(w)).where(F.col("_chunk") == chunk).drop("_chunk")


def renumbered(df: DataFrame, dim: str, order: list[Column] | None = None) -> DataFrame:
    """Positions 0, 1, ... in the given order, found without bringing all rows to one task.

    Rows are range-partitioned and sorted; each partition's rows are counted; the running counts, one number a partition, are
    what a row adds to its place in its own partition.
    """
    order = order or [F.col(dim).asc()]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    placed = checkpointed(placed)  # range bounds are sampled: both uses below have to see the same ones
    ahead = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    ahead = ahead.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_ahead"))  # a row per partition
    return placed.join(F.broadcast(ahead), "_part").withColumn(dim, F.col("_n") + F.col("_ahead")).select(*df.columns)


def with_median(df: DataFrame, values: DataFrame, rest: tuple[str, ...], op: str, keep: Column | None, dtype: str, name: str) -> DataFrame:
    """``df``, a row for each slice of ``rest``, with the exact median of ``values`` as ``name``.

    Distinct values are counted and range-partitioned, so no task gets all of a slice's; the counts of partitions tell which of
    them hold its middle, and only those are counted on.
    """
    value = F.col("value").cast("double")
    rows = values.select(*rest, value.alias("_v")).where((F.lit(True) if keep is None else keep) & F.col("value").isNotNull())
    counts = rows.groupBy(*rest, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if dtype.startswith("float") and op == "nanmedian":
        counts = counts.where(~F.isnan("_v"))
    order = [*rest, "_v"]
    placed = checkpointed(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*rest, "_part").agg(F.sum("_c").alias("_s"), F.max("_v").alias("_last"))  # a row for each partition, and slice in it
    up = Window.partitionBy(*rest).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*rest)
    parts = parts.select(*rest, "_part", "_s", F.coalesce(F.sum("_s").over(up), F.lit(0)).alias("_ahead"), F.sum("_s").over(whole).alias("_n"), F.max("_last").over(whole).alias("_most"))
    low, high = F.call_function("div", F.col("_n") - 1, F.lit(2).cast("long")), F.call_function("div", F.col("_n"), F.lit(2).cast("long"))
    middle = parts.where((F.col("_ahead") <= high) & (F.col("_ahead") + F.col("_s") > low))
    found = placed.join(middle, [*rest, "_part"])
    found = found.withColumn("_upto", F.col("_ahead") + F.sum("_c").over(Window.partitionBy(*rest, "_part").orderBy("_v")))
    found = found.where((F.col("_upto") > low) & (F.col("_upto") - F.col("_c") <= high)).groupBy(*rest).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max("_most").alias("_most"))
    median = F.when(F.isnan("_most"), F.lit(q.NAN)).when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * 0.5 + F.col("_b") * 0.5)
    found = found.select(*(F.col(d).alias(f"_{d}") for d in rest), median.cast(q.SPARK[reducers.result_dtype(op, dtype)]).alias(name))
    on = fold_left(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in rest], F.lit(True))
    empty = F.lit(reducers.identity(op, dtype)).cast(q.SPARK[reducers.result_dtype(op, dtype)])
    return df.join(found, on, "left").withColumn(name, F.coalesce(F.col(name), empty)).drop(*(f"_{d}" for d in rest))


def concat(arrays: list[LabelledArray], dim: str) -> LabelledArray:
    """Append along an existing dim, or stack along a new one; edges have to meet."""
    first = arrays[0]
    if any(a.unit != first.unit or a.dtype != first.dtype for a in arrays):
        raise UnitError("all parts need one unit and dtype")
    if dim not in first.dims:
        stacked = [a.df.withColumn(dim, F.lit(k).cast("long")) for k, a in enumerate(arrays)]
        df = fold_left(DataFrame.unionByName, stacked)
        return replace(first, df=df, dims=(dim, *first.dims), sizes={dim: len(arrays), **first.sizes})
    offset, parts, edges = 0, [], {}
    placed = all(a.sizes[dim] != UNKNOWN for a in arrays)
    for a in arrays:
        parts.append(a.df.withColumn(dim, F.col(dim) + offset) if placed else a.df)
        offset = offset + a.sizes[dim] if placed else UNKNOWN
    for n, c in first.coords.items():
        if c.edges is not None and dim in c.dims:
            joined = c.edges
            for a in arrays[1:]:
                if a.coords[n].edges[0] != joined[-1]:
                    raise BinEdgeError(f"edges of {n!r} do not meet")
                joined = np.concatenate([joined, a.coords[n].edges[1:]])
            edges[n] = replace(c, edges=joined)
    return replace(first, df=fold_left(DataFrame.unionByName, parts), sizes={**first.sizes, dim: offset}, coords={**first.coords, **edges})


def reduce_objects(arrays: list[LabelledArray], op: str) -> LabelledArray:
    """Element-wise reduction across arrays of the same shape."""
    return concat(arrays, "_across").reduce(op, "_across")


def table(df: DataFrame, *, value: Column | None = None, unit: str | Unit | None = "one", variance: Column | None = None, coords: dict[str, tuple[Column, str | Unit | None]] | None = None, masks: dict[str, Column] | None = None, order: list[Column] | None = None, dim: str = "row") -> LabelledArray:
    """An event table as a one-dim array. Positions are numbered by ``order`` where it is given, else not at all: few operators need them, and those refuse."""
    value = F.lit(1.0) if value is None else value
    columns = [F.lit(0).cast("long").alias(dim), value.alias("value"), *([variance.alias("variance")] if variance is not None else []), *(c.alias(f"c_{n}") for n, (c, _) in (coords or {}).items()), *(m.alias(f"m_{n}") for n, m in (masks or {}).items())]
    out = df.select(*columns) if order is None else df.select(*columns, *(o.alias(f"_o{k}") for k, o in enumerate(order)))
    if order is not None:
        out = renumbered(out, dim, [F.col(f"_o{k}").asc() for k in range(len(order))]).drop(*(f"_o{k}" for k in range(len(order))))
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), "string") for f in out.schema.fields}
    size = UNKNOWN if order is None else out.count()  # of a checkpoint
    return LabelledArray(out, (dim,), {dim: size}, {n: Coord((dim,), unit_of(u), kinds[f"c_{n}"]) for n, (_, u) in (coords or {}).items()}, {n: (dim,) for n in masks or {}}, unit_of(unit), kinds["value"], variance is not None)


def from_numpy(spark: SparkSession, dims: Iterable[str], values, variances=None, unit: str | Unit | None = "one", coords: dict[str, tuple[tuple[str, ...], object, str | None]] | None = None, masks: dict | None = None) -> LabelledArray:
    """A dense array from the driver. A coordinate is ``(dims, values, unit)``; one longer than its dim gives bin edges."""
    import pandas as pd

    values, dims = np.asarray(values), tuple(dims)
    if values.ndim != len(dims):
        raise DimensionError(f"{values.ndim} dims of values, {len(dims)} names")
    sizes = dict(zip(dims, values.shape, strict=True))
    at = np.indices(values.shape).reshape(len(dims), -1)
    data = {d: at[k].astype(np.int64) for k, d in enumerate(dims)} | {"value": values.reshape(-1)}
    if variances is not None:
        data["variance"] = np.asarray(variances, dtype=np.float64).reshape(-1)
    known = {}
    for n, (own, c, u) in (coords or {}).items():
        c = np.asarray(c)
        if len(own) == 1 and len(c) == sizes[own[0]] + 1:
            known[n] = Coord(tuple(own), unit_of(u), "float64", c)
            continue
        data[f"c_{n}"] = c[tuple(at[dims.index(d)] for d in own)]
        known[n] = Coord(tuple(own), unit_of(u))
    for n, (own, m) in (masks or {}).items():
        data[f"m_{n}"] = np.asarray(m)[tuple(at[dims.index(d)] for d in own)]
    df = spark.createDataFrame(pd.DataFrame(data))
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), "string") for f in df.schema.fields}
    known = {n: c if c.edges is not None else replace(c, dtype=kinds[f"c_{n}"]) for n, c in known.items()}
    return LabelledArray(df, dims, sizes, known, {n: tuple(own) for n, (own, _) in (masks or {}).items()}, unit_of(unit), kinds["value"], variances is not None)
