"""Binning: histograms, binned events, grouping by label, re-binning, split-apply-combine.

Bins are half-open. Edges and a few labels live on the driver: uniform ones become arithmetic, others a binary tree of comparisons, so the index
of a bin is a plain column and the aggregation combines on the map side before its only shuffle. Results are dense: empty bins
hold identity elements.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce as fold_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.literals import SHORT, last_at_or_below, literal_array
from ..functions.quantity import Quantity
from ..units import COUNTS, Unit, UnitError
from ..plans.shared import checkpointed
from . import reducers
from .array import BinEdgeError, Coord, CoordError, DimensionError, LabelledArray, renumbered

#: Dense results beyond this many cells are refused; they are spread over executors.
MOST_CELLS = 1_000_000_000
#: So many cells may be laid out in one task.
SERIAL_CELLS = 10_000_000
#: More labels than these stay in a frame on the executors.
DRIVER_LABELS = 10_000
#: Labels are broadcast up to so many bytes, joined by shuffle beyond.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Width:
    """Ask for bins of a given width, from the least value on."""

    width: float


def edges_for(array: LabelledArray, name: str, wanted) -> np.ndarray:
    """Edges as given, or for a count of bins or a :class:`Width` those that hold all finite values."""
    if not isinstance(wanted, int | Width):
        edges = np.asarray(wanted)
        if len(edges) < 2 or np.any(np.diff(edges) <= 0):
            raise BinEdgeError("edges have to ascend")
        return edges
    c, x = array.coords[name], F.col(f"c_{name}")
    fine = x.isNotNull() & ~F.isnan(x.cast("double")) if c.dtype.startswith("float") else x.isNotNull()
    r = array.df.where(fine).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    low, high = (0, 1) if r["lo"] is None else (r["lo"], r["hi"])
    whole = not c.dtype.startswith("float")
    stop = high + 1 if whole else float(np.nextafter(high, np.inf))
    if isinstance(wanted, Width):
        edges = np.arange(low, stop + wanted.width, wanted.width)
        return edges if len(edges) > 1 else np.array([low, low + wanted.width])
    return np.linspace(low, stop, wanted + 1)


def bin_index(x: Column, edges: np.ndarray, is_float: bool = True) -> Column:
    """The bin that holds ``x``; null where there is none (outside, NaN, null)."""
    edges = np.asarray(edges)
    values, n = edges.tolist(), len(edges) - 1
    low, high = values[0], values[-1]
    inside = (x >= low) & (x < high)
    if is_float:
        inside = inside & ~F.isnan(x)
    step = (float(high) - float(low)) / n
    if n > 1 and np.array_equal(edges[:-1].astype(np.float64), float(low) + np.arange(n) * step):  # the very edges, computed
        edge = lambda k: F.when(k == n, F.lit(float(high))).otherwise(F.lit(float(low)) + k * F.lit(step))
        guess = F.greatest(F.least(F.floor((x.cast("double") - float(low)) * (n / (float(high) - float(low)))), F.lit(n - 1)), F.lit(0)).cast("long")
        index = F.when(x < edge(guess), guess - 1).when(x >= edge(guess + 1), guess + 1).otherwise(guess)
    else:
        index = last_at_or_below(x, values[:-1])
    return F.when(inside, index)


def label_table(spark: SparkSession, labels: list, kind: str, label: str, place: str) -> DataFrame:
    """Labels and their places as a frame; to be broadcast if they are few and short by their own measure."""
    rows = pa.table({label: pa.array(labels), place: pa.array(range(len(labels)), pa.int64())})
    table = spark.createDataFrame(rows).select(F.col(label).cast(kind).alias(label), place).where(~F.isnan(label) if kind in ("double", "float") else F.lit(True)) if labels else spark.createDataFrame([], f"{label} {kind}, {place} long")
    return F.broadcast(table) if rows.nbytes <= BROADCAST_BYTES else table


def with_labels(df: DataFrame, dim: str, labels: list, column: str) -> DataFrame:
    """``df`` with the label of each row's place along ``dim``."""
    if len(labels) <= SHORT or all(type(v) in (int, float) for v in labels):
        return df.withColumn(column, F.get(literal_array(labels), F.col(dim).cast("int")))
    kind = "string" if isinstance(labels[0], str) else df.sparkSession.createDataFrame([(labels[0],)], ["v"]).dtypes[0][1]
    return df.join(label_table(df.sparkSession, labels, kind, column, dim), dim, "left").select(*df.columns, column)


def dense_grid(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    cells = int(np.prod(list(sizes.values()))) if sizes else 1
    if cells > MOST_CELLS:
        raise DimensionError(f"{cells} cells are too many for a dense result")
    df, step = spark.range(cells), cells
    for d, n in sizes.items():
        step //= n
        df = df.withColumn(d, F.call_function("div", F.col("id"), F.lit(step).cast("long")) % n)
    return df.drop("id")


@dataclass(frozen=True)
class Binned:
    """Events in bins: event rows with a bin index for each dim; edges or labels of the bins on the driver."""

    events: LabelledArray
    dims: tuple[str, ...]
    sizes: dict[str, int]
    coords: dict[str, Coord]
    masks: dict[str, DataFrame]

    @property
    def unit(self) -> Unit | None:
        return self.events.unit

    def _labelled(self, c: Coord) -> bool:
        return c.labels is not None or len(c.edges) == self.sizes.get(c.dims[0])

    def _dense(self, aggregates: list[Column], fill: dict[str, object]) -> DataFrame:
        df = self.events.df
        found = df.groupBy(*self.dims).agg(*aggregates) if self.dims else df.agg(*aggregates)
        if not self.dims:
            return found
        grid = dense_grid(df.sparkSession, self.sizes)
        joined = grid.join(found, list(self.dims), "left")
        return joined.select(*self.dims, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()))

    def reduce(self, op: str) -> LabelledArray:
        """Reduce the events of each bin; event masks are applied, empty bins get the identity element."""
        e = self.events
        keep = fold_left(lambda a, b: a & b, [~F.col(f"m_{m}") for m in e.masks]) if e.masks else None
        value, variance = reducers.aggregate(op, F.col("value"), F.col("variance") if e.has_variance else None, keep, e.dtype)
        out = reducers.result_dtype(op, e.dtype)
        fill = {"value": reducers.identity(op, e.dtype)}
        if variance is not None:
            fill["variance"] = reducers.identity("mean" if op.endswith("mean") else "sum", "float64")
        df = self._dense([value.alias("value"), *([variance.alias("variance")] if variance is not None else [])], fill)
        coords = {n: c for n, c in self.coords.items() if set(c.dims) <= set(self.dims)}
        for n, c in coords.items():
            if c.labels is not None:
                df = df.join(c.labels.select(F.col("_place").alias(c.dims[0]), F.col("_label").alias(f"c_{n}")), c.dims[0], "left")
            elif c.edges is not None and len(c.edges) == self.sizes[c.dims[0]]:  # labels
                df = with_labels(df, c.dims[0], c.edges.tolist(), f"c_{n}")
        coords = {n: replace(c, edges=None, labels=None) if self._labelled(c) else c for n, c in coords.items()}
        out_array = LabelledArray(df, self.dims, self.sizes, coords, {}, reducers.result_unit(op, e.unit), out, variance is not None)
        for m, mask in self.masks.items():
            out_array = replace(out_array, df=out_array.df.join(mask, [d for d in mask.columns if d in self.dims], "left").withColumn(f"m_{m}", F.coalesce(F.col(f"m_{m}"), F.lit(False))), masks={**out_array.masks, m: tuple(d for d in mask.columns if d in self.dims)})
        return out_array

    def reduce_many(self, **ops: str) -> DataFrame:
        """Bin dims and a column for each named reduction (``size`` counts events), all in one pass over the events."""
        e = self.events
        keep = fold_left(lambda a, b: a & b, [~F.col(f"m_{m}") for m in e.masks]) if e.masks else None
        found = {n: F.count(F.lit(1)) if op == "size" else reducers.aggregate(op, F.col("value"), None, keep, e.dtype)[0] for n, op in ops.items()}
        return self._dense([c.alias(n) for n, c in found.items()], {n: 0 if op == "size" else reducers.identity(op, e.dtype) for n, op in ops.items()})

    def size(self) -> LabelledArray:
        df = self._dense([F.count(F.lit(1)).alias("value")], {"value": 0})
        return LabelledArray(df, self.dims, self.sizes, {n: c for n, c in self.coords.items() if not self._labelled(c)}, {}, None, "int64")

    def hist(self, **edges) -> LabelledArray:
        return hist(self, **edges) if edges else self.reduce("sum")

    def concat(self, dim: str | Iterable[str] | None = None) -> Binned:
        """Let go of bin dims: contents of their bins come together."""
        gone = self.dims if dim is None else (dim,) if isinstance(dim, str) else tuple(dim)
        rest = tuple(d for d in self.dims if d not in gone)
        return replace(self, events=replace(self.events, df=self.events.df.drop(*gone)), dims=rest, sizes={d: self.sizes[d] for d in rest}, coords={n: c for n, c in self.coords.items() if not set(c.dims) & set(gone)})

    def concatenate(self, other: Binned) -> Binned:
        """Bin by bin, the events of both."""
        if self.sizes != other.sizes or self.unit != other.unit:
            raise DimensionError("bins differ")
        return replace(self, events=replace(self.events, df=self.events.df.unionByName(other.events.df)))

    def __getitem__(self, key) -> Binned:
        """``b["x", low:high]`` or ``b["x", value]``: events by a coordinate of their own."""
        name, at = key
        x = F.col(f"c_{name}")
        if isinstance(at, slice):
            condition = F.lit(True)
            if at.start is not None:
                condition = condition & (x >= at.start)
            if at.stop is not None:
                condition = condition & (x < at.stop)
        else:
            condition = x == at
        if self.events.coords[name].dtype.startswith("float"):
            condition = condition & ~F.isnan(x)
        return replace(self, events=replace(self.events, df=self.events.df.where(condition)))

    def map(self, function, *args) -> Binned:
        """An element-wise function on every event; a dense array over the bins reaches all events of its bin."""
        others = [a for a in args if isinstance(a, LabelledArray)]
        if not others:
            return replace(self, events=replace(self.events._with(function(self.events.quantity, *args)), df=self._keep_dims(function(self.events.quantity, *args))))
        dense = others[0]
        if dense.has_variance:
            raise reducers.VariancesError("variances of a dense operand would be broadcast to events")
        joined = self.events.df.join(dense.df.select(*dense.dims, F.col("value").alias("_dense")), list(dense.dims), "left")
        found = function(self.events.quantity, Quantity(F.col("_dense"), None, dense.unit, dense.dtype))
        df = joined.withColumns({"value": found.value, **({"variance": found.variance} if found.variance is not None else {})}).drop("_dense")
        return replace(self, events=replace(self.events, df=df, unit=found.unit, dtype=found.dtype))

    def _keep_dims(self, found: Quantity) -> DataFrame:
        df = self.events.df.withColumn("_found", found.value)
        if found.variance is not None:
            df = df.withColumn("_spread", found.variance)
        df = df.drop("value", "variance").withColumnRenamed("_found", "value")
        return df.withColumnRenamed("_spread", "variance") if found.variance is not None else df

    def assign_coords(self, **coords: Quantity) -> Binned:
        return replace(self, events=self.events.assign_coords(coords))

    def assign_masks(self, **masks: Quantity) -> Binned:
        return replace(self, events=self.events.assign_masks(masks))

    def drop_coords(self, *names: str) -> Binned:
        return replace(self, events=self.events.drop_coords(*names))

    def drop_masks(self, *names: str) -> Binned:
        return replace(self, events=self.events.drop_masks(*names))

    def mask_bins(self, name: str, mask: DataFrame) -> Binned:
        """A mask on bins: a frame of bin dims and ``m_<name>``."""
        return replace(self, masks={**self.masks, name: mask})

    def constituents(self) -> DataFrame:
        """``begin`` and ``end`` of each bin in events laid out bin by bin."""
        if int(np.prod(list(self.sizes.values()))) > SERIAL_CELLS:
            raise DimensionError(f"more than {SERIAL_CELLS} cells are too many to be laid out one after another")
        counts = self.size().df
        w = Window.orderBy(*self.dims).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("end", F.sum("value").over(w)).select(*self.dims, (F.col("end") - F.col("value")).alias("begin"), "end")  # bounded by SERIAL_CELLS

    def bins_like(self, fill: LabelledArray) -> Binned:
        return self.map(lambda _, y: y, fill)


for _name in ("sum", "nansum", "mean", "nanmean", "min", "max", "nanmin", "nanmax", "all", "any"):
    setattr(Binned, _name, (lambda op: lambda self: self.reduce(op))(_name))


def _events(x: LabelledArray | Binned) -> tuple[LabelledArray, tuple[str, ...], dict[str, int], dict[str, Coord]]:
    if isinstance(x, Binned):
        return x.events, x.dims, x.sizes, x.coords
    return x, (), {}, {}


def bin(x: LabelledArray | Binned, /, dim: str | Iterable[str] | None = None, **edges) -> Binned:
    """Events into bins by their coordinates; those in no bin are dropped, bins of ``x`` stay unless ``dim`` or an edge replaces them."""
    events, dims, sizes, coords = _events(x)
    gone = () if dim is None else (dim,) if isinstance(dim, str) else tuple(dim)
    df = events.df.drop(*gone)
    if not isinstance(x, Binned):
        df = df.drop(*events.dims)
    dims, known = tuple(d for d in dims if d not in gone and d not in edges), dict(coords)
    sizes = {d: sizes[d] for d in dims}
    for name, wanted in edges.items():
        e = edges_for(replace(events, df=df), name, wanted)
        index = bin_index(F.col(f"c_{name}"), e, events.coords[name].dtype.startswith("float"))
        df = df.drop(name).withColumn(name, index).where(F.col(name).isNotNull())
        dims, sizes[name], known[name] = (*dims, name), len(e) - 1, Coord((name,), events.coords[name].unit, events.coords[name].dtype, e)
    known = {n: c for n, c in known.items() if set(c.dims) <= set(dims)}
    return Binned(replace(events, df=df, dims=(), sizes={}), dims, sizes, known, {})


def hist(x: LabelledArray | Binned, /, dim: str | Iterable[str] | None = None, **edges) -> LabelledArray:
    """An N-dim histogram: sums of values (and variances) in each bin. Masked events count nothing."""
    return bin(x, dim, **edges).reduce("sum")


def nanhist(x: LabelledArray | Binned, /, dim: str | Iterable[str] | None = None, **edges) -> LabelledArray:
    return bin(x, dim, **edges).reduce("nansum")


def group(x: LabelledArray | Binned, /, **labels) -> Binned:
    """Events by exact labels; ``None`` asks for all labels there are, sorted. Events without a label, and NaN, are dropped."""
    events, dims, sizes, coords = _events(x)
    df = events.df if isinstance(x, Binned) else events.df.drop(*events.dims)
    known = dict(coords)
    for name, wanted in labels.items():
        column, is_float = F.col(f"c_{name}"), events.coords[name].dtype.startswith("float")
        if wanted is None:
            fine = column.isNotNull() & ~F.isnan(column) if is_float else column.isNotNull()
            distinct = df.where(fine).select(column.alias("_label")).distinct()
            count = distinct.count()
            if count > MOST_CELLS:
                raise DimensionError(f"over {MOST_CELLS} labels of {name!r} are too many for a dense result: aggregate the frame by its column")
            wanted = sorted(distinct.toArrow().column(0).to_pylist()) if count <= DRIVER_LABELS else None
        coord, labels = Coord((name,), events.coords[name].unit, events.coords[name].dtype), None
        if wanted is None:
            labels = renumbered(distinct.withColumn("_place", F.lit(0).cast("long")), "_place", [F.col("_label").asc()])
            table = labels.withColumnRenamed("_place", name)
        else:
            wanted = list(wanted)
            count = len(wanted)
            if len(set(wanted)) < count:
                raise CoordError(f"labels of {name!r} repeat")
            table = label_table(df.sparkSession, wanted, dict(df.dtypes)[f"c_{name}"], "_label", name)
        df = df.drop(name).join(table, column == F.col("_label")).drop("_label")
        dims, sizes, known = (*(d for d in dims if d != name), name), {**sizes, name: count}, {**known, name: replace(coord, edges=None if wanted is None else np.array(wanted), labels=labels)}
    return Binned(replace(events, df=df, dims=(), sizes={}), dims, sizes, known, {})


@dataclass(frozen=True)
class GroupBy:
    """Split-apply-combine: rows with equal keys, or with keys in the same bin, are reduced together."""

    array: LabelledArray
    key: str
    edges: np.ndarray | None = None

    def reduce(self, op: str) -> LabelledArray:
        a = self.array
        if self.edges is not None:
            return bin(a, **{self.key: self.edges}).reduce(op)
        rest = tuple(d for d in a.dims if d not in a.coords[self.key].dims)
        keep = fold_left(lambda x, y: x & y, [~F.col(f"m_{m}") for m in a.masks]) if a.masks else None
        value, variance = reducers.aggregate(op, F.col("value"), F.col("variance") if a.has_variance else None, keep, a.dtype)
        found = a.df.groupBy(F.col(f"c_{self.key}"), *rest).agg(value.alias("value"), *([variance.alias("variance")] if variance is not None else []))
        found = checkpointed(found)  # of the size of the result; used for the keys and for the values
        keys = renumbered(found.select(F.col(f"c_{self.key}").alias("_key")).distinct().withColumn(self.key, F.lit(0).cast("long")), self.key, [F.col("_key").asc()])
        count = keys.count()
        if count > MOST_CELLS:
            raise DimensionError(f"{count} groups are too many for a dense result")
        df = found.join(keys, F.col(f"c_{self.key}").eqNullSafe(F.col("_key"))).drop("_key")
        return LabelledArray(df, (self.key, *rest), {self.key: count, **{d: a.sizes[d] for d in rest}}, {self.key: replace(a.coords[self.key], dims=(self.key,))}, {}, reducers.result_unit(op, a.unit), reducers.result_dtype(op, a.dtype), variance is not None)

    def concat(self) -> Binned:
        return bin(self.array, **{self.key: self.edges}) if self.edges is not None else group(self.array, **{self.key: None})


for _name in ("sum", "nansum", "mean", "nanmean", "min", "max", "nanmin", "nanmax", "all", "any"):
    setattr(GroupBy, _name, (lambda op: lambda self: self.reduce(op))(_name))


def groupby(array: LabelledArray, key: str, bins=None) -> GroupBy:
    c = array.coords.get(key)
    if c is None or c.edges is not None:
        raise CoordError(f"no key {key!r}")
    if len(c.dims) != 1:
        raise DimensionError("a key has one dim")
    return GroupBy(array, key, None if bins is None else edges_for(array, key, bins))


def rebin(array: LabelledArray, /, **edges) -> LabelledArray:
    """Redistribute a histogram over other edges in proportion to the overlap; masks along the dim empty their bins."""
    out = array
    for dim, wanted in edges.items():
        c = out.coords.get(dim)
        if c is None or c.edges is None:
            raise BinEdgeError(f"{dim!r} has no edges")
        old, new = np.asarray(c.edges, dtype=np.float64), np.asarray(wanted if not isinstance(wanted, int) else np.linspace(c.edges[0], c.edges[-1], wanted + 1), dtype=np.float64)
        up = old[0] <= old[-1]
        if (new[0] <= new[-1]) != up:
            raise BinEdgeError("old and new edges run in opposite directions")
        a, b = (old, new) if up else (-old, -new)
        pairs = []
        for k in range(len(a) - 1):
            first, last = max(0, int(np.searchsorted(b, a[k], side="right")) - 1), int(np.searchsorted(b, a[k + 1], side="left"))
            for j in range(first, min(last, len(b) - 1)):
                overlap = min(a[k + 1], b[j + 1]) - max(a[k], b[j])
                if overlap > 0:
                    pairs.append((k, j, float(overlap / (a[k + 1] - a[k]))))
        spark = out.df.sparkSession
        share = spark.createDataFrame(pairs or [(-1, -1, 0.0)], "_old long, _new long, _share double")  # at most old plus new bins
        applied = [m for m, own in out.masks.items() if dim in own]
        keep = fold_left(lambda x, y: x & y, [~F.col(f"m_{m}") for m in applied]) if applied else F.lit(True)
        rest = [d for d in out.dims if d != dim]
        value = F.when(keep, F.col("value").cast("double")).otherwise(0.0) * F.col("_share")
        aggregates = [F.sum(value).alias("value"), *([F.sum(F.when(keep, F.col("variance")).otherwise(0.0) * F.col("_share")).alias("variance")] if out.has_variance else [])]
        found = out.df.join(F.broadcast(share), F.col(dim) == F.col("_old")).groupBy(F.col("_new").alias(dim), *rest).agg(*aggregates)
        sizes = {**out.sizes, dim: len(new) - 1}
        grid = dense_grid(spark, {d: sizes[d] for d in out.dims}).join(found, list(out.dims), "left")
        df = grid.select(*out.dims, F.coalesce("value", F.lit(0.0)).alias("value"), *([F.coalesce("variance", F.lit(0.0)).alias("variance")] if out.has_variance else []))
        coords = {n: x for n, x in out.coords.items() if x.edges is not None and n != dim and dim not in x.dims}
        out = LabelledArray(df, out.dims, sizes, {**coords, dim: replace(c, edges=new)}, {}, out.unit, "float64", out.has_variance, out.name)
    return out


def combine_bins(x: Binned, dim: str, by: str, labels: list) -> Binned:
    """Re-group existing bins of ``dim`` by a label for each bin."""
    if len(labels) != x.sizes[dim]:
        raise DimensionError("a label for each bin")
    wanted = sorted(set(labels))
    spark = x.events.df.sparkSession
    table = spark.createDataFrame([(k, wanted.index(v)) for k, v in enumerate(labels)], f"{dim} long, {by} long")
    df = x.events.df.join(F.broadcast(table), dim).drop(dim)
    dims = tuple(by if d == dim else d for d in x.dims)
    return Binned(replace(x.events, df=df), dims, {**{d: n for d, n in x.sizes.items() if d != dim}, by: len(wanted)}, {**{n: c for n, c in x.coords.items() if dim not in c.dims}, by: Coord((by,), None, "string" if isinstance(wanted[0], str) else "int64", np.array(wanted))}, {})


def hide_masked(array: LabelledArray, dim: str) -> LabelledArray:
    """Without the positions that a mask along ``dim`` hides."""
    applied = [m for m, own in array.masks.items() if own == (dim,)]
    return array[fold_left(lambda a, b: a & b, [~F.col(f"m_{m}") for m in applied])].drop_masks(*applied) if applied else array


def merge_equal_adjacent(array: LabelledArray) -> LabelledArray:
    """Neighbouring bins with equal values become one."""
    (dim,) = array.dims
    c = array.coords[dim]
    w = Window.orderBy(dim)
    islands = array.df.withColumn("_new", F.coalesce((~F.col("value").eqNullSafe(F.lag("value").over(w))).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w) - 1)
    merged = islands.groupBy("_run").agg(F.min(dim).alias("_first"), F.min_by("value", dim).alias("value"))
    firsts = [r["_first"] for r in merged.select("_first").orderBy("_first").collect()]  # no more than there were edges on the driver
    if array.df.isEmpty():
        return array
    firsts[0] = 0
    edges = np.append(np.asarray(c.edges)[firsts], c.edges[-1])
    df = merged.select(F.col("_run").cast("long").alias(dim), "value")
    return replace(array, df=df, sizes={dim: len(firsts)}, coords={dim: replace(c, edges=edges)}, masks={})


def _widths(array: LabelledArray, dim: str) -> tuple[Column, Unit]:
    c = array.coords.get(dim)
    if c is None or c.edges is None:
        raise BinEdgeError(f"{dim!r} has no edges")
    return F.get(literal_array(np.abs(np.diff(c.edges))), F.col(dim).cast("int")), c.unit


def counts_to_density(array: LabelledArray, dim: str) -> LabelledArray:
    width, unit = _widths(array, dim)
    if array.unit.powers.get("counts") and array.unit != COUNTS:
        raise UnitError(f"{array.unit} is a density already")
    return array.map(lambda x: x / Quantity(width, None, unit)) if array.unit == COUNTS else array


def density_to_counts(array: LabelledArray, dim: str) -> LabelledArray:
    width, unit = _widths(array, dim)
    return array.map(lambda x: x * Quantity(width, None, unit))


for _function in (bin, hist, nanhist, group, groupby, rebin):
    setattr(LabelledArray, _function.__name__, _function)
for _function in (bin, nanhist, group):
    setattr(Binned, _function.__name__, _function)
