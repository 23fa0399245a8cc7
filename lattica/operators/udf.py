"""User functions and what needs whole series: fits, interpolation, integrals, filters, peaks.

Functions along one dim run per slice (the other dims are the groups) in Arrow batches; a slice has to fit into a task. Functions
of neighbourhoods (filters) go by chunks of a dim; integrals by trapezoids and peaks are windows on the JVM, by chunks too.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Generator, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.quantity import Quantity, VariancesError
from ..units import ONE, Unit, UnitError
from .array import CHUNK, BinEdgeError, CoordError, DimensionError, LabelledArray, with_next


#: Slices of up to so many points are fitted in one task.
FIT_ROWS = 1 << 17


def elemwise_func(function: Callable[..., object], unit_func: Callable[..., Unit | None] | None = None, dtype: str = "float64") -> Callable[..., Quantity]:
    """Lift a numeric function (of numpy arrays) to quantities; without ``unit_func`` all have to be dimensionless."""

    @pandas_udf("double" if dtype.startswith("float") else "long")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(function(*(s.to_numpy(dtype=np.float64) for s in series)))

    def apply(*xs: Quantity) -> Quantity:
        if any(x.variance is not None for x in xs):
            raise VariancesError("user functions have no rule for variances")
        unit = unit_func(*(x.unit for x in xs)) if unit_func else ONE
        if unit_func is None and any(x.unit != ONE for x in xs):
            raise UnitError("without unit_func operands have to be dimensionless")
        return Quantity(run(*(x.value.cast("double") for x in xs)), None, unit, dtype)

    return apply


def per_slice(array: LabelledArray, dim: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` on each slice along ``dim``, sorted by position; returns rows of ``schema`` beside the other dims."""
    rest = [d for d in array.dims if d != dim]
    kinds = ", ".join(f"{d} long" for d in rest)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = function(rows.sort_values(dim).reset_index(drop=True))
        for k, d in enumerate(rest):
            found.insert(k, d, rows[d].iloc[0])
        return found

    return array.df.groupBy(*rest).applyInPandas(run, f"{kinds}, {schema}" if rest else schema)


def wrap1d(function: Callable[..., np.ndarray]) -> Callable[..., LabelledArray]:
    """Lift a function of a one-dim numpy array to arrays: ``f(array, dim, **options)`` maps it over all other dims."""

    def apply(array: LabelledArray, dim: str, **options) -> LabelledArray:
        if array.has_variance:
            raise VariancesError("functions along a dim have no rule for variances")
        if any(dim in own for own in array.masks.values()):
            raise DimensionError("masks along the dim are not taken")

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({dim: rows[dim], "value": function(rows["value"].to_numpy(dtype=np.float64), **options)})

        found = per_slice(array, dim, run, f"{dim} long, value double")
        joined = found.join(array.df.drop("value"), list(array.dims))
        return replace(array, df=joined.select(*array.df.columns), dtype="float64")

    return apply


def windowed1d(function: Callable[[np.ndarray], np.ndarray], left: int, right: int) -> Callable[[LabelledArray, str], LabelledArray]:
    """Lift a function of neighbourhoods to arrays: values with ``left`` more before and ``right`` more after them become those values' results; edges are mirrored.

    A dim goes by chunks, each with the neighbours that its first and last positions need.
    """
    if min(left, right) < 0:
        raise ValueError("the origin is outside the footprint")

    def apply(array: LabelledArray, dim: str) -> LabelledArray:
        if array.has_variance:
            raise VariancesError("functions along a dim have no rule for variances")
        if any(dim in own for own in array.masks.values()):
            raise DimensionError("masks along the dim are not taken")
        n, chunk, reach = array.size_of(dim), CHUNK, max(left, right)
        rest = [d for d in array.dims if d != dim]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(dim)
            start = int(rows["_chunk"].iloc[0]) * chunk
            stop, first, last = min(n, start + chunk), int(rows[dim].iloc[0]), int(rows[dim].iloc[-1])
            if (first, last, len(rows)) != (max(0, start - reach), min(n, stop + reach) - 1, last - first + 1):
                raise DimensionError(f"positions along {dim!r} are missing or repeated")
            before, after = left if first == 0 else 0, right if last == n - 1 else 0
            padded = np.pad(rows["value"].to_numpy(dtype=np.float64), (before, after), mode="symmetric")
            at = start - left - (first - before)
            return pd.DataFrame({**{d: rows[d].iloc[0] for d in rest}, dim: np.arange(start, stop), "value": function(padded[at : at + stop - start + left + right])})

        of = lambda x: F.call_function("div", x, F.lit(chunk).cast("long"))
        seen = F.sequence(of(F.greatest(F.col(dim) - reach, F.lit(0))), of(F.least(F.col(dim) + reach, F.lit(n - 1))))
        dealt = array.df.select(*array.dims, "value", F.explode(seen).alias("_chunk"))
        found = dealt.groupBy(*rest, "_chunk").applyInPandas(run, ", ".join([*(f"{d} long" for d in rest), f"{dim} long, value double"]))
        joined = found.join(array.df.drop("value"), list(array.dims))
        return replace(array, df=joined.select(*array.df.columns), dtype="float64")

    return apply


def _points(array: LabelledArray, dim: str) -> str:
    if dim not in array.coords or array.coords[dim].edges is not None:
        raise CoordError(f"{dim!r} needs a coordinate with a value for each point")
    return f"c_{dim}"


def trapezoid(array: LabelledArray, dim: str) -> LabelledArray:
    """The integral along ``dim`` by trapezoids, on the JVM and by chunks."""
    x = _points(array, dim)
    array.size_of(dim)
    rest = tuple(d for d in array.dims if d != dim)
    near = with_next(array.df.select(*array.dims, F.struct(F.col(x).alias("x"), F.col("value").alias("y")).alias("_at")), dim, rest, "_at")
    area = (F.col("_next.x") - F.col("_at.x")) * (F.col("_next.y") + F.col("_at.y")) / 2
    df = near.select(*rest, area.alias("a")).groupBy(*rest).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("value"))
    return LabelledArray(df, rest, {d: array.sizes[d] for d in rest}, {}, {}, array.unit * array.coords[dim].unit)


def _simpson(y: np.ndarray, x: np.ndarray) -> float:
    """Parabolas through pairs of intervals; with an odd number of intervals the last one takes the parabola of the last three points."""
    n = len(y)
    if n < 3:
        return float(np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2))

    def piece(k: int, a: float, b: float) -> float:
        c = np.polynomial.polynomial.polyfit(x[k : k + 3] - x[k], y[k : k + 3], 2)
        anti = lambda t: c[0] * t + c[1] * t**2 / 2 + c[2] * t**3 / 3
        return anti(b - x[k]) - anti(a - x[k])

    total = sum(piece(k, x[k], x[k + 2]) for k in range(0, n - 2 - (n - 1) % 2, 2))
    return float(total + (piece(n - 3, x[n - 2], x[n - 1]) if (n - 1) % 2 else 0.0))


def simpson(array: LabelledArray, dim: str) -> LabelledArray:
    x = _points(array, dim)
    rest = tuple(d for d in array.dims if d != dim)
    run = lambda rows: pd.DataFrame({"value": [_simpson(rows["value"].to_numpy(float), rows[x].to_numpy(float))]})
    return LabelledArray(per_slice(array, dim, run, "value double"), rest, {d: array.sizes[d] for d in rest}, {}, {}, array.unit * array.coords[dim].unit)


def interp1d(array: LabelledArray, dim: str, at: np.ndarray, kind: str = "linear", fill_value: float = float("nan")) -> LabelledArray:
    """Values at other points along ``dim``: linear, previous, next or nearest; masked points are left out, outside is filled."""
    c = _points(array, dim)
    at = np.asarray(at, dtype=np.float64)
    hidden = [f"m_{m}" for m, own in array.masks.items() if dim in own]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[~rows[hidden].any(axis=1)] if hidden else rows
        x, y = rows[c].to_numpy(float), rows["value"].to_numpy(float)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        if len(x) == 0:
            found = np.full(len(at), fill_value)
        elif kind == "linear":
            found = np.interp(at, x, y)
        else:
            k = np.searchsorted(x, at, side="right") - 1 if kind == "previous" else np.searchsorted(x, at, side="left") if kind == "next" else np.searchsorted((x[:-1] + x[1:]) / 2, at, side="left")
            found = y[np.clip(k, 0, len(y) - 1)]
        found = np.where((at >= x[0]) & (at <= x[-1]), found, fill_value) if len(x) else found
        return pd.DataFrame({dim: np.arange(len(at)), "value": found, c: at})

    if kind not in ("linear", "previous", "next", "nearest"):
        raise ValueError(f"no such kind: {kind}")
    df = per_slice(array, dim, run, f"{dim} long, value double, {c} double")
    return LabelledArray(df, array.dims, {**array.sizes, dim: len(at)}, {dim: array.coords[dim]}, {}, array.unit)


#: What a point adds up to for a fit: the sum of squared residuals, the Jacobian's products with itself and with the residuals.
Sums = tuple[float, np.ndarray, np.ndarray]


def fit_sums(f: Callable[..., np.ndarray], x: list[np.ndarray], y: np.ndarray, weights: np.ndarray, p: np.ndarray) -> Sums:
    residual = lambda q: (y - f(*x, *q)) * weights
    r, steps = residual(p), 6e-6 * np.maximum(1.0, np.abs(p)) * np.eye(len(p))
    jacobian = np.stack([(residual(p + s) - residual(p - s)) / (2 * s.sum()) for s in steps], axis=1)  # central: rounding is small against such steps
    return float(r @ r), jacobian.T @ jacobian, jacobian.T @ r


def levenberg_marquardt(start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> Generator[np.ndarray, Sums, tuple[np.ndarray, np.ndarray, float]]:
    """Yields the parameters whose :data:`Sums` it needs next; returns parameters, the Jacobian's product with itself and the squared residuals.

    A step that promises less than the sums of squares can tell apart is taken without that proof, at most three in a row.
    """
    p, damp, blind = np.clip(start.astype(float), low, high), 1e-3, 0
    square, a, g = yield p
    for _ in range(rounds):
        moved = False
        for _ in range(30):
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
            trial = np.clip(p + step, low, high)
            d = trial - p
            faint = blind < 3 and 0 <= -(2 * g @ d + d @ a @ d) <= 1e-13 * square
            found = yield trial
            if found[0] < square or (faint and found[0] <= square * (1 + 1e-12)):
                small = np.abs(d).max() <= 1e-10 * np.maximum(1.0, np.abs(p)).max()
                p, (square, a, g), damp, moved, blind = trial, found, max(damp / 5, 1e-12), True, blind + 1 if faint else 0
                break
            if faint:
                break
            damp *= 4
        if not moved or small or blind == 3:
            break
    return p, a, square


def least_squares(f: Callable[..., np.ndarray], x: list[np.ndarray], y: np.ndarray, start: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt within bounds: parameters and their covariance (scaled by the residuals)."""
    steps = levenberg_marquardt(start, low, high, rounds)
    p = next(steps)
    while True:
        try:
            p = steps.send(fit_sums(f, x, y, weights, p))
        except StopIteration as done:
            return _fitted(*done.value, len(y))


def _fitted(p: np.ndarray, a: np.ndarray, square: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    return p, np.linalg.pinv(a) * (square / max(points - len(p), 1))


def curve_fit(coords: list[str], f: Callable[..., np.ndarray], array: LabelledArray, *, p0: dict[str, float] | None = None, bounds: dict[str, tuple[float, float]] | None = None, reduce_dims: list[str] | None = None):
    """Fit ``f(*coords, **parameters)`` over ``reduce_dims`` for every slice of the other dims.

    Returns a frame: the other dims, then each parameter and its variance. Masked points and NaN are left out, variances of the
    array are weights; parameters start at ``p0`` or 1. ``f`` is called with some points of a slice at a time: a slice of up to
    ``FIT_ROWS`` points is fitted in one task, a larger one by a pass of all tasks over its points for each step, of which the
    driver gets the sums.
    """
    names = [n for n in inspect.signature(f).parameters if n not in coords]
    if any(c not in array.coords or array.coords[c].edges is not None for c in coords):
        raise BinEdgeError("fits need a coordinate value for each point")
    gone = list(reduce_dims) if reduce_dims is not None else sorted({d for c in coords for d in array.coords[c].dims})
    rest = [d for d in array.dims if d not in gone]
    start = np.array([(p0 or {}).get(n, 1.0) for n in names])
    low = np.array([(bounds or {}).get(n, (-np.inf, np.inf))[0] for n in names])
    high = np.array([(bounds or {}).get(n, (-np.inf, np.inf))[1] for n in names])
    hidden = [f"m_{m}" for m in array.masks]
    weighted = array.has_variance
    df = array.df.select(*rest, *(f"c_{c}" for c in coords), F.col("value").cast("double").alias("value"), *(["variance"] if weighted else []), *hidden)

    def points(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        used = rows[~rows[hidden].any(axis=1)] if hidden else rows
        used = used[np.isfinite(used["value"])]
        weights = 1 / np.sqrt(used["variance"].to_numpy(float)) if weighted else np.ones(len(used))
        return [used[f"c_{c}"].to_numpy(float) for c in coords], used["value"].to_numpy(float), weights

    def row(p: np.ndarray, cov: np.ndarray) -> dict[str, float]:
        return {k: float(v) for i, n in enumerate(names) for k, v in ((n, p[i]), (f"{n}_variance", cov[i, i]))}

    none = np.full(len(names), np.nan), np.full((len(names), len(names)), np.nan)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, weights = points(rows)
        found = none if len(y) < len(names) else least_squares(f, x, y, start, weights, low, high)
        return pd.DataFrame({**{d: [rows[d].iloc[0]] for d in rest}, **{k: [v] for k, v in row(*found).items()}})

    schema = ", ".join([*(f"{d} long" for d in rest), *(f"{n} double, {n}_variance double" for n in names)])
    large = [tuple(r) for r in df.groupBy(*rest).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FIT_ROWS).select(*rest).collect()]  # at most a slice for each FIT_ROWS rows
    if not large:
        return df.groupBy(*rest).applyInPandas(run, schema)
    spark, k = df.sparkSession, len(names)
    key = F.broadcast(spark.createDataFrame([(*x, i) for i, x in enumerate(large)], ", ".join([*(f"{d} long" for d in rest), "_slice int"])))
    theirs = df.join(key, rest) if rest else df.withColumn("_slice", F.lit(0))

    def summed(at: dict[int, np.ndarray]) -> dict[int, tuple[int, Sums]]:
        """The number of points and the sums of each slice at its parameters, in one pass."""

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = {}
            for batch in batches:
                of = batch["_slice"].to_numpy()
                for i in np.unique(of).tolist():
                    x, y, weights = points(batch[of == i])
                    square, a, g = fit_sums(f, x, y, weights, at[i])
                    totals[i] = totals.get(i, 0.0) + np.array([len(y), square, *a.ravel(), *g])
            yield pd.DataFrame([[i, *x] for i, x in totals.items()], columns=["_slice", *sums])

        sums = [f"s{j}" for j in range(2 + k * k + k)]
        found = theirs.where(F.col("_slice").isin(list(at))).mapInPandas(some, ", ".join(["_slice int", *(f"{c} double" for c in sums)]))
        rows = found.groupBy("_slice").agg(*(F.sum(c).alias(c) for c in sums)).collect()  # of a pass, a row for each slice
        got = {r[0]: np.array(r[1:], dtype=float) for r in rows}
        return {i: (int(v[0]), (float(v[1]), v[2 : 2 + k * k].reshape(k, k), v[2 + k * k :])) for i, v in got.items()}

    fits = {i: levenberg_marquardt(start, low, high) for i in range(len(large))}
    at, ended = {i: next(x) for i, x in fits.items()}, {}
    while at:
        for i, (n, sums) in summed(at).items():
            try:
                if n < k:
                    raise StopIteration
                at[i] = fits[i].send(sums)
            except StopIteration as done:
                ended[i] = none if n < k else _fitted(*done.value, n)
                del at[i]
    fitted = spark.createDataFrame([(*large[i], *row(*x).values()) for i, x in sorted(ended.items())], schema)
    return fitted.unionByName(df.join(key, rest, "left_anti").groupBy(*rest).applyInPandas(run, schema)) if rest else fitted


# -- filters ------------------------------------------------------------------------------------------------------------------


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if order == 1:
        return g * x / sigma**2
    if order == 2:
        return g * (x**2 / sigma**4 - 1 / sigma**2)
    return g


def gaussian_filter(array: LabelledArray, sigma: float | dict[str, float], order: int = 0) -> LabelledArray:
    """Smoothing along every dim given, edges mirrored."""
    out = array
    for dim, s in (sigma if isinstance(sigma, dict) else dict.fromkeys(array.dims, sigma)).items():
        kernel = gaussian_kernel(s, order)
        radius = len(kernel) // 2
        out = windowed1d(lambda v, kernel=kernel: np.convolve(v, kernel[::-1], mode="valid"), radius, radius)(out, dim)
    return out


def footprint_filter(function: Callable[[np.ndarray], np.ndarray]) -> Callable[..., LabelledArray]:
    """A filter from a function of windows (the last axis); ``f(array, size=3 or {dim: size}, origin=0)`` along one dim."""

    def apply(array: LabelledArray, *, size: int | dict[str, int], origin: int = 0, **options) -> LabelledArray:
        sizes = size if isinstance(size, dict) else dict.fromkeys(array.dims, size)
        sizes = {d: n for d, n in sizes.items() if n > 1}
        if len(sizes) > 1 and not getattr(function, "separable", False):
            raise DimensionError("this footprint has one dim")
        out = array
        for dim, n in sizes.items():
            left = n // 2 + origin
            out = windowed1d(lambda v, n=n: function(np.lib.stride_tricks.sliding_window_view(v, n), **options), left, n - 1 - left)(out, dim)
        return out

    return apply


def _of(separable: bool):
    def mark(f):
        f.separable = separable
        return f

    return mark


@_of(True)
def _most(w: np.ndarray) -> np.ndarray:
    return w.max(axis=-1)


@_of(True)
def _least(w: np.ndarray) -> np.ndarray:
    return w.min(axis=-1)


maximum_filter, minimum_filter = footprint_filter(_most), footprint_filter(_least)
median_filter = footprint_filter(lambda w: np.sort(w, axis=-1)[..., w.shape[-1] // 2])
percentile_filter = footprint_filter(lambda w, percentile: np.sort(w, axis=-1)[..., int(np.clip((percentile if percentile >= 0 else 100 + percentile) / 100 * w.shape[-1], 0, w.shape[-1] - 1))])
rank_filter = footprint_filter(lambda w, rank: np.sort(w, axis=-1)[..., rank])


def generic_filter(array: LabelledArray, function: Callable[[np.ndarray], float], *, size: int | dict[str, int], origin: int = 0) -> LabelledArray:
    return footprint_filter(lambda w: np.apply_along_axis(function, -1, w))(array, size=size, origin=origin)


def butter(step: float, order: int, critical: float) -> np.ndarray:
    """Second-order sections of a digital low-pass Butterworth filter for points ``step`` apart; ``critical`` in 1 over their unit."""
    warped = 4 * np.tan(np.pi * critical * step)  # bilinear transform at rate 2
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order)) * warped
    digital = (4 + poles) / (4 - poles)
    sections, pending = [], sorted(digital[digital.imag >= -1e-12], key=lambda p: abs(p.imag))
    for p in pending:
        if abs(p.imag) < 1e-12:
            a = [1.0, -p.real, 0.0]
            b = np.array([1.0, 1.0, 0.0])
        else:
            a = [1.0, -2 * p.real, abs(p) ** 2]
            b = np.array([1.0, 2.0, 1.0])
        sections.append(np.concatenate([b * (sum(a) / b.sum()), a]))
    return np.array(sections)


def _run_sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    for b0, b1, b2, _, a1, a2 in sos:
        # Start as if the first value had always been there.
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * x[0]
        z1 = (b1 - a1 * gain) * x[0] + z2
        y = np.empty_like(x)
        for k, v in enumerate(x):
            y[k] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[k] + z2, b2 * v - a2 * y[k]
        x = y
    return x


def sosfiltfilt(array: LabelledArray, dim: str, sos: np.ndarray) -> LabelledArray:
    """Forward and backward, so without a shift; ends are extended by their odd reflection."""

    def run(v: np.ndarray) -> np.ndarray:
        pad = min(3 * (2 * len(sos) + 1), len(v) - 1)
        padded = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]]) if pad > 0 else v
        out = _run_sections(sos, _run_sections(sos, padded)[::-1])[::-1]
        return out[pad : len(out) - pad] if pad > 0 else out

    return wrap1d(run)(array, dim)


def find_peaks(array: LabelledArray, *, height: float | None = None, threshold: float | None = None):
    """Positions of local maxima; the middle of a plateau. ``threshold``: least drop to both neighbours.

    The ends of runs of equal values are found and met by their neighbours in chunks; a run that begins before its chunk gets the
    last end before it by a row for each chunk, so neither a long dim nor a long plateau is a single task.
    """
    (dim,) = array.dims
    array.size_of(dim)
    chunk = F.call_function("div", F.col("_b"), F.lit(CHUNK).cast("long"))
    ends = with_next(array.df.select(dim, "value"), dim, [], "value").where(~F.col("value").eqNullSafe(F.col("_next")))
    ends = ends.select(F.col(dim).alias("_b"), "value", F.col("_next").alias("_r")).withColumn("_chunk", chunk)
    lasts = ends.groupBy("_chunk").agg(F.max(F.struct("_b", F.col("value").alias("_l"))).alias("_last"))
    lasts = lasts.select(F.lead("_chunk").over(Window.orderBy("_chunk")).alias("_chunk"), "_last")  # a row for each chunk
    inside = F.lag(F.struct("_b", F.col("value").alias("_l"))).over(Window.partitionBy("_chunk").orderBy("_b"))
    before = F.coalesce("_inside", "_last")
    runs = ends.withColumn("_inside", inside).join(lasts, "_chunk", "left").select((before["_b"] + 1).alias("_a"), "_b", "value", before["_l"].alias("l"), F.col("_r").alias("r"))
    found = runs.select(F.floor((F.col("_a") + F.col("_b")) / 2).alias(dim), "value", "l", "r", (F.col("_b") > F.col("_a")).alias("flat")).where("value > l AND value > r")
    if height is not None:
        found = found.where(F.col("value") >= height)
    if threshold is not None:
        found = found.where((F.least(F.col("value") - F.col("l"), F.col("value") - F.col("r")) >= threshold) & ~F.col("flat"))
    return found.select(dim, "value")

