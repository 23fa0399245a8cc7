"""Edge cases that the SQL of the catalogue does not reach."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.functions import creation, spatial
from lattica.functions import quantity as q
from lattica.functions.quantity import DTypeError, Quantity, VariancesError
from lattica.operators import udf
from lattica.operators.array import BinEdgeError, Coord, CoordError, DimensionError, LabelledArray, concat, from_numpy, table
from lattica.operators.binning import bin, bin_index, group, groupby, hist, rebin
from lattica.operators.coords import Graph, transform_coords
from lattica.operators.groups import DataGroup, Dataset, merge
from lattica.operators.lookup import asof_join, lookup
from lattica.sources import io
from lattica.streaming.hist import stream_hist
from lattica.units import ONE, Unit, UnitError

NAN, INF = float("nan"), float("inf")


def values(a, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in (a.df.orderBy(*a.dims) if a.dims else a.df).select(*(names or ("value",))).collect()]


def events(spark, xs, vs=None):
    df = spark.createDataFrame([(float(x), float(v)) for x, v in zip(xs, vs or [1.0] * len(xs), strict=True)], "x double, v double")
    return table(df, value=F.col("v"), unit="counts", coords={"x": (F.col("x"), "m")})


def test_half_open_bins_and_odd_values(spark):
    a = events(spark, [0, 1, 2, -1, 3, NAN, INF, -INF])
    assert values(hist(a, x=[0.0, 1.0, 2.0])) == [1.0, 1.0]
    assert values(hist(a, x=[0.0, 1.0, 1.5, 3.0])) == [1.0, 1.0, 1.0]


def test_uniform_edges_decide_not_arithmetic(spark):
    edges = np.linspace(0, 1, 11)
    a = events(spark, edges.tolist())
    assert values(hist(a, x=edges)) == [1.0] * 10


def test_automatic_edges_hold_extremes(spark):
    a = events(spark, [1e300, -1e300, 0.0])
    assert sum(values(hist(a, x=3))) == 3.0


def test_empty_input(spark):
    a = events(spark, [])
    assert values(hist(a, x=[0.0, 1.0])) == [0.0]
    assert math.isnan(values(bin(a, x=[0.0, 1.0]).mean())[0])
    assert values(bin(a, x=[0.0, 1.0]).max()) == [-1.7976931348623157e308]


def test_nan_is_contagious_unless_skipped(spark):
    a = from_numpy(spark, ["x"], [1.0, NAN, 3.0])
    assert math.isnan(values(a.min())[0]) and math.isnan(values(a.max())[0]) and math.isnan(values(a.sum())[0])
    assert values(a.nanmin()) == [1.0] and values(a.nanmax()) == [3.0] and values(a.nansum()) == [4.0] and values(a.nanmean()) == [2.0]


def test_groupby_nan_key_is_last_but_group_drops_it(spark):
    a = events(spark, [2, NAN, 1, NAN], [1, 2, 3, 4])
    g = groupby(a, "x").sum()
    assert values(g) == [3.0, 1.0, 6.0]
    assert values(group(a, x=None).sum()) == [3.0, 1.0]


def test_masks(spark):
    a = from_numpy(spark, ["x", "y"], np.arange(6.0).reshape(2, 3), masks={"m": (("x",), [True, False])})
    assert values(a.sum("x")) == [3.0, 4.0, 5.0]
    s = a.sum("y")
    assert values(s) == [3.0, 12.0] and s.masks == {"m": ("x",)}


def test_groupby_means_in_each_slice(spark):
    a = from_numpy(spark, ["run", "det"], [[10.0, 4.0, 7.0, 2.0], [0.0, 8.0, 6.0, 1.0]], [[1.0, 3.0, 2.0, 8.0], [5.0, 1.0, 9.0, 4.0]], "m", {"bank": (("det",), [8.0, 5.0, 8.0, 8.0], "m")})
    g = groupby(a, "bank").mean().transpose(["run", "bank"])
    assert values(g, "value", "variance") == [(4.0, 3.0), (19 / 3, 11 / 9), (8.0, 1.0), (7 / 3, 2.0)]


def test_units_and_variances_are_checked(spark):
    a = from_numpy(spark, ["x"], [1.0, 2.0], [1.0, 1.0], unit="m")
    with pytest.raises(UnitError):
        a + from_numpy(spark, ["x"], [1.0, 2.0], unit="s")
    with pytest.raises(UnitError):
        a.map(q.exp)
    with pytest.raises(VariancesError):
        from_numpy(spark, ["y", "x"], [[1.0, 2.0]], unit="m") + a
    with pytest.raises(DimensionError):
        a["y", 0]
    with pytest.raises(DTypeError):
        a.map(q.logical_not)


def test_coordinates_have_to_match(spark):
    a = from_numpy(spark, ["x"], [1.0, 2.0], coords={"x": (("x",), [0.0, 1.0], "m")})
    b = from_numpy(spark, ["x"], [1.0, 2.0], coords={"x": (("x",), [0.0, 2.0], "m")})
    with pytest.raises(CoordError):
        a + b
    assert "x" not in (a + b.set_aligned("x", False)).coords
    assert values(a + a) == [2.0, 4.0]


def test_division(spark):
    x = spark.createDataFrame([(1, 0), (-1, 0), (0, 0), (-7, 2), (7, -2)], "a long, b long")
    a, b = Quantity(F.col("a"), None, ONE, "int64"), Quantity(F.col("b"), None, ONE, "int64")
    rows = x.select((a / b).value, (a // b).value, (a % b).value).collect()
    assert rows[0][0] == INF and rows[1][0] == -INF and math.isnan(rows[2][0])
    assert [r[1] for r in rows] == [0, 0, 0, -4, -4]
    assert [r[2] for r in rows] == [0, 0, 0, 1, -1]


def test_log_and_roots(spark):
    a = from_numpy(spark, ["x"], [-1.0, 0.0, 1.0])
    assert [str(v) for v in values(a.map(q.log))] == ["nan", "-inf", "0.0"]
    assert math.isnan(values(a.map(q.sqrt))[0])


def test_slicing_edges(spark):
    a = LabelledArray(from_numpy(spark, ["x"], [1.0, 2.0, 3.0]).df, ("x",), {"x": 3}, {"x": Coord(("x",), Unit("m"), "float64", np.array([0.0, 1.0, 2.0, 3.0]))}, {})
    assert values(a["x", 1.5]) == [2.0]
    assert a["x", 0.5:1.5].coords["x"].edges.tolist() == [0.0, 1.0, 2.0]
    assert a["x", 1:3].coords["x"].edges.tolist() == [1.0, 2.0, 3.0]
    assert a["x", -1].df.first()["value"] == 3.0
    with pytest.raises(IndexError):
        a["x", 3]
    with pytest.raises(BinEdgeError):
        concat([a, a], "x")


def test_sort_puts_nan_last(spark):
    a = from_numpy(spark, ["x"], [1.0, 2.0, 3.0, 4.0], coords={"k": (("x",), [NAN, 2.0, 1.0, 2.0], None)})
    assert values(a.sort("k")) == [3.0, 2.0, 4.0, 1.0]


def test_rebin(spark):
    h = LabelledArray(from_numpy(spark, ["x"], [2.0, 4.0], [2.0, 4.0], "counts").df, ("x",), {"x": 2}, {"x": Coord(("x",), Unit("m"), "float64", np.array([0.0, 2.0, 4.0]))}, {}, Unit("counts"), "float64", True)
    assert values(rebin(h, x=[0.0, 1.0, 3.0, 4.0]), "value", "variance") == [(1.0, 1.0), (3.0, 3.0), (2.0, 2.0)]


def test_lookup(spark):
    a = from_numpy(spark, ["x"], [10.0, 20.0], coords={"x": (("x",), [1.0, 3.0], "m")})
    points = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (9.0,), (NAN,)], "p double")
    at = lambda mode: [r[0] for r in points.select(lookup(a, "x", mode)[Quantity(F.col("p"), None, Unit("m"))].value).collect()]
    assert math.isnan(at("previous")[0]) and at("previous")[1:] == [10.0, 10.0, 20.0, 20.0]
    assert at("nearest") == [10.0, 10.0, 20.0, 20.0, 20.0]


def test_asof_join_across_chunks(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.integers(0, 50, 300).astype(float), "g": rng.integers(0, 3, 300)})
    right = pd.DataFrame({"k": rng.integers(5, 40, 20).astype(float), "g": rng.integers(0, 3, 20), "v": rng.random(20)})
    found = asof_join(spark.createDataFrame(left.reset_index()), spark.createDataFrame(right), "k", "k", "v", ["g"], chunks=7).toPandas().set_index("index")["v_asof"]
    for i, row in left.iterrows():
        there = right[(right.g == row.g) & (right.k <= row.k)]
        want = there[there.k == there.k.max()].v.max() if len(there) else NAN
        assert (found[i] == want) or (math.isnan(found[i]) and math.isnan(want))


def test_graph(spark):
    a = events(spark, [1.0, 2.0])
    graph = {"double": lambda x: x * 2.0, "name": "double", ("p", "m"): lambda name: {"p": name + name, "m": name - name}}
    out = transform_coords(a, ["p"], graph)
    assert out.df.orderBy("c_p").first()["c_p"] == 4.0 and not out.coords["x"].aligned
    with pytest.raises(KeyError):
        transform_coords(a, ["nothing"], graph)
    with pytest.raises(ValueError):
        Graph({"a": "b", "b": "a"}).plan(set(), ["a"])


def test_rotation_and_inverse(spark):
    v = spatial.vector(1, 2, 3)
    r = spatial.rotations_from_rotvecs(spatial.vector(0.3, -0.2, 0.5))
    back = spatial.rotated(spatial.rotation_inverse(r), spatial.rotated(r, v))
    m = spatial.linear_transform([[2, 1, 0], [0, 3, 1], [1, 0, 1]])
    same = spatial.transformed(spatial.inverse(m), spatial.transformed(m, v))
    row = spark.range(1).select(back.alias("a"), same.alias("b"), spatial.rotation_as_rotvec(r).alias("c")).first()
    assert tuple(row["a"]) == pytest.approx((1, 2, 3)) and tuple(row["b"]) == pytest.approx((1, 2, 3)) and tuple(row["c"]) == pytest.approx((0.3, -0.2, 0.5))


def test_series_functions(spark):
    x = np.linspace(0, 2 * np.pi, 41)
    a = from_numpy(spark, ["t"], np.sin(x) + 2, coords={"t": (("t",), x, "s")})
    assert values(udf.simpson(a, "t"))[0] == pytest.approx(4 * np.pi, rel=1e-6)
    assert values(udf.interp1d(a, "t", np.array([x[3], 99.0])))[0] == pytest.approx(np.sin(x[3]) + 2)
    smooth = values(udf.gaussian_filter(a, 1.0))
    assert np.ptp(smooth) < np.ptp(np.sin(x))
    flat = udf.sosfiltfilt(from_numpy(spark, ["t"], np.full(30, 5.0)), "t", udf.butter(1.0, 4, 0.1))
    assert values(flat) == pytest.approx([5.0] * 30)
    assert values(udf.median_filter(from_numpy(spark, ["t"], [1.0, 9.0, 2.0, 3.0]), size=3)) == [1.0, 2.0, 3.0, 3.0]
    fit = udf.curve_fit(["t"], lambda t, a, b: a * np.sin(t) + b, a).first()
    assert fit["a"] == pytest.approx(1) and fit["b"] == pytest.approx(2) and fit["a_variance"] < 1e-6


def test_creation_and_groups(spark):
    a = creation.ones(spark, {"x": 2, "y": 3}, unit="m")
    assert values(a.sum("y")) == [3.0, 3.0]
    g = DataGroup({"a": a, "n": 5})
    assert values(g.sum("y")["a"]) == [3.0, 3.0] and g.sum("y")["n"] == 5
    d = Dataset({"a": a})
    assert set(merge(d, Dataset({"b": a})).items) == {"a", "b"}
    with pytest.raises(ValueError):
        merge(d, Dataset({"a": a + a}))
    assert values(creation.geomspace(spark, "x", 1.0, 8.0, 4)) == pytest.approx([1, 2, 4, 8])


def test_io(spark, tmp_path):
    a = from_numpy(spark, ["x"], [1.0, 2.0], [0.5, 0.5], "m", {"x": (("x",), [0.0, 1.0, 2.0], "s")})
    io.save(a, str(tmp_path / "a"))
    assert io.load(spark, str(tmp_path / "a")).identical(a)
    assert io.deserialize(spark, io.serialize(a)).identical(a)
    assert io.from_dict(spark, io.to_dict(a)).identical(a)
    (tmp_path / "t.csv").write_text("a [m],b [s],c\n1,2,3\n4,5,6\n")
    d = io.load_csv(spark, str(tmp_path / "t.csv"), data_columns=["a"])
    assert d["a"].unit == Unit("m") and d["a"].coords["b"].unit == Unit("s") and d["a"].coords["c"].unit is None
    assert io.parse_bracket_header("x []") == ("x", ONE)


def test_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1.5D AS x UNION ALL SELECT timestamp'2024-01-01 00:20:00', 1.7D UNION ALL SELECT timestamp'2024-01-01 05:00:00', 0.5D").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, x double").parquet(str(tmp_path / "in"))
    run = stream_hist(source, "ts", F.col("x"), np.array([0.0, 1.0, 2.0])).writeStream.format("memory").queryName("binned").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["bin"], r["value"]) for r in spark.table("binned").collect()) == [(0, 1.0), (1, 2.0)]


def test_rows_without_order_do_not_meet(spark):
    frame = spark.range(50).select((F.col("id") * 2.0).alias("v"))
    a, b = table(frame, value=F.col("v")), table(frame, value=F.col("v"))
    with pytest.raises(DimensionError):
        a + b
    for call in (lambda: a["row", 3], lambda: a["row", 1:4], lambda: a.midpoints(), lambda: a.fold("row", x=5, y=-1), lambda: a.cumsum()):
        with pytest.raises(DimensionError):
            call()
    assert (a + a).df.agg(F.count(F.lit(1)), F.sum("value")).first() == (50, 4 * sum(range(50)))
    assert (a * 3.0).df.count() == 50 and concat([a, b], "row").df.count() == 100


def test_ordered_tables_have_sizes(spark):
    frame = spark.range(60).select((59 - F.col("id")).alias("k"), F.col("id").alias("v"))
    a = table(frame, value=F.col("v").cast("double"), coords={"k": (F.col("k"), None)}, order=[F.col("k")])
    assert a.sizes == {"row": 60} and a["row", 3].df.first()["value"] == 56 and a["row", -1].df.first()["value"] == 0
    assert a["row", 2:5].sizes == {"row": 3} and a.midpoints().df.count() == 59 and a.fold("row", x=6, y=10).sizes == {"x": 6, "y": 10}
    both = concat([a, a], "row")
    assert both.sizes == {"row": 120} and both.df.select("row").distinct().count() == 120 and (a + a * 1.0).df.count() == 60


def test_csv_items_add_row_by_row(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a [m],b [m],c [s]\n" + "\n".join(f"{k},{100 * k},{k}" for k in range(50)) + "\n")
    d = io.load_csv(spark, str(tmp_path / "t.csv"), data_columns=["a", "b"])
    found = d["a"] + d["b"]
    assert found.sizes == {"row": 50} and sorted(x.value for x in found.df.collect()) == [101 * k for k in range(50)]
    assert list(found.coords) == ["c"] and d["a"].unit == found.unit


def test_labels_beyond_the_bound_are_an_error(spark, monkeypatch):
    from lattica.operators import binning

    a = table(spark.range(30), coords={"k": (F.col("id"), None)})
    assert binning.group(a, k=None).size().df.count() == 30
    monkeypatch.setattr(binning, "MOST_CELLS", 20)
    with pytest.raises(DimensionError):
        binning.group(a, k=None)
    monkeypatch.setattr(binning, "MOST_CELLS", 1000)
    monkeypatch.setattr(binning, "BROADCAST_BYTES", 0)  # labels by shuffle
    names = table(spark.range(200).select(F.concat(F.lit("n"), "id").alias("n")), coords={"n": (F.col("n"), None)})
    assert {(x.c_n, x.value) for x in binning.group(names, n=None).size().df.join(binning.group(names, n=None).sum().df.select("n", "c_n"), "n").collect()} == {(f"n{k}", 1) for k in range(200)}


def test_many_edges_against_searchsorted(spark):
    rng = np.random.default_rng(6)
    for edges in (np.unique(np.round(rng.lognormal(0, 2, 3000), 4)), np.linspace(-1, 3, 70_001), np.arange(0, 5000, 3), np.array([0.0, 0.1, 0.2, 0.3])):
        x = np.concatenate([rng.choice(edges, 500), rng.uniform(edges[0] - 1, edges[-1] + 1, 2000), [edges[0], edges[-1], np.nan, np.inf, -np.inf], np.nextafter(edges[:300], -np.inf)]).astype(float)
        got = [r.b for r in spark.createDataFrame(pd.DataFrame({"x": x})).coalesce(1).select(bin_index(F.col("x"), edges).alias("b")).collect()]
        want = np.searchsorted(edges, x, side="right") - 1
        assert got == [int(w) if edges[0] <= v < edges[-1] else None for v, w in zip(x, want, strict=True)]


def test_dataset_items(spark):
    a = from_numpy(spark, ["x"], np.arange(3.0))
    d = Dataset({"a": a})
    d["b"] = a * 2.0
    d.update({"c": a})
    assert list(d) == ["a", "b", "c"] and d.pop("c") is a and len(d) == 2
    del d["b"]
    with pytest.raises(DimensionError):
        d["wrong"] = from_numpy(spark, ["y"], np.arange(2.0))
    d.clear()
    assert len(d) == 0


def test_reversed_operators(spark):
    a = from_numpy(spark, ["x"], np.array([1.0, 2.0, 4.0]))
    assert values(7.0 // a) == [7.0, 3.0, 1.0] and values(7.0 % a) == [0.0, 1.0, 3.0] and values(3.0 ** a) == [3.0, 9.0, 81.0]


def test_series_across_chunks(spark, monkeypatch):
    from lattica.operators import array

    monkeypatch.setattr(array, "CHUNK", 7)
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (3, 40)).astype(float)
    a = from_numpy(spark, ["g", "x"], x)
    assert np.array_equal(a.cumsum("x").to_numpy(), x.cumsum(1)) and np.array_equal(a.cumsum().to_numpy(), x.cumsum().reshape(3, 40))
    assert np.array_equal(a.cumsum("x", "exclusive").to_numpy(), x.cumsum(1) - x)
    assert np.array_equal(a.midpoints("x").to_numpy(), (x[:, 1:] + x[:, :-1]) / 2)
    for last in (6, 7, 20, 41):  # a fall at and inside chunk borders
        y = np.arange(42.0)
        y[last] = y[last - 1] - 0.5
        assert not from_numpy(spark, ["x"], y).allsorted("x") and not from_numpy(spark, ["x"], y).islinspace("x")
    assert from_numpy(spark, ["x"], np.arange(42.0)).allsorted("x") and from_numpy(spark, ["x"], np.arange(42.0)).islinspace("x")
    assert from_numpy(spark, ["x"], np.arange(42)).cumsum().to_numpy().tolist() == np.arange(42).cumsum().tolist()


def test_many_labels_stay_off_the_driver(spark, monkeypatch):
    from lattica.operators import binning

    rows = [(f"n{k % 50:02d}", float(k % 2), float(k)) for k in range(200)] + [(None, 0.0, 1.0)]
    a = table(spark.createDataFrame(rows, "n string, s double, v double"), value=F.col("v"), coords={"n": (F.col("n"), None), "s": (F.col("s"), None)})
    few = group(a, n=None)
    want = few.sum().df.orderBy("n").collect()
    monkeypatch.setattr(binning, "DRIVER_LABELS", 40)
    many = group(a, n=None)
    assert many.coords["n"].edges is None and many.sizes == few.sizes == {"n": 50}
    assert [r.asDict() for r in many.sum().df.orderBy("n").collect()] == [r.asDict() for r in want]
    assert values(many.size()) == [4] * 50 and values(many["s", 5.0:].size()) == [0] * 50
    both = group(many, s=None)
    assert both.sum().df.count() == 100 and both.concat("s").sum().df.agg(F.sum("value")).first()[0] == sum(range(200))
    floats = table(spark.createDataFrame([(float(k % 60),) for k in range(90)] + [(NAN,)], "x double"), coords={"x": (F.col("x"), None)})
    assert values(group(floats, x=None).size()) == [2] * 30 + [1] * 30


def test_peaks_across_chunks(spark, monkeypatch):
    from lattica.operators import array

    monkeypatch.setattr(array, "CHUNK", 5)
    monkeypatch.setattr(udf, "CHUNK", 5)

    def peaks(v):
        found, k = [], 0
        while k < len(v):
            j = k
            while j + 1 < len(v) and v[j + 1] == v[k]:
                j += 1
            if 0 < k and j + 1 < len(v) and v[k - 1] < v[k] > v[j + 1]:
                found.append((k + j) // 2)
            k = j + 1
        return found

    rng = np.random.default_rng(5)
    for v in (rng.integers(0, 4, 60), np.repeat([0, 3, 1, 2, 0], [4, 23, 1, 12, 3]), np.repeat([2, 1, 2], [11, 3, 9]), np.zeros(12), np.repeat(rng.integers(0, 3, 20), rng.integers(1, 14, 20))):
        a = from_numpy(spark, ["x"], v.astype(float))
        found = udf.find_peaks(a)
        assert sorted(r.x for r in found.collect()) == peaks(v.tolist())
    tasks = udf.find_peaks(from_numpy(spark, ["x"], np.sin(np.arange(500.0))), height=0.5)._jdf.queryExecution().executedPlan().toString()
    assert tasks.count("SinglePartition") == 1  # for the rows of chunks


def test_trapezoid_across_chunks(spark, monkeypatch):
    from lattica.operators import array

    monkeypatch.setattr(array, "CHUNK", 6)
    rng = np.random.default_rng(7)
    x, y = np.cumsum(rng.uniform(0.1, 2, 31)), rng.uniform(-3, 9, (2, 31))
    a = from_numpy(spark, ["g", "t"], y, coords={"t": (("t",), x, "s")})
    found = udf.trapezoid(a, "t")
    assert values(found) == pytest.approx(np.trapezoid(y, x, axis=1).tolist())
    assert values(udf.trapezoid(from_numpy(spark, ["t"], [4.0], coords={"t": (("t",), [1.0], "s")}), "t")) == [0.0]
    one = udf.trapezoid(a["g", 0], "t").df._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in one  # not one window over the whole dim


def test_filters_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(udf, "CHUNK", 8)
    rng = np.random.default_rng(8)
    y = rng.uniform(-3, 9, (2, 37))

    def windows(size, origin):
        left = size // 2 + origin
        return np.lib.stride_tricks.sliding_window_view(np.pad(y, ((0, 0), (left, size - 1 - left)), mode="symmetric"), size, axis=1)

    a = from_numpy(spark, ["g", "x"], y)
    for size, origin in ((3, 0), (4, 1), (21, -2), (90, 0)):  # up to beyond a chunk, and beyond the dim
        w = windows(size, origin)
        assert np.array_equal(udf.maximum_filter(a, size={"x": size}, origin=origin).to_numpy(), w.max(-1))
        assert np.array_equal(udf.median_filter(a, size={"x": size}, origin=origin).to_numpy(), np.sort(w, -1)[..., size // 2])
    kernel = udf.gaussian_kernel(3.0)
    want = [np.convolve(np.pad(v, len(kernel) // 2, mode="symmetric"), kernel[::-1], mode="valid") for v in y]
    assert np.allclose(udf.gaussian_filter(a, {"x": 3.0}).to_numpy(), want)

    def counted(v):
        assert len(v) <= 8 + 2
        return v[1:-1]

    assert np.array_equal(udf.windowed1d(counted, 1, 1)(a, "x").to_numpy(), y)


def test_fits_of_large_slices(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 3, 400)
    y = np.stack([2.5 * np.exp(-0.7 * x) + 0.4, 1.5 * np.exp(-1.2 * x) + 3.0]) + rng.normal(0, 0.02, (2, 400))
    y[0, 5] = NAN
    a = from_numpy(spark, ["g", "x"], y, variances=rng.uniform(0.5, 2, y.shape), coords={"x": (("x",), x, "s")}, masks={"m": (("x",), np.arange(400) % 17 == 0)})
    f = lambda x, a, b, c: a * np.exp(-b * x) + c
    fit = lambda: [r.asDict() for r in udf.curve_fit(["x"], f, a).orderBy("g").collect()]
    want = fit()
    monkeypatch.setattr(udf, "FIT_ROWS", 100)
    monkeypatch.setattr(udf, "least_squares", None)  # no slice as a whole
    found = fit()
    for n in ("a", "b", "c", "a_variance", "b_variance", "c_variance"):
        assert [r[n] for r in found] == pytest.approx([r[n] for r in want], rel=1e-6)
    one = udf.curve_fit(["x"], f, a["g", 0]).collect()
    assert len(one) == 1 and one[0]["b"] == pytest.approx(want[0]["b"], rel=1e-6)
    empty = udf.curve_fit(["x"], f, a.map(lambda v: q.where(Quantity(F.col("g") == 0, None, None, "bool"), v, Quantity(F.lit(NAN), F.lit(1.0), v.unit)))).orderBy("g").collect()
    assert empty[0]["a"] == pytest.approx(want[0]["a"], rel=1e-6) and math.isnan(empty[1]["a"])


def test_medians_by_partitions(spark):
    rng = np.random.default_rng(10)
    for n in (1, 2, 7, 1000, 1001):
        y = np.round(rng.normal(0, 3, (3, n)), 1)
        a = from_numpy(spark, ["g", "x"], y)
        assert values(a.median("x")) == pytest.approx(np.median(y, axis=1).tolist(), abs=1e-12)
        assert values(a.median()) == pytest.approx([np.median(y)], abs=1e-12)
    y[0, 3] = y[1, 4] = NAN
    y[2] = NAN
    a = from_numpy(spark, ["g", "x"], y, masks={"m": (("x",), np.arange(1001) == 3)})
    low, mid, none = values(a.median("x"))
    assert low == pytest.approx(np.median(np.delete(y[0], 3))) and math.isnan(mid) and math.isnan(none)
    low, mid, none = values(a.nanmedian("x"))
    assert mid == pytest.approx(np.nanmedian(np.delete(y[1], 3))) and math.isnan(none)
    whole = a.reduce_many(total="nansum", median="nanmedian", odd="median")
    assert whole.columns == ["total", "median", "odd"]
    assert whole.first()["median"] == pytest.approx(np.nanmedian(np.delete(y, 3, axis=1))) and math.isnan(whole.first()["odd"])
    assert values(from_numpy(spark, ["x"], [INF, -INF, 5.0]).median()) == [5.0] and values(from_numpy(spark, ["x"], np.array([1, 2])).median()) == [1.5]
    assert math.isnan(values(table(spark.range(0), value=F.lit(1.0)).median())[0])
    plan = a.nanmedian().df._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan  # holds all distinct values in one task
