"""Registered queries of the array engine, each with the SQL that DuckDB can check it with.

Every query runs over whole tables. Sums of doubles are rounded alike on both sides, as the order of addition differs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import creation, spatial
from ..functions import quantity as q
from ..functions.quantity import Quantity
from ..operators import udf
from ..operators.array import Coord, LabelledArray, concat, reduce_objects, table
from ..operators.binning import Width, bin, combine_bins, counts_to_density, density_to_counts, group, groupby, hist, merge_equal_adjacent, nanhist, rebin
from ..operators.coords import transform_coords
from ..operators.groups import DataGroup, Dataset
from ..operators.lookup import asof_join, lookup, range_join
from ..units import ONE, RAD, Unit

FLAGSHIP = "hist_grouped"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def mark(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return mark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> LabelledArray:
    """lineitem as an event table: price with a variance, quantity, discount and tax as coordinates, a mask on high discounts."""
    c = F.col
    return table(
        read(spark, sf_dir, "lineitem"), value=c("l_extendedprice"), unit="counts", variance=c("l_extendedprice") * 2,
        coords={"quantity": (c("l_quantity"), "one"), "discount": (c("l_discount"), "one"), "tax": (c("l_tax"), "one"), "flag": (c("l_returnflag"), None), "status": (c("l_linestatus"), None), "part": (c("l_partkey"), None)},
    )


def masked_items(spark: SparkSession, sf_dir: str) -> LabelledArray:
    a = items(spark, sf_dir)
    return a.assign_masks(high=Quantity(F.col("c_discount") > 0.05, None, None, "bool"))


def order_series(spark: SparkSession, sf_dir: str) -> LabelledArray:
    """orders by key: a one-dim array of total prices with the customer as a coordinate."""
    o = read(spark, sf_dir, "orders")
    return table(o, value=F.col("o_totalprice"), unit="counts", coords={"key": (F.col("o_orderkey"), None), "customer": (F.col("o_custkey"), None), "priority": (F.col("o_orderpriority"), None)}, order=[F.col("o_orderkey")], dim="order")


def r(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
UNEVEN = [1.0, 3.0, 7.5, 20.0, 21.0, 50.0]
DISCOUNTS = [0.0, 0.02, 0.05, 0.08, 0.2]


def sql_bins(edges: list[float], name: str = "b") -> str:
    return f"(SELECT unnest(range({len(edges) - 1})) AS {name}, unnest({list(edges[:-1])}::DOUBLE[]) AS lo, unnest({list(edges[1:])}::DOUBLE[]) AS hi)"


# -- histograms and bins ------------------------------------------------------------------------------------------------------


@register(f"""SELECT f.l_returnflag AS flag, b.b AS bin, round(coalesce(sum(l_extendedprice), 0), 2) AS total, round(coalesce(sum(l_extendedprice * 2), 0), 2) AS variance
FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN {sql_bins(EDGES)} b LEFT JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND l_quantity >= lo AND l_quantity < hi GROUP BY 1, 2""")
def hist_grouped(spark, sf):
    found = hist(group(items(spark, sf), flag=None), quantity=EDGES).df
    return found.select(F.col("c_flag").alias("flag"), F.col("quantity").alias("bin"), r("value", 2).alias("total"), r("variance", 2).alias("variance"))


@register(f"SELECT b.b AS bin, round(coalesce(sum(l_extendedprice), 0), 2) AS total FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def hist_1d(spark, sf):
    return hist(items(spark, sf), quantity=EDGES).df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))


@register(f"SELECT b.b AS bin, round(coalesce(sum(l_extendedprice), 0), 2) AS total FROM {sql_bins(UNEVEN)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def hist_uneven(spark, sf):
    return hist(items(spark, sf), quantity=UNEVEN).df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))


@register(f"""SELECT a.b AS quantity, d.b AS discount, round(coalesce(sum(l_extendedprice), 0), 2) AS total
FROM {sql_bins(EDGES)} a CROSS JOIN {sql_bins(DISCOUNTS)} d LEFT JOIN lineitem ON l_quantity >= a.lo AND l_quantity < a.hi AND l_discount >= d.lo AND l_discount < d.hi GROUP BY 1, 2""")
def hist_2d(spark, sf):
    return hist(items(spark, sf), quantity=EDGES, discount=DISCOUNTS).df.select("quantity", "discount", r("value", 2).alias("total"))


@register("""WITH e AS (SELECT min(l_quantity) AS lo, nextafter(max(l_quantity), 'infinity'::DOUBLE) AS hi FROM lineitem), b AS (SELECT k AS bin, lo + k * ((hi - lo) / 7) AS a, CASE WHEN k = 6 THEN hi ELSE lo + (k + 1) * ((hi - lo) / 7) END AS z FROM e, (SELECT unnest(range(7)) AS k))
SELECT bin, count(l_quantity) AS n FROM b LEFT JOIN lineitem ON l_quantity >= a AND l_quantity < z GROUP BY 1""")
def hist_bin_count(spark, sf):
    return bin(items(spark, sf), quantity=7).size().df.select(F.col("quantity").alias("bin"), F.col("value").alias("n"))


@register("SELECT b AS bin, (SELECT count(*) FROM lineitem, (SELECT min(l_quantity) AS lo FROM lineitem) WHERE floor((l_quantity - lo) / 5) = b) AS n FROM (SELECT unnest(range((SELECT ceil((max(l_quantity) + 1e-12 - min(l_quantity)) / 5)::BIGINT FROM lineitem))) AS b)")
def hist_bin_width(spark, sf):
    found = bin(items(spark, sf), quantity=Width(5.0)).size()
    return found.df.select(F.col("quantity").alias("bin"), F.col("value").alias("n"))


@register(f"SELECT b.b AS bin, round(coalesce(sum(CASE WHEN l_tax > 0 THEN l_extendedprice END), 0), 2) AS total FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def nanhist_1d(spark, sf):
    a = items(spark, sf).map(lambda x: q.where(Quantity(F.col("c_tax") > 0, None, None, "bool"), q.values(x), Quantity(F.lit(float("nan")), None, x.unit)))
    return nanhist(a, quantity=EDGES).df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))


@register(f"SELECT b.b AS bin, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_discount <= 0.05), 0), 2) AS total FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def hist_masked(spark, sf):
    return hist(masked_items(spark, sf), quantity=EDGES).df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))


@register(f"""SELECT b.b AS bin, count(l_quantity) AS n, CASE WHEN count(l_quantity) = 0 THEN 'nan'::DOUBLE ELSE round(avg(l_extendedprice), 4) END AS mean, coalesce(min(l_extendedprice), 1.7976931348623157e308) AS lowest, coalesce(max(l_extendedprice), -1.7976931348623157e308) AS highest
FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1""")
def bins_reduce(spark, sf):
    b = bin(items(spark, sf), quantity=EDGES)
    return b.reduce_many(n="size", mean="mean", lowest="min", highest="max").select(F.col("quantity").alias("bin"), "n", F.round("mean", 4).alias("mean"), "lowest", "highest")


@register("SELECT l_linestatus AS status, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity < 50 GROUP BY 1")
def bins_concat(spark, sf):
    b = group(bin(items(spark, sf), quantity=EDGES[:-1]), status=None).concat("quantity")
    return b.sum().df.select(F.col("c_status").alias("status"), r("value", 2).alias("total"))


@register("SELECT l_returnflag AS flag, 2 * count(*) AS n FROM lineitem GROUP BY 1")
def bins_concatenate(spark, sf):
    b = group(items(spark, sf), flag=None)
    twice = b.concatenate(b)
    labels = b.coords["flag"].edges.tolist()
    return twice.size().df.select(F.get(F.array(*map(F.lit, labels)), "flag").alias("flag"), F.col("value").alias("n"))


@register(f"SELECT b.b AS bin, count(l_quantity) AS n FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi AND l_tax >= 0.02 AND l_tax < 0.06 GROUP BY 1")
def bins_slice_events(spark, sf):
    return bin(items(spark, sf), quantity=EDGES)["tax", 0.02:0.06].size().df.select(F.col("quantity").alias("bin"), F.col("value").alias("n"))


@register(f"""WITH t AS (SELECT b.b AS bin, count(l_quantity) AS n FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1)
SELECT bin, (sum(n) OVER (ORDER BY bin) - n)::BIGINT AS "begin", (sum(n) OVER (ORDER BY bin))::BIGINT AS "end" FROM t""")
def bins_constituents(spark, sf):
    return bin(items(spark, sf), quantity=EDGES).constituents().withColumnRenamed("quantity", "bin")


@register(f"SELECT CASE WHEN b.b % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, round(sum(l_extendedprice), 2) AS total FROM {sql_bins(EDGES)} b JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def bins_combine(spark, sf):
    b = combine_bins(bin(items(spark, sf), quantity=EDGES), "quantity", "parity", ["even", "odd"] * 3)
    return b.sum().df.select(F.col("c_parity").alias("parity"), r("value", 2).alias("total"))


@register(f"SELECT b.b AS bin, round(coalesce(sum(l_extendedprice * (b.b + 1)), 0), 2) AS total FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def bins_times_dense(spark, sf):
    b = bin(items(spark, sf), quantity=EDGES)
    dense = creation.arange(spark, "quantity", 1, 7, dtype="float64")
    return b.map(q.multiply, dense).sum().df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))


# -- split, apply, combine ------------------------------------------------------------------------------------------------------


@register("SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice * 2), 2) AS variance FROM lineitem GROUP BY 1")
def groupby_sum(spark, sf):
    return groupby(items(spark, sf), "flag").sum().df.select(F.col("c_flag").alias("flag"), r("value", 2).alias("total"), r("variance", 2).alias("variance"))


@register("SELECT l_returnflag AS flag, round(avg(l_extendedprice), 4) AS mean, round(sum(l_extendedprice * 2) / (count(*) * count(*)), 4) AS variance FROM lineitem GROUP BY 1")
def groupby_mean(spark, sf):
    return groupby(items(spark, sf), "flag").mean().df.select(F.col("c_flag").alias("flag"), r("value").alias("mean"), r("variance").alias("variance"))


@register("SELECT l_partkey AS part, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1")
def groupby_min_max(spark, sf):
    g = groupby(items(spark, sf).map(q.values), "part")
    return g.min().df.select(F.col("c_part").alias("part"), F.col("value").alias("lowest")).join(g.max().df.select(F.col("c_part").alias("part"), F.col("value").alias("highest")), "part")


@register("SELECT l_returnflag AS flag, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_discount <= 0.05), 0), 2) AS total FROM lineitem GROUP BY 1")
def groupby_masked(spark, sf):
    return groupby(masked_items(spark, sf), "flag").sum().df.select(F.col("c_flag").alias("flag"), r("value", 2).alias("total"))


@register("SELECT l_returnflag AS flag, bool_and(l_quantity > 1) AS every, bool_or(l_quantity > 49) AS some FROM lineitem GROUP BY 1")
def groupby_all_any(spark, sf):
    a = items(spark, sf)
    over = lambda n: a.assign_data(a.coord("quantity") > n)
    every, some = groupby(over(1.0), "flag").all().df, groupby(over(49.0), "flag").any().df
    return every.select(F.col("c_flag").alias("flag"), F.col("value").alias("every")).join(some.select(F.col("c_flag").alias("flag"), F.col("value").alias("some")), "flag")


@register(f"SELECT b.b AS bin, CASE WHEN count(l_tax) = 0 THEN 'nan'::DOUBLE ELSE round(avg(l_extendedprice), 4) END AS mean FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def groupby_bins(spark, sf):
    return groupby(items(spark, sf), "quantity", bins=EDGES).mean().df.select(F.col("quantity").alias("bin"), F.round("value", 4).alias("mean"))


@register("SELECT k AS flag, (SELECT count(*) FROM lineitem WHERE l_returnflag = k) AS n FROM (SELECT unnest(['R', 'N', 'missing']) AS k)")
def group_labels(spark, sf):
    labels = ["R", "N", "missing"]
    b = group(items(spark, sf), flag=labels)
    return b.size().df.select(F.get(F.array(*map(F.lit, labels)), "flag").alias("flag"), F.col("value").alias("n"))


# -- reductions -----------------------------------------------------------------------------------------------------------------


def _by_flag_status(spark, sf) -> LabelledArray:
    """A dense two-dim array: totals by return flag and line status."""
    b = group(group(items(spark, sf), flag=None), status=None)
    return b.sum()


@register("""WITH t AS (SELECT f.l_returnflag AS flag, s.l_linestatus AS status, coalesce(sum(l_extendedprice), 0) AS v FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s LEFT JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND l.l_linestatus = s.l_linestatus GROUP BY 1, 2)
SELECT flag, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, round(min(v), 2) AS lowest, round(max(v), 2) AS highest FROM t GROUP BY 1""")
def reduce_dim(spark, sf):
    a = _by_flag_status(spark, sf)
    a = LabelledArray(**{**a.__dict__, "coords": {"flag": a.coords["flag"]}})
    parts = [getattr(a, op)("status").df.select(F.col("c_flag").alias("flag"), r("value", d).alias(n)) for op, n, d in (("sum", "total", 2), ("mean", "mean", 4), ("min", "lowest", 2), ("max", "highest", 2))]
    return parts[0].join(parts[1], "flag").join(parts[2], "flag").join(parts[3], "flag")


@register("SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(var_samp(l_extendedprice), 2) AS var1, round(stddev_pop(l_extendedprice), 4) AS std0 FROM lineitem")
def reduce_all(spark, sf):
    found = items(spark, sf).map(q.values).reduce_many(total="sum", mean="mean", median="median", var1=("var", 1), std0=("std", 0))
    return found.select(r("total", 2).alias("total"), r("mean").alias("mean"), r("median").alias("median"), r("var1", 2).alias("var1"), r("std0").alias("std0"))


@register("SELECT round(sum(l_extendedprice) FILTER (WHERE l_discount <= 0.05), 2) AS total, round(avg(l_extendedprice) FILTER (WHERE l_discount <= 0.05), 4) AS mean, max(l_extendedprice) FILTER (WHERE l_discount <= 0.05) AS highest FROM lineitem")
def reduce_masked(spark, sf):
    a = masked_items(spark, sf).map(q.values)
    return a.sum().df.select(r("value", 2).alias("total")).join(a.mean().df.select(r("value").alias("mean"))).join(a.max().df.select(F.col("value").alias("highest")))


@register("SELECT round(sum(l_extendedprice) FILTER (WHERE l_tax > 0), 2) AS total, round(avg(l_extendedprice) FILTER (WHERE l_tax > 0), 4) AS mean, min(l_extendedprice) FILTER (WHERE l_tax > 0) AS lowest, round(median(l_extendedprice) FILTER (WHERE l_tax > 0), 4) AS median, isnan('nan'::DOUBLE) AS sum_is_nan FROM lineitem")
def reduce_nan(spark, sf):
    a = items(spark, sf).map(lambda x: q.where(Quantity(F.col("c_tax") > 0, None, None, "bool"), q.values(x), Quantity(F.lit(float("nan")), None, x.unit)))
    parts = [a.nansum().df.select(r("value", 2).alias("total")), a.nanmean().df.select(r("value").alias("mean")), a.nanmin().df.select(F.col("value").alias("lowest")), a.nanmedian().df.select(r("value").alias("median")), a.sum().df.select(F.isnan("value").alias("sum_is_nan"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # single rows
    return out


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS running FROM orders")
def cumsum(spark, sf):
    return order_series(spark, sf).cumsum("order").df.select(F.col("order").alias("pos"), r("value", 2).alias("running"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, round(coalesce(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS running FROM orders")
def cumsum_exclusive(spark, sf):
    return order_series(spark, sf).cumsum("order", "exclusive").df.select(F.col("order").alias("pos"), r("value", 2).alias("running"))


@register("SELECT k AS pos, 3.0 * k AS total, 1.0 * k AS mean, 2.0 * k AS highest FROM (SELECT unnest(range(5)) AS k)".replace("3.0 * k", "(3 * k)::DOUBLE").replace("1.0 * k", "k::DOUBLE").replace("2.0 * k", "(2 * k)::DOUBLE"))
def reduce_objects_across(spark, sf):
    a = creation.arange(spark, "pos", 5, dtype="float64")
    three = [a, a * 0.0, a * 2.0]
    total, mean, high = (reduce_objects(three, op).df for op in ("sum", "mean", "max"))
    return total.select("pos", F.col("value").alias("total")).join(mean.select("pos", F.col("value").alias("mean")), "pos").join(high.select("pos", F.col("value").alias("highest")), "pos")


# -- element-wise -----------------------------------------------------------------------------------------------------------------


def _pair(spark, sf) -> tuple[DataFrame, Quantity, Quantity]:
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", F.col("l_suppkey").cast("long").alias("l_suppkey"), F.col("l_partkey").cast("long").alias("l_partkey"))
    return df, Quantity(F.col("l_extendedprice"), F.col("l_quantity")), Quantity(F.col("l_discount") + 1, F.col("l_discount"))


@register("""SELECT l_orderkey, l_linenumber, round(l_extendedprice + (l_discount + 1), 6) AS a, round(l_quantity + l_discount, 6) AS av, round(l_extendedprice * (l_discount + 1), 6) AS m,
(l_quantity * (l_discount + 1) ** 2 + l_discount * l_extendedprice ** 2)::FLOAT AS mv, round(l_extendedprice / (l_discount + 1), 6) AS d, ((l_quantity + l_discount * (l_extendedprice / (l_discount + 1)) ** 2) / (l_discount + 1) ** 2)::FLOAT AS dv FROM lineitem""")
def arithmetic_variances(spark, sf):
    df, x, y = _pair(spark, sf)
    out = {"a": (x + y, 6), "m": (x * y, 6), "d": (x / y, 6)}
    return df.select("l_orderkey", "l_linenumber", *(c for n, (v, d) in out.items() for c in (r(v.value, d).alias(n), (r(v.variance, 6) if n == "a" else v.variance.cast("float")).alias(f"{n}v"))))


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN b = 0 THEN 0 ELSE floor(a::DOUBLE / b)::BIGINT END AS fd, CASE WHEN b = 0 THEN 0 ELSE (a - floor(a::DOUBLE / b)::BIGINT * b) END AS md, CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'nan' WHEN a > 0 THEN 'inf' ELSE '-inf' END ELSE 'finite' END AS kind
FROM (SELECT l_orderkey, l_linenumber, l_partkey::BIGINT - 50 AS a, l_suppkey::BIGINT % 7 - 3 AS b FROM lineitem)""")
def integer_division(spark, sf):
    df, _, _ = _pair(spark, sf)
    a, b = Quantity(F.col("l_partkey") - 50, None, ONE, "int64"), Quantity(F.col("l_suppkey") % 7 - 3, None, ONE, "int64")
    ratio = (a / b).value
    kind = F.when(F.isnan(ratio), "nan").when(ratio == float("inf"), "inf").when(ratio == float("-inf"), "-inf").otherwise("finite")
    return df.select("l_orderkey", "l_linenumber", (a // b).value.alias("fd"), (a % b).value.cast("long").alias("md"), kind.alias("kind"))


@register("""SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(l_quantity / (4 * l_extendedprice), 8) AS rootv, round(ln(l_extendedprice), 6) AS ln, round(l_quantity / l_extendedprice ** 2, 10) AS lnv, round(exp(-l_discount), 8) AS e, round(l_extendedprice ** 2, 2) AS sq, floor(l_extendedprice) AS fl, ceil(l_extendedprice) AS ce, round_even(l_extendedprice, 0) AS ro FROM lineitem""")
def math_functions(spark, sf):
    df, x, _ = _pair(spark, sf)
    root, log = q.sqrt(x), q.log(x)
    return df.select(
        "l_orderkey", "l_linenumber", r(root.value, 6).alias("root"), r(root.variance, 8).alias("rootv"), r(log.value, 6).alias("ln"), r(log.variance, 10).alias("lnv"), r(q.exp(Quantity(-F.col("l_discount"))).value, 8).alias("e"),
        r(q.pow(x, 2).value, 2).alias("sq"), q.floor(x).value.alias("fl"), q.ceil(x).value.alias("ce"), q.round(x).value.alias("ro"),
    )


@register("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 8) AS s, round(cos(radians(l_quantity)), 8) AS c, round(tan(l_discount), 8) AS t, round(asin(l_discount), 8) AS asn, round(atan2(l_tax, l_discount), 8) AS at2, round(sinh(l_discount), 8) AS sh, round(tanh(l_discount), 8) AS th, round(asinh(l_quantity), 8) AS ash, round(CASE WHEN l_discount = 0 THEN 1 ELSE sin(l_discount) / l_discount END, 8) AS sc FROM lineitem""")
def trigonometry(spark, sf):
    df = read(spark, sf, "lineitem")
    n, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    one = lambda x: Quantity(x)
    rad = lambda x: Quantity(x, None, RAD)
    found = {"s": q.sin(rad(n)), "c": q.cos(Quantity(n, None, Unit("deg"))), "t": q.tan(rad(d)), "asn": q.asin(one(d)), "at2": q.atan2(one(t), one(d)), "sh": q.sinh(one(d)), "th": q.tanh(one(d)), "ash": q.asinh(one(n)), "sc": q.sinc(rad(d))}
    return df.select("l_orderkey", "l_linenumber", *(r(v.value, 8).alias(k) for k, v in found.items()))


@register("""SELECT l_orderkey, l_linenumber, l_quantity < 10 AS lt, l_quantity >= 25 AS ge, l_quantity = 7 AS eq, l_quantity <> 7 AS ne, (l_quantity < 10) <> (l_tax > 0.03) AS x, abs(l_quantity - 10) <= 1e-8 + 0.1 * 10 AS near, NOT (l_tax > 0.03) AS n FROM lineitem""")
def comparisons(spark, sf):
    df = read(spark, sf, "lineitem")
    n, t = Quantity(F.col("l_quantity")), Quantity(F.col("l_tax"))
    found = {"lt": n < 10.0, "ge": n >= 25.0, "eq": q.equal(n, 7.0), "ne": q.not_equal(n, 7.0), "x": (n < 10.0) ^ (t > 0.03), "near": q.isclose(n, q.quantity(10.0), rtol=0.1), "n": ~(t > 0.03)}
    return df.select("l_orderkey", "l_linenumber", *(v.value.alias(k) for k, v in found.items()))


@register("""SELECT k, v < 1 AS lt, v > 1 AS gt, v = v AS same, isnan(v) AS nan, isinf(v) AS inf, isfinite(v) AS fin FROM (SELECT unnest(range(4)) AS k, unnest([0.5, 'inf'::DOUBLE, '-inf'::DOUBLE, 2.0]) AS v)
UNION ALL SELECT 4, false, false, false, true, false, false""")
def special_values(spark, sf):
    df = spark.createDataFrame([(0, 0.5), (1, float("inf")), (2, float("-inf")), (3, 2.0), (4, float("nan"))], "k long, v double")
    v = Quantity(F.col("v"))
    found = {"lt": v < 1.0, "gt": v > 1.0, "same": q.equal(v, v), "nan": q.isnan(v), "inf": q.isinf(v), "fin": q.isfinite(v)}
    return df.select("k", *(x.value.alias(n) for n, x in found.items()))


@register("SELECT l_orderkey, l_linenumber, round(l_quantity * 1000, 4) AS mm, round(l_quantity / 1000, 8) AS km, (l_partkey::BIGINT * 60) AS sec FROM lineitem")
def unit_conversion(spark, sf):
    df = read(spark, sf, "lineitem")
    m = Quantity(F.col("l_quantity"), None, Unit("m"))
    return df.select("l_orderkey", "l_linenumber", r(q.to_unit(m, "mm").value).alias("mm"), r(q.to_unit(m, "km").value, 8).alias("km"), q.to_unit(Quantity(F.col("l_partkey").cast("long"), None, Unit("min"), "int64"), "s").value.alias("sec"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, round(o_totalprice + 2 * o_totalprice, 2) AS total FROM orders")
def array_plus_array(spark, sf):
    a = order_series(spark, sf)
    return (a + a * 2.0).df.select(F.col("order").alias("pos"), r("value", 2).alias("total"))


# -- selection, order, shape ---------------------------------------------------------------------------------------------------------


@register("SELECT p AS pos, o_orderkey AS key FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p0, o_orderkey FROM orders) CROSS JOIN LATERAL (SELECT (p0 - 10) // 3 AS p) WHERE p0 >= 10 AND p0 < 100 AND (p0 - 10) % 3 = 0")
def slice_positions(spark, sf):
    return order_series(spark, sf)["order", 10:100:3].df.select(F.col("order").alias("pos"), F.col("c_key").alias("key"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key FROM orders WHERE o_totalprice > 200000")
def select_condition(spark, sf):
    return order_series(spark, sf)[F.col("value") > 200000].df.select(F.col("order").alias("pos"), F.col("c_key").alias("key"))


@register("WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_orderkey FROM orders) SELECT i.pos, t.o_orderkey AS key FROM (SELECT unnest(range(4)) AS pos, unnest([5, 2, 2, 9]) AS p) i JOIN t USING (p)")
def select_list(spark, sf):
    return order_series(spark, sf)["order", [5, 2, 2, 9]].df.select(F.col("order").alias("pos"), F.col("c_key").alias("key"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key FROM orders WHERE o_orderkey >= 50 AND o_orderkey < 400")
def slice_labels(spark, sf):
    a = order_series(spark, sf)
    a = a.assign_coords(order=a.coord("key"))
    return a["order", (50, None):(400, None)].df.select(F.col("order").alias("pos"), F.col("c_key").alias("key"))


@register("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos, o_orderkey AS key, o_custkey AS customer FROM orders")
def sort_by_coord(spark, sf):
    return order_series(spark, sf).sort("customer").df.select(F.col("order").alias("pos"), F.col("c_key").alias("key"), F.col("c_customer").alias("customer"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, round((o_totalprice + lead(o_totalprice) OVER (ORDER BY o_orderkey)) / 2, 4) AS mid FROM orders QUALIFY lead(o_orderkey) OVER (ORDER BY o_orderkey) IS NOT NULL")
def midpoints(spark, sf):
    return order_series(spark, sf).midpoints().df.select(F.col("order").alias("pos"), r("value").alias("mid"))


@register("WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_totalprice AS v FROM orders), n AS (SELECT count(*) AS n FROM orders) SELECT p AS pos, v FROM t UNION ALL SELECT p + n, v FROM t, n")
def concat_arrays(spark, sf):
    a = order_series(spark, sf)
    return concat([a, a], "order").df.select(F.col("order").alias("pos"), F.col("value").alias("v"))


@register("SELECT p // 20 AS a, p % 20 // 5 AS b, p % 5 AS c, p + 0.0::DOUBLE AS v, p AS flat FROM (SELECT unnest(range(60)) AS p)")
def fold_flatten(spark, sf):
    a = creation.arange(spark, "p", 60, dtype="float64").fold("p", a=3, b=4, c=-1)
    flat = a.flatten("flat").df
    return a.df.withColumnRenamed("value", "v").join(flat.withColumnRenamed("value", "v"), "v").select("a", "b", "c", "v", "flat")


@register("SELECT p AS pos, 2.0::DOUBLE + p * (3.0 / 7) AS v FROM (SELECT unnest(range(7)) AS p) UNION ALL SELECT 7, 5.0".replace("SELECT p AS pos, 2.0::DOUBLE + p * (3.0 / 7) AS v", "SELECT p AS pos, round(2.0::DOUBLE + p * (3.0::DOUBLE / 7), 9) AS v"))
def create_linspace(spark, sf):
    return creation.linspace(spark, "pos", 2.0, 5.0, 8).df.select("pos", r("value", 9).alias("v"))


@register("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, lag(o_orderkey) OVER w AS pk, lag(o_custkey) OVER w AS pc FROM orders WINDOW w AS (ORDER BY o_orderkey))
SELECT 0::BIGINT AS first, count(*) AS n, bool_and(coalesce(pk <= k, true)) AS up, bool_and(coalesce(pk >= k, true)) AS down, bool_and(coalesce(pc <= c, true)) AS by_customer FROM o""")
def sorted_checks(spark, sf):
    a = order_series(spark, sf)
    keys, customers = a.assign_data(a.coord("key")), a.assign_data(a.coord("customer"))
    found = {"up": keys.allsorted("order"), "down": keys.allsorted("order", "descending"), "by_customer": customers.allsorted("order")}
    return keys.df.agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).select("*", *(F.lit(v).alias(n) for n, v in found.items()))


# -- lookups, joins, re-binning ---------------------------------------------------------------------------------------------------------


@register(f"""WITH t AS (SELECT b.b, lo, hi, count(l_tax) AS n FROM {sql_bins(UNEVEN)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, coalesce(t.n, 0)::BIGINT AS n FROM lineitem LEFT JOIN t ON l_quantity >= lo AND l_quantity < hi""")
def lookup_histogram(spark, sf):
    counts = bin(items(spark, sf), quantity=UNEVEN).size()
    found = lookup(counts, "quantity")[Quantity(F.col("l_quantity"), None, ONE)]
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.value.cast("long").alias("n"))


_POINTS = [(2.0, 10.0), (11.0, 20.0), (30.5, 30.0), (44.0, 40.0)]
_VALUES = "(SELECT unnest([2.0, 11.0, 30.5, 44.0]::DOUBLE[]) AS x, unnest([10.0, 20.0, 30.0, 40.0]::DOUBLE[]) AS v)"


def _table(spark) -> LabelledArray:
    df = spark.createDataFrame([(k, x, v) for k, (x, v) in enumerate(_POINTS)], "quantity long, c_quantity double, value double")
    return LabelledArray(df, ("quantity",), {"quantity": len(_POINTS)}, {"quantity": Coord(("quantity",))}, {})


@register(f"SELECT l_orderkey, l_linenumber, coalesce(v, -1) AS v FROM lineitem ASOF LEFT JOIN {_VALUES} t ON l_quantity >= x")
def lookup_previous(spark, sf):
    found = lookup(_table(spark), "quantity", "previous", -1.0)[Quantity(F.col("l_quantity"))]
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.value.alias("v"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 6.5 THEN 10.0 WHEN l_quantity < 20.75 THEN 20.0 WHEN l_quantity < 37.25 THEN 30.0 ELSE 40.0 END::DOUBLE AS v FROM lineitem")
def lookup_nearest(spark, sf):
    found = lookup(_table(spark), "quantity", "nearest")[Quantity(F.col("l_quantity"))]
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.value.alias("v"))


@register(f"""WITH w AS (SELECT b + 1 AS f, lo, hi FROM {sql_bins(UNEVEN)}) SELECT l_returnflag AS flag, round(sum(l_extendedprice * coalesce(f, 0)), 2) AS total FROM lineitem LEFT JOIN w ON l_quantity >= lo AND l_quantity < hi GROUP BY 1""")
def bins_times_lookup(spark, sf):
    weights = creation.arange(spark, "quantity", 1, 6, dtype="float64").assign_coords(quantity=Coord(("quantity",), ONE, "float64", np.array(UNEVEN)))
    b = lookup(weights, "quantity").scale(group(items(spark, sf), flag=None))
    return b.sum().df.select(F.col("c_flag").alias("flag"), r("value", 2).alias("total"))


@register("SELECT e.event_id, p.value AS value_asof FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join_events(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.agg(F.min("event_type")).first()[0]
    found = asof_join(e.drop("value"), e.where(F.col("event_type") == first).select("user_id", "us", "value"), "us", "us", "value", by=["user_id"])
    return found.select("event_id", "value_asof")


@register(f"SELECT l_orderkey, l_linenumber, b.b AS bin FROM lineitem JOIN {sql_bins(UNEVEN)} b ON l_quantity >= lo AND l_quantity < hi")
def range_join_bins(spark, sf):
    bins = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(UNEVEN, UNEVEN[1:], strict=False))], "bin long, lo double, hi double")
    return range_join(read(spark, sf, "lineitem"), bins, "l_quantity", "lo", "hi", 5.0).select("l_orderkey", "l_linenumber", "bin")


_NEW = [0.0, 4.0, 15.0, 33.0, 60.0]


@register(f"""WITH h AS (SELECT lo, hi, coalesce(sum(l_extendedprice), 0) AS v FROM {sql_bins(EDGES)} LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1, 2)
SELECT n.b AS bin, round(sum(h.v * greatest(0, least(h.hi, n.hi) - greatest(h.lo, n.lo)) / (h.hi - h.lo)), 2) AS total FROM {sql_bins(_NEW)} n CROSS JOIN h GROUP BY 1""")
def rebin_hist(spark, sf):
    return rebin(hist(items(spark, sf), quantity=EDGES), quantity=np.array(_NEW)).df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))


@register(f"SELECT b.b AS bin, round(coalesce(sum(l_extendedprice), 0) / (hi - lo), 4) AS density, round(coalesce(sum(l_extendedprice), 0), 2) AS counts FROM {sql_bins(UNEVEN)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1, lo, hi")
def density(spark, sf):
    h = hist(items(spark, sf), quantity=UNEVEN)
    d = counts_to_density(h, "quantity")
    return d.df.select(F.col("quantity").alias("bin"), r("value").alias("density")).join(density_to_counts(d, "quantity").df.select(F.col("quantity").alias("bin"), r("value", 2).alias("counts")), "bin")


@register("SELECT unnest([0, 1, 2])::BIGINT AS bin, unnest([1.0, 2.0, 1.0])::DOUBLE AS v")
def merge_adjacent(spark, sf):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0), (3, 1.0), (4, 1.0)], "x long, value double")
    a = LabelledArray(df, ("x",), {"x": 5}, {"x": Coord(("x",), ONE, "float64", np.arange(6.0))}, {})
    return merge_equal_adjacent(a).df.select(F.col("x").alias("bin"), F.col("value").alias("v"))


# -- coordinates, vectors, series ---------------------------------------------------------------------------------------------------------


@register("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_tax ** 2), 8) AS radius, round(l_discount * 2, 8) AS twice FROM lineitem")
def transform(spark, sf):
    df = read(spark, sf, "lineitem")
    a = table(df, coords={"x": (F.col("l_quantity"), "m"), "y": (F.col("l_tax"), "m"), "d": (F.col("l_discount"), "one"), "ok": (F.col("l_orderkey"), None), "ln": (F.col("l_linenumber"), None)})
    graph = {"squares": lambda x, y: x * x + y * y, "radius": lambda squares: q.sqrt(squares), "alias": "d", "twice": lambda alias: alias * 2.0}
    out = transform_coords(a, ["radius", "twice"], graph, keep_intermediate=False)
    return out.df.select(F.col("c_ok").alias("l_orderkey"), F.col("c_ln").alias("l_linenumber"), r("c_radius", 8).alias("radius"), r("c_twice", 8).alias("twice"))


@register("""SELECT vec_id, round(x * x + y * y + z * z, 6) AS dot, round(sqrt(x * x + y * y + z * z), 6) AS norm, round(y * 3 - z * 2, 6) AS cx, round(-y, 6) + 0.0 AS rx, round(x, 6) AS ry FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)""")
def vectors(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", spatial.as_vectors(*(F.get("embedding", F.lit(k)) for k in range(3))).alias("v"))
    v = F.col("v")
    quarter = spatial.rotations_from_rotvecs(spatial.vector(0, 0, np.pi / 2))
    turned = spatial.rotated(quarter, v)
    return e.select("vec_id", r(spatial.dot(v, v), 6).alias("dot"), r(spatial.norm(v), 6).alias("norm"), r(spatial.cross(v, spatial.vector(1, 2, 3))["x"], 6).alias("cx"), r(turned["x"], 6).alias("rx"), r(turned["y"], 6).alias("ry"))


@register("SELECT round(sum((k - pk) * (v + pv) / 2), 2) AS area FROM (SELECT o_orderkey AS k, o_totalprice AS v, lag(o_orderkey) OVER w AS pk, lag(o_totalprice) OVER w AS pv FROM orders WINDOW w AS (ORDER BY o_orderkey))")
def integrate_trapezoid(spark, sf):
    a = order_series(spark, sf)
    a = a.assign_coords(order=Quantity(F.col("c_key").cast("double"), None, ONE))
    return udf.trapezoid(a, "order").df.select(r("value", 2).alias("area"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, max(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS most FROM orders")
def filter_maximum(spark, sf):
    a = order_series(spark, sf)
    a = LabelledArray(**{**a.__dict__, "coords": {}})
    return udf.maximum_filter(LabelledArray(**{**a.__dict__, "df": a.df.select("order", "value")}), size=3).df.select(F.col("order").alias("pos"), F.col("value").alias("most"))


@register("SELECT p AS pos FROM (SELECT row_number() OVER w - 1 AS p, o_totalprice AS v, lag(o_totalprice) OVER w AS a, lead(o_totalprice) OVER w AS b FROM orders WINDOW w AS (ORDER BY o_orderkey)) WHERE v > a AND v > b AND v >= 300000")
def peaks(spark, sf):
    return udf.find_peaks(order_series(spark, sf), height=300000.0).select(F.col("order").alias("pos"))


@register("SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def curve_fit_line(spark, sf):
    a = items(spark, sf).map(q.values)
    flags = [x[0] for x in a.df.select("c_flag").distinct().orderBy("c_flag").collect()]
    df = a.df.withColumn("flag", F.array_position(F.array(*map(F.lit, flags)), F.col("c_flag")).cast("long") - 1)
    grid = LabelledArray(df, ("flag", "row"), {"flag": len(flags), "row": -1}, {"quantity": Coord(("row",))}, {}, ONE)
    found = udf.curve_fit(["quantity"], lambda quantity, slope, intercept: slope * quantity + intercept, grid, reduce_dims=["row"])
    return found.select(F.get(F.array(*map(F.lit, flags)), "flag").alias("flag"), F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


@register("SELECT k, round(erf, 6) AS erf, round(erfc, 6) AS erfc FROM (SELECT unnest([0, 1]) AS k, unnest([0.0, 0.8427007929497149]) AS erf, unnest([1.0, 0.15729920705028513]) AS erfc)".replace("[0, 1]", "[0, 1]::BIGINT[]").replace("0.15729920705028513]", "0.15729920705028513]::DOUBLE[]").replace("0.8427007929497149]", "0.8427007929497149]::DOUBLE[]"))
def error_function(spark, sf):
    df = spark.range(2).withColumnRenamed("id", "k").coalesce(1)
    x = Quantity(F.col("k").cast("double"))
    return df.select("k", r(q.erf(x).value, 6).alias("erf"), r(q.erfc(x).value, 6).alias("erfc"))


@register("SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax, 6) AS v FROM lineitem")
def user_function(spark, sf):
    f = udf.elemwise_func(lambda a, b: 2 * a + b)
    df = read(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", r(f(Quantity(F.col("l_quantity")), Quantity(F.col("l_tax"))).value, 6).alias("v"))


@register("SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def dataset_groupby(spark, sf):
    a = items(spark, sf).map(q.values)
    ds = Dataset({"price": a, "quantity": a.assign_data(a.coord("quantity"))})
    parts = DataGroup({k: groupby(ds[k], "flag") for k in ds}).sum()
    return parts["price"].df.select(F.col("c_flag").alias("flag"), r("value", 2).alias("price")).join(parts["quantity"].df.select(F.col("c_flag").alias("flag"), r("value", 2).alias("quantity")), "flag")


_HOURS = [0, 6 * 3600, 12 * 3600, 18 * 3600, 24 * 3600]


@register("SELECT b AS bin, (SELECT count(*) FROM events WHERE floor(extract(hour FROM ts) / 6) = b) AS n FROM (SELECT unnest(range(4)) AS b)")
def hist_datetime(spark, sf):
    e = read(spark, sf, "events")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    a = table(e, coords={"time": (seconds.cast("long"), "s")})
    return bin(a, time=np.array(_HOURS)).size().df.select(F.col("time").alias("bin"), F.col("value").alias("n"))


# -- more of each family, on whole tables -------------------------------------------------------------------------------------------------


@register("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - (l_discount + 1), 6) AS s, round(l_quantity + l_discount, 6) AS sv, round(-l_extendedprice, 6) AS neg, l_quantity AS negv, round(abs(l_tax - 0.04), 8) AS ab, round(1 / l_extendedprice, 10) AS rec,
round(log10(l_extendedprice), 8) AS lg, CASE WHEN l_tax = 0 THEN -1.0 ELSE round(l_quantity / l_tax, 6) END AS num, round(l_quantity, 6) AS var, round(sqrt(l_quantity), 8) AS dev, l_extendedprice::BIGINT AS whole FROM (SELECT *, 0 FROM lineitem)""".replace("l_extendedprice::BIGINT", "trunc(l_extendedprice)::BIGINT"))
def arithmetic_more(spark, sf):
    df, x, y = _pair(spark, sf)
    tax = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    t, n = Quantity(F.col("l_tax")), Quantity(F.col("l_quantity"))
    s, neg = q.subtract(x, y), q.negative(x)
    return tax.select(
        "l_orderkey", "l_linenumber", r(s.value, 6).alias("s"), r(s.variance, 6).alias("sv"), r(neg.value, 6).alias("neg"), neg.variance.alias("negv"), r(abs(t - 0.04).value, 8).alias("ab"), r(q.reciprocal(q.values(x)).value, 10).alias("rec"),
        r(q.log10(q.values(x)).value, 8).alias("lg"), r(q.nan_to_num(n / t, posinf=-1.0).value, 6).alias("num"), r(q.variances(x).value, 6).alias("var"), r(q.stddevs(x).value, 8).alias("dev"), q.to(q.values(x), dtype="int64").value.alias("whole"),
    )


@register("""SELECT l_orderkey, l_linenumber, round(acos(l_discount), 8) AS ac, round(atan(l_quantity), 8) AS at, round(cosh(l_discount), 8) AS ch, round(acosh(l_quantity), 8) AS ach, round(atanh(l_discount), 8) AS ath FROM lineitem""")
def trigonometry_more(spark, sf):
    n, d = Quantity(F.col("l_quantity")), Quantity(F.col("l_discount"))
    found = {"ac": q.acos(d), "at": q.atan(n), "ch": q.cosh(d), "ach": q.acosh(n), "ath": q.atanh(d)}
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(r(v.value, 8).alias(k) for k, v in found.items()))


@register("""SELECT l_orderkey, l_linenumber, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity <= 10 AND l_tax > 0.03 AS both, l_quantity <= 10 OR l_tax > 0.03 AS either, l_tax = 0 AND l_quantity > 25 AS pos, l_tax = 0 AND l_quantity < 25 AS neg, l_tax = 0 AND l_quantity <> 25 AS inf,
l_tax = 0 AND l_quantity = 25 AS nan, l_tax <> 0 AS fin FROM lineitem""")
def comparisons_more(spark, sf):
    n, t = Quantity(F.col("l_quantity")), Quantity(F.col("l_tax"))
    odd = (n - 25.0) / t
    found = {"le": n <= 10.0, "gt": n > 10.0, "both": (n <= 10.0) & (t > 0.03), "either": (n <= 10.0) | (t > 0.03), "pos": q.isposinf(odd), "neg": q.isneginf(odd), "inf": q.isinf(odd), "nan": q.isnan(odd), "fin": q.isfinite(odd)}
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(v.value.alias(k) for k, v in found.items()))


def _with_nan(spark, sf) -> LabelledArray:
    """Prices, NaN where there is no tax."""
    return items(spark, sf).map(lambda x: q.where(Quantity(F.col("c_tax") > 0, None, None, "bool"), q.values(x), Quantity(F.lit(float("nan")), None, x.unit)))


@register("""SELECT l_returnflag AS flag, round(sum(l_extendedprice) FILTER (WHERE l_tax > 0), 2) AS total, round(avg(l_extendedprice) FILTER (WHERE l_tax > 0), 4) AS mean, min(l_extendedprice) FILTER (WHERE l_tax > 0) AS lowest, max(l_extendedprice) FILTER (WHERE l_tax > 0) AS highest FROM lineitem GROUP BY 1""")
def groupby_nan(spark, sf):
    g = _with_nan(spark, sf).groupby("flag")
    parts = [g.nansum().df.select(F.col("c_flag").alias("flag"), r("value", 2).alias("total")), g.nanmean().df.select(F.col("c_flag").alias("flag"), r("value").alias("mean")), g.nanmin().df.select(F.col("c_flag").alias("flag"), F.col("value").alias("lowest")), g.nanmax().df.select(F.col("c_flag").alias("flag"), F.col("value").alias("highest"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "flag")
    return out


@register("SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def groupby_concat(spark, sf):
    b = items(spark, sf).map(q.values).groupby("flag").concat()
    return b.size().df.join(b.sum().df.select(F.col("flag"), F.col("c_flag"), r("value", 2).alias("total")), "flag").select(F.col("c_flag").alias("flag"), F.col("value").alias("n"), "total")


@register(f"""SELECT b.b AS bin, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_tax > 0), 0), 2) AS total, CASE WHEN count(l_tax) FILTER (WHERE l_tax > 0) = 0 THEN 'nan'::DOUBLE ELSE round(avg(l_extendedprice) FILTER (WHERE l_tax > 0), 4) END AS mean,
coalesce(min(l_extendedprice) FILTER (WHERE l_tax > 0), 1.7976931348623157e308) AS lowest, coalesce(max(l_extendedprice) FILTER (WHERE l_tax > 0), -1.7976931348623157e308) AS highest FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1""")
def bins_nan(spark, sf):
    found = _with_nan(spark, sf).bin(quantity=EDGES).reduce_many(total="nansum", mean="nanmean", lowest="nanmin", highest="nanmax")
    return found.select(F.col("quantity").alias("bin"), r("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "lowest", "highest")


@register(f"SELECT b.b AS bin, coalesce(bool_and(l_tax > 0.01), true) AS every, coalesce(bool_or(l_tax > 0.07), false) AS some FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def bins_all_any(spark, sf):
    a = items(spark, sf)
    every, some = (a.assign_data(a.coord("tax") > n).bin(quantity=EDGES) for n in (0.01, 0.07))
    return every.all().df.select(F.col("quantity").alias("bin"), F.col("value").alias("every")).join(some.any().df.select(F.col("quantity").alias("bin"), F.col("value").alias("some")), "bin")


@register(f"SELECT b.b AS bin, round(coalesce(sum(l_extendedprice / (b.b + 1)) FILTER (WHERE l_discount <= 0.05), 0), 2) AS total, count(l_tax) AS n FROM {sql_bins(EDGES)} b LEFT JOIN lineitem ON l_quantity >= lo AND l_quantity < hi GROUP BY 1")
def bins_edit(spark, sf):
    weights = creation.arange(spark, "quantity", 1, 7, dtype="float64").assign_coords(quantity=Coord(("quantity",), ONE, "float64", np.array(EDGES)))
    b = items(spark, sf).map(q.values).bin(quantity=EDGES).assign_masks(high=Quantity(F.col("c_discount") > 0.05, None, None, "bool")).assign_coords(copy=Quantity(F.col("c_tax"))).drop_coords("tax")
    b = lookup(weights, "quantity").scale(b, divide=True)
    total = b.sum().df.select(F.col("quantity").alias("bin"), r("value", 2).alias("total"))
    return total.join(b.drop_masks("high").size().df.select(F.col("quantity").alias("bin"), F.col("value").alias("n")), "bin")


@register("""SELECT round(var_pop(l_extendedprice) FILTER (WHERE l_tax > 0), 2) AS var0, round(stddev_samp(l_extendedprice) FILTER (WHERE l_tax > 0), 4) AS std1, max(l_extendedprice) FILTER (WHERE l_tax > 0) AS highest, bool_and(l_quantity > 0) AS every, bool_or(l_quantity > 50) AS some FROM lineitem""")
def reduce_more(spark, sf):
    a, b = _with_nan(spark, sf), items(spark, sf)
    over = lambda n: b.assign_data(b.coord("quantity") > n)
    one = lambda x, n, d=None: x.df.select((F.col("value") if d is None else r("value", d)).alias(n))
    out = one(a.nanvar(ddof=0), "var0", 2)
    for part in (one(a.nanstd(ddof=1), "std1", 4), one(a.nanmax(), "highest"), one(over(0.0).all(), "every"), one(over(50.0).any(), "some")):
        out = out.join(part)  # single rows
    return out


@register("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, round(o_totalprice / 2, 4) AS lowest, o_totalprice * 2 AS highest, round(o_totalprice * 3.5, 3) AS total, round(o_totalprice * 3.5 / 3, 4) AS mean FROM orders""")
def reduce_across_series(spark, sf):
    a = order_series(spark, sf)
    three = [a, a * 0.5, a * 2.0]
    parts = [reduce_objects(three, op).df.select(F.col("order").alias("pos"), (r("value", d) if d else F.col("value")).alias(n)) for op, n, d in (("nanmin", "lowest", 4), ("nanmax", "highest", 0), ("nansum", "total", 3), ("nanmean", "mean", 4))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "pos")
    return out


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice > 100000 AND o_totalprice > 200000 AS every, o_totalprice > 100000 OR o_totalprice > 200000 AS some FROM orders")
def reduce_across_flags(spark, sf):
    a = order_series(spark, sf)
    flags = [a.map(lambda x, n=n: q.greater(x, Quantity(F.lit(n), None, x.unit))) for n in (100000.0, 200000.0)]
    every, some = reduce_objects(flags, "all").df, reduce_objects(flags, "any").df
    return every.select(F.col("order").alias("pos"), F.col("value").alias("every")).join(some.select(F.col("order").alias("pos"), F.col("value").alias("some")), "pos")


@register("""WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_totalprice AS v FROM orders) SELECT p // 10 AS a, p % 10 AS b, v, p AS flat, p % 10 = 3 AS third FROM t""")
def fold_series(spark, sf):
    a = order_series(spark, sf).fold("order", a=-1, b=10)
    third = a["b", 3].rename_dims(a="x").df.select(F.col("x").alias("a"), F.lit(3).cast("long").alias("b"), F.lit(True).alias("third"))
    flat = a.transpose(["b", "a"]).transpose(["a", "b"]).flatten("flat").df.select("flat", F.expr("flat div 10").alias("a"), (F.col("flat") % 10).alias("b"))
    return a.df.select("a", "b", F.col("value").alias("v")).join(flat, ["a", "b"]).join(third, ["a", "b"], "left").select("a", "b", "v", "flat", F.coalesce("third", F.lit(False)).alias("third"))


@register("""WITH t AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_orderkey AS k, count(*) OVER () AS n FROM orders) SELECT 0::BIGINT AS which, k FROM t WHERE p = 7 UNION ALL SELECT 1, k FROM t WHERE p = n - 1 UNION ALL SELECT 2, k FROM t WHERE k = (SELECT max(k) FROM t)""")
def slice_points(spark, sf):
    a = order_series(spark, sf)
    last = a.df.agg(F.max("c_key")).first()[0]
    found = [a["order", 7], a["order", -1], a.assign_coords(order=a.coord("key"))["order", (last, None)]]
    out = None
    for k, x in enumerate(found):
        part = x.df.select(F.lit(k).cast("long").alias("which"), F.col("c_key").alias("k"))
        out = part if out is None else out.union(part)
    return out


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CASE WHEN pos >= 5 AND pos < 9 THEN 1.5 ELSE o_totalprice END AS v FROM orders".replace("pos >= 5", "row_number() OVER (ORDER BY o_orderkey) - 1 >= 5").replace("pos < 9", "row_number() OVER (ORDER BY o_orderkey) - 1 < 9"))
def set_slice(spark, sf):
    return order_series(spark, sf).set_slice("order", 5, 9, 1.5).df.select(F.col("order").alias("pos"), F.col("value").alias("v"))


@register("SELECT c.k AS copy, row_number() OVER (PARTITION BY c.k ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS v FROM orders CROSS JOIN (SELECT unnest(range(3)) AS k) c")
def broadcast_series(spark, sf):
    return order_series(spark, sf).broadcast(copy=3).df.select("copy", F.col("order").alias("pos"), F.col("value").alias("v"))


@register("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key FROM orders WHERE o_custkey % 2 = 0")
def hide_masked_rows(spark, sf):
    from ..operators.binning import hide_masked

    a = order_series(spark, sf)
    a = a.assign_masks(odd=Quantity(F.col("c_customer") % 2 != 0, None, None, "bool"))
    return hide_masked(a, "order").df.select(F.col("order").alias("pos"), F.col("c_key").alias("key"))


@register("""SELECT p AS pos, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, 7.5::DOUBLE AS same, round(10 ** (p / 4.0::DOUBLE), 8) AS logs, round(2 * 8 ** (p / 8.0::DOUBLE), 8) AS geos, p * 86400 AS days FROM (SELECT unnest(range(9)) AS p)""")
def create_more(spark, sf):
    size = {"pos": 9}
    parts = {
        "zero": creation.zeros(spark, size), "one": creation.ones_like(creation.zeros(spark, size)), "same": creation.full_like(creation.empty(spark, size), 7.5), "logs": creation.logspace(spark, "pos", 0, 2, 9),
        "geos": creation.geomspace(spark, "pos", 2.0, 16.0, 9), "days": creation.datetimes(spark, "pos", [f"1970-01-{k + 1:02d}" for k in range(9)]),
    }
    out = None
    for n, x in parts.items():
        part = x.df.select("pos", (r("value", 8) if n in ("logs", "geos") else F.col("value")).alias(n))
        out = part if out is None else out.join(part, "pos")
    return out


@register("""WITH t AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT vec_id, round(x + 1, 6) AS tx, round(2 * x, 6) AS sx, round(y + x, 6) AS lx, round(y + x + 5, 6) AS ax, round(x, 6) AS back, round(-y, 6) + 0.0 AS turned, round(0.5, 6) AS angle FROM t""".replace("round(0.5, 6) AS angle", "0.5::DOUBLE AS angle"))
def vectors_more(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", spatial.as_vectors(*(F.get("embedding", F.lit(k)) for k in range(3))).alias("v"))
    v, one = F.col("v"), spatial.vector(1, 0, 0)
    linear = spatial.linear_transform([[1, 1, 0], [0, 1, 0], [0, 0, 2]])
    affine = spatial.affine_transform(linear, spatial.vector(5, 0, 0))
    half = float(np.sqrt(0.5))
    turn = spatial.rotation(F.lit(0.0), F.lit(0.0), F.lit(half), F.lit(half))
    angle = spatial.rotation_as_rotvec(spatial.rotations_from_rotvecs(spatial.vector(0, 0.5, 0)))["y"]
    found = {
        "tx": spatial.translated(v, one)["x"], "sx": spatial.transformed(spatial.scaling_from_vector(spatial.vector(2, 1, 1)), v)["x"], "lx": spatial.transformed(linear, v)["x"], "ax": spatial.affine_transformed(affine, v)["x"],
        "back": spatial.affine_transformed(spatial.affine_inverse(affine), spatial.affine_transformed(affine, v))["x"], "turned": spatial.rotated(turn, v)["x"], "angle": angle,
    }
    return e.select("vec_id", *(r(c, 6).alias(n) for n, c in found.items()))


# -- sizes beyond a few bins ------------------------------------------------------------------------------------------------------------


_MANY = np.round(900 + 100_000 * np.linspace(0, 1, 20_001) ** 1.5, 3)


@register("""WITH e AS (SELECT k, round(900 + 100000 * power(k / 20000.0::DOUBLE, 1.5), 3) AS edge FROM (SELECT unnest(range(20001)) AS k)), b AS (SELECT k AS bin, edge AS lo, lead(edge) OVER (ORDER BY k) AS hi FROM e)
SELECT bin, count(*) AS n FROM lineitem ASOF JOIN (SELECT * FROM b) b ON l_extendedprice >= lo WHERE hi IS NOT NULL AND l_extendedprice < hi GROUP BY 1""")
def hist_many_uneven_bins(spark, sf):
    a = table(read(spark, sf, "lineitem"), coords={"price": (F.col("l_extendedprice"), "counts")})
    return a.bin(price=_MANY).size().df.where("value > 0").select(F.col("price").alias("bin"), F.col("value").alias("n"))


@register("SELECT floor(l_extendedprice / 0.25)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice >= 0 AND l_extendedprice < 131072 GROUP BY 1")
def hist_many_even_bins(spark, sf):
    a = table(read(spark, sf, "lineitem"), coords={"price": (F.col("l_extendedprice"), "counts")})
    return a.bin(price=np.linspace(0, 131_072, 2**19 + 1)).size().df.where("value > 0").select(F.col("price").alias("bin"), F.col("value").alias("n"))


@register("SELECT l_orderkey AS key, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def group_many_labels(spark, sf):
    a = table(read(spark, sf, "lineitem"), value=F.col("l_extendedprice"), coords={"key": (F.col("l_orderkey"), None)})
    b = a.group(key=None)
    return b.sum().df.join(b.size().df.select("key", F.col("value").alias("n")), "key").select(F.col("c_key").alias("key"), "n", r("value", 2).alias("total"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 125000 THEN floor(l_extendedprice / 0.125)::DOUBLE * 2 ELSE -1 END AS v FROM lineitem")
def lookup_million_entries(spark, sf):
    n = 1_000_000
    entries = creation.arange(spark, "price", 0, 2 * n, 2, dtype="float64").assign_coords(price=Coord(("price",), ONE, "float64", np.arange(n + 1) * 0.125))
    found = lookup(entries, "price", fill_value=-1.0)[Quantity(F.col("l_extendedprice"))]
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.value.alias("v"))


@register("SELECT event_id, floor(value)::BIGINT AS whole, ceil(value)::BIGINT AS up FROM events WHERE value IS NOT NULL")
def array_methods(spark, sf):
    a = table(read(spark, sf, "events").where("value IS NOT NULL"), value=F.col("value"), coords={"id": (F.col("event_id"), None)})
    down, up = DataGroup({"a": a}).floor()["a"], a.ceil()
    return down.df.select(F.col("c_id").alias("event_id"), F.col("value").cast("long").alias("whole")).join(up.df.select(F.col("c_id").alias("event_id"), F.col("value").cast("long").alias("up")), "event_id")


@register("SELECT l_orderkey, l_linenumber, round(2 * l_extendedprice, 2) AS twice FROM lineitem")
def same_frame_arithmetic(spark, sf):
    a = table(read(spark, sf, "lineitem"), value=F.col("l_extendedprice"), coords={"key": (F.col("l_orderkey"), None), "line": (F.col("l_linenumber"), None)})
    return (a + a).df.select(F.col("c_key").alias("l_orderkey"), F.col("c_line").alias("l_linenumber"), r("value", 2).alias("twice"))
