"""Reading and writing: CSV with units in its header, Parquet with a JSON sidecar, pandas, dicts, Arrow bytes."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.quantity import KINDS
from ..operators.array import Coord, LabelledArray, renumbered
from ..operators.groups import Dataset
from ..units import Unit, unit_of

_HEADER = re.compile(r"^(.*?)(?:\s*\[([^\[\]]*)\])?\s*$", re.S)


def parse_bracket_header(head: str) -> tuple[str, Unit | None]:
    """``"name [unit]"`` to name and unit; empty brackets are dimensionless, none at all no unit."""
    name, unit = _HEADER.match(head).groups()
    return name, None if unit is None else Unit(unit.strip() or "one")


def load_csv(spark: SparkSession, path: str, sep: str = ",", data_columns: list[str] | None = None, header: bool = True) -> Dataset:
    """Columns named in ``data_columns`` (all by default) are items, the others coordinates; rows are numbered as they stand in the files.

    Spark reads in parallel; a schema job comes first.
    """
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    heads = {c: parse_bracket_header(c) for c in df.columns}
    data = [c for c in df.columns if data_columns is None or heads[c][0] in data_columns]
    columns = [F.col(f"`{c}`").alias(f"v{k}" if c in data else f"c_{heads[c][0]}") for k, c in enumerate(df.columns)]
    rows = renumbered(df.select(F.monotonically_increasing_id().alias("row"), *columns), "row")
    size, kinds = rows.count(), {f.name: KINDS.get(f.dataType.simpleString(), "string") for f in rows.schema.fields}
    coords = {heads[c][0]: Coord(("row",), heads[c][1], kinds[f"c_{heads[c][0]}"]) for c in df.columns if c not in data}
    item = lambda k, name, unit: LabelledArray(rows.select("row", F.col(f"v{k}").alias("value"), *(f"c_{n}" for n in coords)), ("row",), {"row": size}, coords, {}, unit, kinds[f"v{k}"], False, name)
    return Dataset({heads[c][0]: item(k, *heads[c]) for k, c in enumerate(df.columns) if c in data})


def describe(x: LabelledArray) -> dict:
    coord = lambda c: {"dims": c.dims, "unit": None if c.unit is None else str(c.unit), "dtype": c.dtype, "aligned": c.aligned, "edges": None if c.edges is None else c.edges.tolist()}
    return {"dims": x.dims, "sizes": x.sizes, "unit": None if x.unit is None else str(x.unit), "dtype": x.dtype, "has_variance": x.has_variance, "name": x.name, "masks": x.masks, "coords": {n: coord(c) for n, c in x.coords.items()}}


def _built(df, meta: dict) -> LabelledArray:
    coords = {n: Coord(tuple(c["dims"]), unit_of(c["unit"]), c["dtype"], None if c["edges"] is None else np.array(c["edges"]), c["aligned"]) for n, c in meta["coords"].items()}
    return LabelledArray(df, tuple(meta["dims"]), dict(meta["sizes"]), coords, {m: tuple(d) for m, d in meta["masks"].items()}, unit_of(meta["unit"]), meta["dtype"], meta["has_variance"], meta["name"])


def save(x: LabelledArray, path: str) -> None:
    """Parquet data, and the metadata as one JSON row beside it; Spark writes both, so any store that it knows will do."""
    x.df.write.mode("overwrite").parquet(f"{path}/data")
    x.df.sparkSession.createDataFrame([(json.dumps(describe(x)),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> LabelledArray:
    return _built(spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0]))


def serialize(x: LabelledArray) -> bytes:
    """Data and metadata in one Arrow stream; for arrays that fit the driver."""
    rows = x.df.toArrow().replace_schema_metadata({"meta": json.dumps(describe(x))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def deserialize(spark: SparkSession, data: bytes) -> LabelledArray:
    rows = pa.ipc.open_stream(data).read_all()
    return _built(spark.createDataFrame(rows.replace_schema_metadata(None)), json.loads(rows.schema.metadata[b"meta"]))


def from_pandas(spark: SparkSession, frame: pd.DataFrame | pd.Series, data_columns: list[str] | None = None, include_trivial_index: bool = False) -> Dataset:
    """The index becomes a coordinate unless it just counts rows."""
    frame = frame.to_frame(name=frame.name or "") if isinstance(frame, pd.Series) else frame
    trivial = isinstance(frame.index, pd.RangeIndex) and frame.index.start == 0 and frame.index.step == 1
    dim = frame.index.name or "row"
    data = pd.DataFrame({dim: np.arange(len(frame), dtype=np.int64)} | {f"v{k}": frame[c].to_numpy() for k, c in enumerate(frame.columns)})
    if not trivial or include_trivial_index:
        data["c_index"] = frame.index.to_numpy()
    df = spark.createDataFrame(data)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), "string") for f in df.schema.fields}
    heads = [parse_bracket_header(str(c)) for c in frame.columns]
    is_data = [data_columns is None or n in data_columns for n, _ in heads]
    coords = {n: Coord((dim,), u, kinds[f"v{k}"]) for k, (n, u) in enumerate(heads) if not is_data[k]}
    columns = [F.col(f"v{k}").alias(f"c_{n}") for k, (n, _) in enumerate(heads) if not is_data[k]]
    if "c_index" in data:
        coords[dim], columns = Coord((dim,), None, kinds["c_index"]), [*columns, F.col("c_index").alias(f"c_{dim}")]
    return Dataset({n: LabelledArray(df.select(dim, F.col(f"v{k}").alias("value"), *columns), (dim,), {dim: len(frame)}, coords, {}, u, kinds[f"v{k}"], False, n) for k, (n, u) in enumerate(heads) if is_data[k]})


def to_dict(x: LabelledArray) -> dict:
    """Metadata and columns; for arrays that fit the driver."""
    return describe(x) | {"data": x.df.toPandas().to_dict("list")}


def from_dict(spark: SparkSession, d: dict) -> LabelledArray:
    return _built(spark.createDataFrame(pd.DataFrame(d["data"])), {k: v for k, v in d.items() if k != "data"})
