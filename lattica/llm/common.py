"""Shared plumbing of the training-data operators: byte-bounded Arrow blocks, cut lineage, table reading."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python works through text in blocks of about this many bytes, whatever the Arrow batch size, so that memory stays bounded.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one (a test) gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The shuffle files that led to it are needed no more; Spark drops them when the driver collects its garbage, so it does.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def some_of(rows: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows whose ``key`` is in ``ids(key)``: by broadcast if there are at most ``most`` ids (8 bytes each), else by shuffle."""
    ids = checkpointed(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, key, "left_semi")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``column`` holds about ``limit`` bytes; a longer text is a run of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def wider(schema: T.StructType, added: str) -> T.StructType:
    """A new schema with the columns ``added`` ("name type, ...") at its end."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(added).fields])


#: How to forget what a worker remembers for an operator, by the name of what is remembered.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[name] = forget


def forget_others(name: str) -> None:
    for other, forget in _REMEMBERED.items():
        if other != name:
            forget()


def give_back() -> None:
    """Hand memory that was freed, but is kept for later by Arrow and by the C library, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembered: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, in a worker that outlives its tasks: of the tables that operators remember only ``remembered`` stays, and memory freed by the task goes back when it ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(remembered)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


class Recent:
    """What a worker remembers of keys, in at most about ``most_bytes`` bytes.

    There are two generations: a key that is used again moves to the younger one; when that holds half of the bytes it becomes
    the older one, which goes. Long keys are not remembered.
    """

    LONGEST, EACH = 64, 200

    def __init__(self, most_bytes: int = 48 << 20):
        self.most_bytes, self.held = most_bytes, 0
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list, find: Callable[[list], list]) -> list:
        """The value of each key; ``find`` gives those of new keys, each named once."""
        got = list(map(self.young.get, keys))
        if None in got:
            holes = [k for k, v in enumerate(got) if v is None]
            found = {keys[k]: self.old.get(keys[k]) for k in holes}
            if new := [x for x, v in found.items() if v is None]:
                found.update(zip(new, find(new), strict=True))
            for k in holes:
                got[k] = found[keys[k]]
            kept = found if max(map(len, found)) <= self.LONGEST else {x: v for x, v in found.items() if len(x) <= self.LONGEST}
            self.young.update(kept)
            self.held += self.EACH * len(kept) + sum(map(len, kept)) + (sum(map(len, kept.values())) if isinstance(next(iter(kept.values()), None), bytes) else 0)
            if self.held > self.most_bytes // 2:
                self.young, self.old, self.held = {}, self.young, 0
        return got


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
