"""Quality classifier by compression: a text is like the class whose zstandard dictionary shrinks it further.

One dictionary is built from good and one from bad labelled texts. A whole text is cut into short chunks that are compressed
apart, so that the dictionary counts to its end. The difference of the two compressed sizes over the larger one is all that
the score knows of a text; logistic regression on other labelled rows calibrates it to a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, slices, table, tidy, utf8, wider

CHUNK_BYTES, LEVEL, DICTIONARY_BYTES = 256, 3, 110 << 10
#: Fitted on at most so many labelled rows of each class (those with the smallest hash of their id), a longer text by about so many bytes in pieces spread over all of it; every second row goes into a dictionary, the others calibrate.
FIT_ROWS, FIT_BYTES = 3000, 32 << 10
#: Chunks of one text that go into a dictionary, spread over it.
DICTIONARY_CHUNKS = 32
#: With fewer labelled rows of a class than these there is no model.
LEAST_ROWS = 8
KEEP_AT, HELD_OUT, SEED = 0.7, 2, 1


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    level: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.compressors = []
        for content in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, text: bytes) -> float:
        """How much smaller the good dictionary makes the text, as a share of the larger size; 0 for an empty one."""
        good, bad = (sum(len(x.compress(text[i : i + CHUNK_BYTES])) for i in range(0, len(text) or 1, CHUNK_BYTES)) for x in self.compressors)
        return (bad - good) / max(good, bad)

    def score(self, texts: list[bytes]) -> np.ndarray:
        found = np.array([self.difference(x) if self.model.slope else 0.0 for x in texts])
        return 1 / (1 + np.exp(-np.clip(self.model.slope * found + self.model.level, -40, 40)))


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Rows at even places of each class make its dictionary, those at odd places calibrate."""
    by = {v: [t for t, y in zip(texts, labels, strict=True) if y == v] for v in (0, 1)}
    if min(map(len, by.values())) < LEAST_ROWS:
        return untrained(len(by[1]), len(by[0]))
    model = trained({v: list(map(dictionary_chunks, rows[::2])) for v, rows in by.items()})
    scorer = Scorer(model)
    return calibrated(model, {v: [scorer.difference(t) for t in rows[1::2]] for v, rows in by.items()})


def untrained(good: int, bad: int) -> Model:
    return Model(b"", b"", 0.0, float(np.log((good + 1) / (bad + 1))))


def trained(content: dict[int, list[bytes]]) -> Model:
    """The dictionaries of both classes, from the ``dictionary_chunks`` of their rows."""
    found = {}
    for v, rows in content.items():
        chunks = [t[i : i + CHUNK_BYTES] for t in rows for i in range(0, len(t), CHUNK_BYTES)]
        chunks = [chunks[k] for k in np.random.default_rng(SEED).permutation(len(chunks))]  # the trainer takes a stretch of chunks for like ones
        try:
            found[v] = zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            found[v] = b"".join(chunks)[-DICTIONARY_BYTES:] or b" "
    return Model(found[1], found[0], 0.0, 0.0)


def calibrated(model: Model, differences: dict[int, list[float]]) -> Model:
    x, y = np.array([*differences[0], *differences[1]]), np.repeat([0, 1], [len(differences[0]), len(differences[1])])
    spread = float(x.std()) or 1.0
    columns, weights = np.stack([x / spread, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(40):  # Newton's method, with a slight pull to zero
        p = 1 / (1 + np.exp(-np.clip(columns @ weights, -40, 40)))
        step = np.linalg.solve((columns.T * (p * (1 - p))) @ columns + 0.1 * np.eye(2), columns.T @ (y - p) - 0.1 * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return model._replace(slope=float(weights[0]) / spread, level=float(weights[1]))


def spread_starts(size: int) -> list[int]:
    """Starts of at most ``DICTIONARY_CHUNKS`` chunks of a text of ``size`` bytes, from its first to its last."""
    starts = range(0, size, CHUNK_BYTES)
    most = DICTIONARY_CHUNKS - 1
    return list(starts) if len(starts) <= most + 1 else [starts[k * (len(starts) - 1) // most] for k in range(most + 1)]


def dictionary_chunks(text: bytes) -> bytes:
    """What of a text goes into a dictionary; only its last chunk may be a short one."""
    return b"".join(text[i : i + CHUNK_BYTES] for i in spread_starts(len(text)))


def spread_text(text: bytes) -> bytes:
    """A text of at most ``FIT_BYTES`` bytes as it is; of a longer one as many pieces of whole characters as make that, evenly spread over it."""
    if len(text) <= FIT_BYTES:
        return text
    pieces, block = FIT_BYTES // CHUNK_BYTES, 1 << 16
    first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80  # of each character
    upto = np.cumsum(np.add.reduceat(first, np.arange(0, len(first), block), dtype=np.int64))
    length = int(upto[-1])
    size = max(1, length * CHUNK_BYTES // len(text))

    def at(char: int) -> int:
        if char >= length:
            return len(text)
        k = int(np.searchsorted(upto, char, side="right"))
        return k * block + int(np.flatnonzero(first[k * block : (k + 1) * block])[char - (int(upto[k - 1]) if k else 0)])

    starts = [k * (length - size) // (pieces - 1) for k in range(pieces)]
    return b"".join(text[at(x) : at(x + size)] for x in starts)


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, quality, text`` of the bounded sample of labelled, not held-out documents; of repeated ids one text, of long texts what ``spread_text`` takes."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out("doc_id"))
    picked = None
    for v in (0, 1):
        part = known.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.union(part)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(spread_text, utf8(part.column(2)))), pa.binary()).cast(part.schema.types[2])], part.schema.names)

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    return texts.mapInArrow(tidy(shorten), texts.schema).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[bytes], list[int]]:
    """The texts of ``fit_sample`` and their labels on the driver, in a fixed order."""
    found = fit_sample(docs, labels, rows).collect()  # one text for each of at most 2 * rows ids
    found.sort(key=lambda r: (r.quality, r.doc_id, r.text))
    return [r.text.encode() for r in found], [r.quality for r in found]


def fit_tables(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model that ``fit(*fit_rows(docs, labels, rows))`` gives, without the texts on the driver.

    It gets the chunks for the dictionaries, at most ``DICTIONARY_CHUNKS * CHUNK_BYTES`` bytes of every second row, and a number
    for each of the others, which executors compress.
    """
    sample = checkpointed(fit_sample(docs, labels, rows))
    ids = sorted((r.quality, r.doc_id) for r in sample.select("quality", "doc_id").collect())
    by = {v: [x for y, x in ids if y == v] for v in (0, 1)}
    if min(map(len, by.values())) < LEAST_ROWS:
        return untrained(len(by[1]), len(by[0]))

    def of_rows(picked: dict[int, list], made: Callable[[], Callable[[bytes], object]], kind: str) -> dict[int, list]:
        """What ``made()`` finds in the texts with these ids, in their order."""
        wanted = {x for own in picked.values() for x in own}
        out = pa.binary() if kind == "binary" else pa.float64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = made()
            for part in slices(batches, "text"):
                part = part.filter(pa.array([x in wanted for x in part.column(0).to_pylist()], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([find(x) for x in utf8(part.column(2))], out)], ["doc_id", "found"])

        kinds = T.StructType([sample.schema["doc_id"], T.StructField("found", T._parse_datatype_string(kind))])
        found = {r.doc_id: r.found for r in sample.mapInArrow(tidy(run), kinds).collect()}
        return {v: [found[x] for x in own] for v, own in picked.items()}

    content = of_rows({v: own[::2] for v, own in by.items()}, lambda: dictionary_chunks, "binary")
    model = trained({v: list(map(bytes, own)) for v, own in content.items()})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return calibrated(model, of_rows({v: own[1::2] for v, own in by.items()}, lambda: Scorer(shared.value).difference, "double"))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string")) % 4 == HELD_OUT


def classify(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``predicted`` beside it (columns of those names are replaced).

    Null and empty texts are scored as the empty text; repeated rows each keep their row. Without eight labelled texts of
    each class every score is the labels' own share of good ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            score = scorer.score(utf8(part.column(part.schema.get_field_index("text")))).round(9)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= keep_at).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return rest.mapInArrow(tidy(run), wider(rest.schema, "score double, predicted int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_tables(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
