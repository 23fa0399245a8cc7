"""Quality rules: base rules on words, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams (one and two words) are estimated: the raw one from every document of the corpus,
the trusted one from trusted documents. A document's score is the mean over its n-grams of the log of trusted over raw
probability, so it does not grow with length. One fixed threshold decides for every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, checkpointed, slices, table, tidy, utf8, wider
from .words import windows, word_hashes

#: Buckets of the hashed n-grams: bounds the model that executors get, whatever the corpus holds.
BUCKETS = 1 << 14
ORDERS = (1, 2)
#: Up to so many trusted ids (8 bytes each) are broadcast, more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Documents below this mean log-likelihood ratio go.
THRESHOLD = -0.07
#: Bytes of text that are worked through at once.
BLOCK = 1 << 20
#: Pseudo-counts of the trusted multinomial, spread like the raw one.
PRIOR_COUNT = 200_000.0

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def buckets(text: bytes, before: list[bytes] | None = None) -> np.ndarray:
    """Buckets of the n-grams that end in ``text``, which follows the words ``before``."""
    before = before or []
    hashes = word_hashes([*before, *text.split()])
    return np.concatenate([windows(hashes[max(0, len(before) - n + 1) :], n) % np.uint64(BUCKETS) for n in ORDERS]).astype(np.int64)


def text_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of a whole text by stretches; an n-gram across a cut counts to the later one."""
    before: list[bytes] = []
    most = max(ORDERS) - 1
    for piece in stretches(text):
        yield buckets(piece, before)
        before = [*before, *piece.rsplit(None, most)[-most:]][-most:]


def base_features(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, SPACES))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(word_hashes(words))


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that the text has twice or more, the first included."""
    grams = windows(hashes, width)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def trusted_rows(labels: DataFrame) -> DataFrame:
    """The ``doc_id`` of every trusted document, once."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()


def trusted_ids(labels: DataFrame) -> list[int]:
    """The ids of ``trusted_rows`` as a list, for small tables."""
    return [x[0] for x in trusted_rows(labels).collect()]


def fit(docs: DataFrame, trusted: DataFrame | list[int]) -> np.ndarray:
    """The log-likelihood ratio of each bucket. Counts cover every document and every trusted one; each task sends at most ``BUCKETS`` sums."""
    if not isinstance(trusted, DataFrame):
        trusted = docs.sparkSession.createDataFrame([(x,) for x in trusted], "doc_id long")
    known = checkpointed(trusted.select("doc_id").distinct()).select("doc_id", F.col("doc_id").alias("known"))
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches, "text", BLOCK):
            is_good = pc.is_valid(part.column(0)).to_numpy(zero_copy_only=False)
            found = [(trust, at) for text, trust in zip(utf8(part.column(1)), is_good, strict=True) for at in text_buckets(text)]
            raw += np.bincount(np.concatenate([x for _, x in found]), minlength=BUCKETS)
            good += np.bincount(np.concatenate([x for trust, x in found if trust] or [np.empty(0, np.int64)]), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    marked = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id", "left")
    counts = marked.select("known", "text").mapInArrow(tidy(count, "words"), "bucket long, raw long, good long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.ones(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, g in rows:
        raw[bucket] += r
        good[bucket] = g
    share = raw / raw.sum()
    return np.log((good + PRIOR_COUNT * share) / (good.sum() + PRIOR_COUNT) / share) if good.sum() else np.zeros(BUCKETS)


def stretches(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in stretches of about ``size`` bytes that end at a space: bounds the memory of counting."""
    start = 0
    while len(text) - start > 2 * size:
        stop = text.find(b" ", start + size)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def quality_rules(docs: DataFrame, trusted: DataFrame | list[int], threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text`` and any others) with what the rules found beside it.

    A null or empty text has no words, a score of 0 and fails the base rules (fewer than 10 words). Repeated rows each keep
    their row. A null id is never trusted. Columns of ``docs`` named like an added one are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted))
    added = [x.split()[0] for x in ADDED.split(", ")]
    rest = docs.drop(*added)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.value
        for part in slices(batches, "text", BLOCK):
            rows = []
            for text in utf8(part.column(part.schema.get_field_index("text"))):
                found = base_features(text)
                total = grams = 0
                for at in text_buckets(text):
                    total, grams = total + math.fsum(weight[at]), grams + len(at)
                llr = round(total / grams, 9) if grams else 0.0
                failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEAT_PERCENT * found[0]
                rows.append((*found, failed, llr, not failed and llr >= threshold))
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *added])

    return rest.mapInArrow(tidy(score, "words"), wider(rest.schema, ADDED))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted_rows(table(spark, sf_dir, "labels"))).drop("text")
