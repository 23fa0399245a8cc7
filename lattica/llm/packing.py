"""Cost-balanced packing of tokenised documents into sequences.

The cost of a sequence is linear in its tokens plus quadratic in each piece (a piece attends within itself). Documents are
taken in blocks of neighbouring rows; within a block they go, longest first, each to the lowest-cost sequence that still has
room for it. The sequences of a block hold exactly its tokens: as many full ones as fit, and for the rest one for each power
of two in its binary form, so nothing is padded. What fits nowhere whole is cut over the largest gaps.

Blocks never leave their task: no shuffle, and a lost executor repeats its own partitions only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy
from .token_counts import BLOCK, encoder, tokenizer_path

SEQUENCE_TOKENS = 4096
#: Tokens that are packed together; a task holds no more ids than this and one document more.
BLOCK_TOKENS = 2_000_000
#: Of the cost: per token, and per squared token of a piece.
LINEAR, QUADRATIC = 1.0, 1 / 2048


def capacities(total: int, size: int) -> np.ndarray:
    """Room of the sequences for ``total`` tokens: full ones, then the powers of two of what is left."""
    rest = total % size
    return np.array([size] * (total // size) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], dtype=np.int64)


def pack(lengths: list[int], size: int = SEQUENCE_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with so many tokens each; ties keep their order."""
    room = capacities(sum(lengths), size)
    cost, used, pieces = np.zeros(len(room)), np.zeros(len(room), np.int64), []

    def put(document: int, start: int, length: int, sequence: int) -> None:
        pieces.append((document, start, length, sequence, int(used[sequence])))
        used[sequence] += length
        room[sequence] -= length
        cost[sequence] += linear * length + quadratic * length * length

    items, next_full = [], 0
    for k, n in enumerate(lengths):
        start = 0
        while n - start >= size:  # a long document fills sequences of its own
            put(k, start, size, next_full)
            next_full, start = next_full + 1, start + size
        if n > start:
            items.append((n - start, k, start))
    items.sort(key=lambda x: (-x[0], x[1]))
    left = []
    for n, k, start in items:
        fits = room >= n
        best = int(np.where(fits, cost, np.inf).argmin()) if len(room) else 0
        if fits[best]:
            put(k, start, n, best)
        else:
            left.append((n, k, start))
    for n, k, start in left:
        while n:
            most = int(room.argmax())
            length = min(n, int(room[most]))
            put(k, start, length, most)
            n, start = n - length, start + length
    return pieces


SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, sequence_tokens: int = SEQUENCE_TOKENS, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece of every document: where it comes from, where it lies, and (``with_ids``) its ids.

    ``sequence_tokens`` on a row is what its sequence holds: the full size, or a power of two at a block's end. A null or
    empty text is its end token alone; repeated rows and null ids are documents of their own; other columns are ignored.
    ``sequence_id`` carries the partition above bit 33 and is unique in the result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(id=kind) + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer)).ids
        base = TaskContext.get().partitionId() << 33
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, base
            pieces = np.array(pack(list(map(len, ids)), sequence_tokens), np.int64)
            doc, start, length, sequence, offset = pieces.T
            total = np.bincount(sequence, length)
            spent = np.bincount(sequence, LINEAR * length + QUADRATIC * length**2)
            cut = [ids[k][s:e] for k, s, e in zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
            sizes = np.array(list(map(len, ids)), np.int64)
            columns = [
                pa.array(keys, arrow_id).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(map(zlib.crc32, cut), pa.int64()), pa.array(sizes[doc]),
                pa.array(base + sequence), pa.array(offset), pa.array(total[sequence].astype(np.int64)), pa.array(spent[sequence]),
            ]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cut).view("<i4"))))
            base += len(total)
            keys, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for part in slices(batches, "text", BLOCK):
            arrow_id = part.column(0).type
            flat, sizes = encode(part.column("text"))
            ends = np.cumsum(sizes) + np.arange(1, len(sizes) + 1)
            marked = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(marked), bool)
            inside[ends - 1] = False
            marked[inside] = flat
            for key, a, b in zip(part.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                keys.append(key)
                ids.append(marked[a:b])
                held += b - a
                if held >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, "encoders"), schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), with_ids=False)
