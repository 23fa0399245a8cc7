"""Token counts: batch encoding in Arrow functions that return lengths only.

A vocabulary whose tokens end at white space and that ignores case lets a text be cut at any ASCII space or line feed without
changing its tokens. Each byte-balanced block of texts is cut there by Arrow, its distinct words go to the library in one batch,
and what the library said is kept for later blocks of the same worker in a table of bounded bytes. Every other vocabulary gets
whole texts, in byte-balanced batches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, remembers, slices, strings, table, tidy

#: Letters that stand for themselves in every normal form, then marks that open no contraction and no special string.
PLAIN = r"^(?P<stem>[a-zA-ZÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=?@\[-`{|}~]*)$"
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Longer texts are encoded in stretches of about so many characters that end at a safe boundary.
STRETCH_CHARS = 1 << 20
#: So many plain words are encoded as one text.
JOINED = 64

#: Bytes of text that are cut into words at once.
BLOCK = 2 << 20

_ENCODERS: dict[tuple[str, bool], SegmentEncoder] = {}
remembers("encoders", _ENCODERS.clear)


class SegmentEncoder:
    """Tokens of blocks of texts: their counts, or their ids too."""

    def __init__(self, path: str, lengths_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_word = ends_at_space(tokenizer)
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: processor.encode(texts, num_threads=1)
        if self.by_word:
            vocabulary, suffix = tokenizer.get_vocab(), tokenizer.model.end_of_word_suffix
            self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.is_last[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
        self.lengths_only, self.known = lengths_only, Recent()

    def parts(self, words: list[str]) -> list:
        """The ids of each word as little-endian bytes, or only how many they are."""
        letters = [x for x in words if LETTERS.fullmatch(x)]
        flat = flat_ids(self.encode([" ".join(letters[k : k + JOINED]) for k in range(0, len(letters), JOINED)]))
        ends = np.flatnonzero(self.is_last[flat]) + 1
        if len(ends) != len(letters):  # not one word end in each: then one by one
            letters, flat, ends = [], flat[:0], ends[:0]
        found = dict(zip(letters, self._values(flat, ends), strict=True))
        if rest := [x for x in words if x not in found]:
            said = self.encode(rest)
            found.update(zip(rest, self._values(flat_ids(said), np.cumsum(list(map(len, said)))), strict=True))
        return [found[x] for x in words]

    def _values(self, flat: np.ndarray, ends: np.ndarray) -> list:
        if self.lengths_only:
            return np.diff(ends, prepend=0).tolist()
        data, ends = flat.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _block(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Ends of rows in the block's words, each word's number, the numbers of each distinct word's two parts, what is known of the parts.

        A word of plain letters with marks behind it has the tokens of the letters, whatever their case, and those of the
        marks; such parts repeat far more often than whole words do.
        """
        cut = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        split = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(split)
        stem = pc.if_else(plain, pc.utf8_lower(pc.struct_field(split, "stem")), words)
        marks = pc.if_else(plain, pc.struct_field(split, "marks"), pa.scalar("", words.type))
        both = pa.concat_arrays([stem, marks]).dictionary_encode()
        numbers = both.indices.to_numpy()
        said = self.known.look_up(both.dictionary.to_numpy(zero_copy_only=False).tolist(), self.parts)
        ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        return ends, coded.indices.to_numpy(), numbers[: len(words)], numbers[len(words) :], said

    def count(self, text: pa.Array | list[str]) -> np.ndarray:
        """Tokens of each text; null has none."""
        if not self.by_word:
            return np.array([len(x) for x in self.encode(strings(pa.array(text) if isinstance(text, list) else text))], np.int64)
        found = []
        for block in blocks(text):
            ends, codes, stem, marks, said = self._block(block)
            size = np.array(said, np.int64) if self.lengths_only else np.array(list(map(len, said)), np.int64) // 4
            found.append(_per_row((size[stem] + size[marks])[codes], ends))
        return _joined(found, len(text))

    def ids(self, text: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, row after row, as unsigned 32-bit integers, and how many each row has."""
        if not self.by_word:
            said = self.encode(strings(pa.array(text) if isinstance(text, list) else text))
            return flat_ids(said), np.array(list(map(len, said)), np.int64)
        found, flat = [], [np.empty(0, "<u4")]
        for block in blocks(text):
            ends, codes, stem, marks, said = self._block(block)
            size = np.array(list(map(len, said)), np.int64) // 4
            start = np.cumsum(size) - size
            words = gather(np.frombuffer(b"".join(said), "<u4"), np.stack([start[stem], start[marks]], 1).ravel(), np.stack([size[stem], size[marks]], 1).ravel())
            size = size[stem] + size[marks]
            flat.append(gather(words, (np.cumsum(size) - size)[codes], size[codes]))
            found.append(_per_row(size[codes], ends))
        return np.concatenate(flat), _joined(found, len(text))


def ends_at_space(tokenizer) -> bool:
    """Whether the vocabulary ends tokens at white space, drops it and ignores case, so that words can be encoded apart."""
    import json

    spec = json.loads(tokenizer.to_str())
    normal, before, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    lowers = any(x["type"] == "Lowercase" for x in normal.get("normalizers", [normal]) if x)
    first = before.get("pretokenizers", [before])[0]
    drops = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and all(x in first["pattern"].get("Regex", "") for x in (r"[\p{L}]+", r"[^\s\p{L}"))
    return bool(lowers and drops and model["type"] == "BPE" and model.get("end_of_word_suffix"))


def flat_ids(said: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(said), "<u4")


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``data`` one after another."""
    ends = np.cumsum(size)
    at = np.repeat((start - ends + size).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return data[at]


def _per_row(sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(total[ends], prepend=0)


def _joined(found: list[np.ndarray], rows: int) -> np.ndarray:
    """Counts of rows from those of their blocks: one block of all rows, or several of a single one."""
    return found[0] if len(found) == 1 and len(found[0]) == rows else np.array([sum(int(x.sum()) for x in found)] * rows, np.int64)


def blocks(text: pa.Array | list[str]) -> Iterator[pa.Array]:
    """The texts as they are, null as empty; of a single long one its stretches."""
    text = pc.fill_null(pa.array(text, pa.string()) if isinstance(text, list) else text, "")
    if len(text) == 1 and pc.binary_length(text)[0].as_py() > 4 * STRETCH_CHARS:
        for piece in stretches(text[0].as_py()):
            yield pa.array([piece], text.type)
    elif len(text):
        yield text


def stretches(text: str, size: int = STRETCH_CHARS) -> Iterator[str]:
    """The text in stretches of about ``size`` characters, cut before a space only."""
    start = 0
    while start < len(text):
        stop = text.find(" ", start + size)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop]
        start = stop


def encoder(path: str, lengths_only: bool = False) -> SegmentEncoder:
    if (path, lengths_only) not in _ENCODERS:
        _ENCODERS[path, lengths_only] = SegmentEncoder(path, lengths_only)
    return _ENCODERS[path, lengths_only]


def tokenizer_path(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    A null or empty text has no bytes and no tokens; repeated rows and null ids each keep a row; other columns are ignored.
    Special strings inside a text are handled as the library does by default.
    """
    ids = docs.schema[id_column].dataType

    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(tokenizer_path(tokenizer), lengths_only=True)
        for part in slices(batches, "text", BLOCK):
            text = part.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(counter.count(text))], ["id", "n_bytes", "n_tokens"])

    out = picked.mapInArrow(tidy(run, "encoders"), f"id {ids.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
