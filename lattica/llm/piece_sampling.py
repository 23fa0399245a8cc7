"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The piece lattice of a text falls apart before each space and around each line feed, for no piece goes across them. Forward
filtering gives every lattice node the probabilities of its incoming pieces; backward sampling walks from the end of each unit
to its start, for all units of a block of texts at once. Random numbers are hashes of the row's key, the unit's place in the
row and the step, so a row gets the same pieces wherever and whenever it is encoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, remembers, slices, table, tidy, utf8, wider
from .token_counts import tokenizer_path

UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Units whose lattices a worker remembers, and the nodes (characters, some 50 bytes each) that these may have.
REMEMBERED, REMEMBERED_NODES = 300_000, 4_000_000
#: Bytes of text that are sampled at once.
BLOCK = 2 << 20
#: Weight of a piece: its score in a unigram model; in a merge model, whose scores are ranks, that of Zipf's law. Times ALPHA.
ALPHA = 1.0
#: A character without a piece of its own is spelled in bytes, at this log weight each.
BYTE_WEIGHT = -12.0

_LATTICES: dict[tuple[str, float], Lattices] = {}
remembers("lattices", _LATTICES.clear)


HASHED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: int) -> int:
    return int(mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])


class Lattices:
    """The lattices of known units, end to end in flat arrays: a node's edges follow one another with their cumulative probabilities."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k))]
        scores = np.array([model.get_score(k) for k in normal])
        ranks = bool(len(scores)) and scores.max() > -10 and scores.min() < -1000  # merge ranks, not log probabilities
        weights = -np.log(np.clip(-scores, 0, size) + 2) if ranks else scores
        self.pieces = {model.id_to_piece(k).replace("▁", " "): (k, alpha * float(w)) for k, w in zip(normal, weights, strict=True)}
        self.longest = max(map(len, self.pieces))
        self.weight = np.zeros(size)
        begun: dict[int, int] = {}  # the hash of each beginning of a piece to the piece it is, or -1
        for piece, (k, w) in self.pieces.items():
            self.weight[k] = w
            key = 0
            for n, c in enumerate(piece, 1):
                key = _mix(key * int(HASHED) + ord(c) + 1)
                begun[key] = k if n == len(piece) else begun.get(key, -1)
        self.heads = np.array(sorted(begun), np.uint64)
        self.head_piece = np.array([begun[x] for x in sorted(begun)], np.int64)
        self.bytes = {int(model.id_to_piece(k)[1:-1], 16): k for k in range(size) if model.is_byte(k)}
        self.byte_weight = alpha * BYTE_WEIGHT
        self.spelled = [b""] * size
        for piece, (k, _) in self.pieces.items():
            self.spelled[k] = piece.encode()
        for b, k in self.bytes.items():
            self.spelled[k] = bytes([b])
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.nodes = 0
        self.cumulative, self.first, self.before, self.piece = np.empty(0, np.float32), *(np.empty(0, np.int32) for _ in range(3))

    def learn(self, units: list[str]) -> None:
        """The lattices of new units, all at once, and forward filtering: each edge's share of the ways to its node."""
        sizes = np.array([len(u) for u in units], np.int64)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        last = np.repeat(np.cumsum(sizes), sizes)  # the end of each character's unit
        # Pieces that begin at a character: longer and longer ones, as long as some piece begins like that.
        at, key = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        starts, lengths, found = [], [], []
        for n in range(1, self.longest + 1):
            at, key = at[(inside := at + n <= last[at])], key[inside]
            key = mix64(key * HASHED + chars[at + n - 1] + np.uint64(1))
            slot = np.minimum(np.searchsorted(self.heads, key), len(self.heads) - 1)
            alike = self.heads[slot] == key
            at, key, slot = at[alike], key[alike], slot[alike]
            piece = self.head_piece[slot]
            starts.append(at[piece >= 0])
            lengths.append(np.full(len(starts[-1]), n))
            found.append(piece[piece >= 0])
            if not len(at):
                break
        start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)
        # A character without a piece of its own is spelled in bytes, with a node after each.
        spelled = np.ones(len(chars), bool)
        spelled[start[length == 1]] = False
        width = np.where(spelled, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 1).astype(np.int64)
        node = np.cumsum(width) - 1  # at the end of each character
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        is_first = np.zeros(len(chars) + 1, bool)
        is_first[firsts] = True
        behind = lambda p: np.where(is_first[p], -1, node[p - 1])
        longest = np.argsort(-length, kind="stable")  # a node's likelier pieces first, so that few are looked at
        start, length, piece = start[longest], length[longest], piece[longest]
        own, before, weight = [node[start + length - 1]], [behind(start)], [self.weight[piece]]
        pieces = [piece]
        for p in np.flatnonzero(spelled):
            raw = chr(int(chars[p])).encode("utf-8", "surrogatepass")
            steps = np.arange(node[p] - len(raw) + 1, node[p] + 1)
            own.append(steps)
            before.append(np.concatenate([behind(np.array([p])), steps[:-1]]))
            pieces.append(np.array([self.bytes[x] for x in raw]))
            weight.append(np.full(len(raw), self.byte_weight))
        own, before, pieces, weight = map(np.concatenate, (own, before, pieces, weight))
        order = np.argsort(own, kind="stable")
        own, before, pieces, weight = own[order], before[order], pieces[order], weight[order]
        ends = node[np.cumsum(sizes) - 1]
        share = self.filtered(own, before, weight, np.diff(np.concatenate([[-1], ends])))
        self.first = np.concatenate([self.first, (len(self.piece) + np.searchsorted(own, np.arange(int(node[-1]) + 1))).astype(np.int32)])
        self.cumulative = np.concatenate([self.cumulative, share.astype(np.float32)])
        self.before = np.concatenate([self.before, np.where(before >= 0, before + self.nodes, -1).astype(np.int32)])
        self.piece = np.concatenate([self.piece, pieces.astype(np.int32)])
        self.ends.update(zip(units, (ends + self.nodes).tolist(), strict=True))
        self.nodes += int(node[-1]) + 1

    @staticmethod
    def filtered(node: np.ndarray, before: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cumulative probabilities of each node's edges, the last one exactly 1; all units take a node's turn together."""
        count = int(sizes.sum())
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        turn = np.arange(count) - np.repeat(starts, sizes)
        edge_at = np.searchsorted(node, np.arange(count + 1))
        total, share = np.zeros(count), np.zeros(len(node))
        order = np.argsort(turn, kind="stable")
        bounds = np.searchsorted(turn[order], np.arange(int(turn.max(initial=-1)) + 2))
        for t in range(len(bounds) - 1):
            now = order[bounds[t] : bounds[t + 1]]
            counts = edge_at[now + 1] - edge_at[now]
            heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
            edges = np.repeat(edge_at[now] - heads, counts) + np.arange(int(counts.sum()))
            log = weight[edges] + np.where(before[edges] >= 0, total[np.maximum(before[edges], 0)], 0.0)
            most = np.maximum.reduceat(log, heads)
            raw = np.exp(log - np.repeat(most, counts))
            sums = np.add.reduceat(raw, heads)
            total[now] = most + np.log(sums)
            running = np.cumsum(raw)
            share[edges] = np.minimum((running - np.repeat(running[heads] - raw[heads], counts)) / np.repeat(sums, counts), 1.0)
            share[edges[heads + counts - 1]] = 1.0
        return share

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """The sampled ids of each text."""
        cut = [UNIT.findall(" " + x) if x else [] for x in texts]
        sizes = np.array([len(x) for x in cut], np.int64)
        got = [list(map(self.ends.get, x)) for x in cut]
        if missing := {u for units, ends in zip(cut, got, strict=True) if None in ends for u, e in zip(units, ends, strict=True) if e is None}:
            if len(self.ends) > REMEMBERED or self.nodes > REMEMBERED_NODES:
                self.clear()
                missing = {u for units in cut for u in units}
            self.learn(sorted(missing))
            got = [list(map(self.ends.__getitem__, x)) for x in cut]
        node = np.concatenate([np.array(x, np.int64) for x in got] or [np.empty(0, np.int64)])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        key = np.repeat(seeds, sizes) + mix64((np.arange(len(node)) - np.repeat(starts[:-1], sizes)).astype(np.uint64) + np.uint64(1))
        active, steps, count = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        step = 0
        while len(active):
            draw = (mix64(key[active] + np.uint64(step * int(HASHED) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node[active]]
            over = np.flatnonzero(draw >= self.cumulative[edge])
            while len(over):  # a node's last edge has 1, and no draw reaches that
                edge[over] += 1
                over = over[draw[over] >= self.cumulative[edge[over]]]
            steps.append((active, self.piece[edge]))
            count[active] += 1
            node[active] = self.before[edge]
            active = active[node[active] >= 0]
            step += 1
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for k, (rows, piece) in enumerate(steps):
            ids[ends[rows] - 1 - k] = piece
        limits = np.concatenate([[0], ends])[starts]
        return [ids[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:]  # without the space put in front


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattices(path, alpha)
    return _LATTICES[path, alpha]


def row_seeds(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(k), seed=seed) for k in keys], dtype=np.uint64)


def sample_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", alpha: float = ALPHA, seed: int = 1, key_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``n_pieces``, ``ids_crc32``, ``lossless`` and (``with_ids``) ``ids`` beside it.

    ``lossless`` says that decoding the ids gave the row's own text back. A null or empty text has no pieces; rows with equal
    key and text get equal pieces; a null key is a key like any other. Columns of the added names are replaced.
    """
    added = "n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in added.split(", ")]
    rest = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = lattices(tokenizer_path(model), alpha)
        for part in slices(batches, text_column, BLOCK):
            column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
            raw = utf8(column(text_column))
            found = encoder.sample([x.decode() for x in raw], row_seeds(column(key_column).to_pylist(), seed))
            out = [
                pa.array(map(len, found), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                pa.array([encoder.decode(x) == y for x, y in zip(found, raw, strict=True)]),
            ]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *names])

    return rest.mapInArrow(tidy(run, "lattices"), wider(rest.schema, added))


def decode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", ids_column: str = "ids") -> DataFrame:
    """Every row of ``docs`` with ``decoded``, the text of its ids; null for null ids."""
    rest = docs.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = lattices(tokenizer_path(model), ALPHA)
        for part in batches:
            ids = part.column(part.schema.get_field_index(ids_column)).to_pylist()
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return rest.mapInArrow(tidy(run, "lattices"), wider(rest.schema, "decoded string"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("text")
