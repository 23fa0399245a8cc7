"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits vectors again and again at about the median of a random projection; vectors near a threshold spill into both
halves. Its nodes are fitted on a bounded sample; below the sample's resolution a node goes on splitting at its sample's mean,
with a spill estimated from its sample's spread. The trees are as deep as the number of vectors asks for, and as many as keep a
pair at the threshold together somewhere with the wanted probability at that depth.

Every vector is routed through all trees, vectors that share a leaf are compared, verified in double precision and united. A
pair is counted in the first leaf that it shares, so counts need no list of pairs. A leaf that holds many times its share is
dealt out in chunks, and a task compares two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, mix64, table
from .components import connected_components

LEAF_ROWS, SEED = 4096, 7
#: The trees are fitted on at most so many distinct vectors, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: A node with fewer sample rows splits at their mean from there on.
FIT_LEAST = 24
#: Spill: within this share of the distance that a just linked pair has along a projection, and no more than this share of a node
#: (of a normal distribution that share lies within SPILL_SIGMAS of the middle).
SPILL, SPILL_MOST, SPILL_SIGMAS = 0.35, 0.25, 0.3186
#: Share of just linked pairs that some leaf should hold, and the most trees to that end.
RECALL, MOST_TREES = 0.985, 60
THRESHOLD = 0.9
#: A leaf of more than so many times the wanted rows is dealt out in chunks of half of that.
CROWDED = 4
LEAF_SCHEMA = "leaf long, low int, high int, chunk int, rep long, weight long, raw binary, codes binary"
LEAF_SCHEMA_NAMES = [x.split()[0] for x in LEAF_SCHEMA.split(", ")]


class Tree(NamedTuple):
    directions: np.ndarray  # one per level
    child: np.ndarray  # of each node the first child, 0 at the sample's end; the second is the next
    cut: np.ndarray
    margin: np.ndarray
    mean: np.ndarray
    spread: np.ndarray  # of each node's sample along the direction of each level


def grow(sample: np.ndarray, depth: int, margin: float, rng: np.random.Generator) -> Tree:
    dim = sample.shape[1]
    directions = rng.standard_normal((max(depth, 1), dim))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    along_all = sample @ directions.T
    spreads = [along_all.std(0) if len(sample) else np.zeros(max(depth, 1))]
    child, cut, margins, means, todo = [0], [0.0], [0.0], [sample.mean(0) if len(sample) else np.zeros(dim)], [(0, 0, np.arange(len(sample)))]
    while todo:
        node, level, rows = todo.pop()
        if level >= depth or len(rows) < FIT_LEAST:
            continue
        along = along_all[rows, level]
        cut[node] = float(np.quantile(along, rng.uniform(0.4, 0.6)))
        margins[node] = min(margin, float(np.quantile(np.abs(along - cut[node]), SPILL_MOST)))
        child[node] = len(child)
        for side in (along < cut[node] + margins[node], along >= cut[node] - margins[node]):
            todo.append((len(child), level + 1, rows[side]))
            child.append(0)
            cut.append(0.0)
            margins.append(0.0)
            means.append(sample[rows[side]].mean(0) if side.any() else means[node])
            spreads.append(along_all[rows[side]].std(0) if side.any() else spreads[node])
    return Tree(directions, np.array(child), np.array(cut), np.array(margins), np.array(means), np.array(spreads))


def trees_for(depth: int, sample: np.ndarray, threshold: float, recall: float = RECALL, seed: int = SEED) -> int:
    """How many trees of ``depth`` levels keep a share of ``recall`` of the pairs at the threshold together.

    Measured on the sample: of pairs of a sample vector and one at the threshold's angle to it, how many share a leaf of a tree
    fitted on the sample.
    """
    if not depth or len(sample) < 2:
        return 1
    rng = np.random.default_rng(seed)
    one = sample[rng.integers(len(sample), size=2000)]
    away = rng.standard_normal(one.shape)
    away -= (away * one).sum(1, keepdims=True) * one
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    other = threshold * one + np.sqrt(max(0.0, 1 - threshold**2)) * away
    missed = np.ones(len(one))
    for k in range(1, MOST_TREES + 1):
        tree = grow(sample, depth, link_margin(threshold, sample.shape[1]), rng)
        (rows, path), (its_rows, its_path) = route(tree, depth, one), route(tree, depth, other)
        both = np.intersect1d(rows + (path << 20), its_rows + (its_path << 20)) & ((1 << 20) - 1)
        missed[np.unique(both)] = 0
        if 1 - missed.mean() >= recall:
            return k
    return MOST_TREES


def link_margin(threshold: float, dim: int) -> float:
    return SPILL * float(np.sqrt(2 * (1 - threshold) / dim))


def route(tree: Tree, depth: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the leaf that each is in; a row that spilled appears more than once."""
    rows, node, path, most = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.ones(len(unit), np.int64), tree.margin.max()
    for level in range(depth):
        along = unit[rows] @ tree.directions[level]
        fitted = tree.child[node] > 0
        cut = np.where(fitted, tree.cut[node], tree.mean[node] @ tree.directions[level])
        margin = np.where(fitted, tree.margin[node], np.minimum(most, SPILL_SIGMAS * tree.spread[node, level]))
        low, high = along < cut + margin, along >= cut - margin
        low |= ~high
        next_node = np.where(fitted, tree.child[node], node)
        rows = np.concatenate([rows[low], rows[high]])
        path = np.concatenate([2 * path[low], 2 * path[high] + 1])
        node = np.concatenate([next_node[low], np.where(fitted[high], next_node[high] + 1, next_node[high])])
    return rows, path


def unit_rows(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which of the given can be compared at all."""
    out, good = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dim and None not in v:
            x = np.array(v, dtype=np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else x
                size = np.linalg.norm(x)
            if np.isfinite(size) and size > 0:
                out[k], good[k] = x / size, True
    return out, good


def _leaf(rep: np.ndarray, weight: np.ndarray, unit: np.ndarray, codes: list[np.ndarray], here: int, chunk: np.ndarray, cell: tuple[int, int], threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of a leaf: the weight of each row's links that no earlier leaf has counted, and links that hold its parts together.

    ``cell`` names the two chunks whose pairs are compared here; the same one twice is that chunk's own pairs.
    """
    n, links, edges, part = len(rep), np.zeros(len(rep), np.int64), [], np.arange(len(rep))
    short, unsure = unit.astype(np.float32), unit.shape[1] * 2.0**-22  # more than single precision can be off
    earlier = [x[x < here] for x in codes]
    before = np.repeat(-1 - np.arange(n)[:, None], max(map(len, earlier)), axis=1)  # unlike any other row's where a row has no more
    for k, x in enumerate(earlier):
        before[k, : len(x)] = x
    sides = [np.flatnonzero(chunk == c) for c in cell]
    for ours, theirs in [(sides[0], sides[1])] if cell[0] == cell[1] else [(sides[0], sides[1]), (sides[1], sides[0])]:
        their_short = short[theirs].T
        for start in range(0, len(ours), 512):
            mine = ours[start : start + 512]
            about = short[mine] @ their_short
            close = about >= threshold - unsure
            doubtful = close & (about < threshold + unsure)
            for i in np.flatnonzero(doubtful.any(1)):
                at = np.flatnonzero(doubtful[i])
                close[i, at] = unit[theirs[at]] @ unit[mine[i]] >= threshold
            if cell[0] == cell[1]:
                close[np.arange(len(mine)), np.arange(start, start + len(mine))] = False
            i, j = np.nonzero(close)
            if not len(i):
                continue
            i, j = mine[i], theirs[j]
            for at in range(0, len(i), 50_000):
                a, b = i[at : at + 50_000], j[at : at + 50_000]
                new = ~(before[a][:, :, None] == before[b][:, None, :]).any((1, 2))
                np.add.at(links, a[new], weight[b[new]])
            rows, first = np.unique(i, return_index=True)
            for row, near in zip(rows.tolist(), np.split(j, first[1:]), strict=True):
                parts, found = np.unique(part[near], return_index=True)
                for p, k in zip(parts.tolist(), found.tolist(), strict=True):
                    if p != part[row]:
                        part[part == p] = part[row]
                        edges.append((int(rep[row]), int(rep[near[k]])))
    return links, edges


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, trees: int | None = None, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Vectors that are null, zero, of another length than the most, or hold null or non-finite components link with nothing
    and stay. Equal directions are one class of any size, and each row of a class is linked with all others of it. Repeated
    rows count as vectors of their own. A row without id has no component and is not kept. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim = sizes.dim
    kind = "<f4" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"

    def unit_of(raw: list[bytes]) -> np.ndarray:
        return unit_rows(list(np.frombuffer(b"".join(raw), kind).reshape(-1, dim)), dim)[0].round(12) + 0.0

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            unit, good = unit_rows(given, dim)
            unit = unit.round(12) + 0.0
            mark = [hashlib.md5(x.tobytes()).digest() if g else None for x, g in zip(unit, good, strict=True)]
            raw = [np.array(x, kind).tobytes() if g else None for x, g in zip(given, good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "mark", "raw"])

    units = checkpointed(rows.mapInArrow(direct, "vec_id long, mark binary, raw binary"))
    classes = units.where("mark IS NOT NULL AND vec_id IS NOT NULL").groupBy("mark").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("raw").alias("raw"))
    classes = checkpointed(classes)
    count = classes.count()
    sample = unit_of([x.raw for x in classes.orderBy(F.xxhash64("rep"), "rep").limit(fit_rows).select("raw").collect()])
    depth = max(0, int(np.ceil(np.log2(max(count, 1) / leaf_rows))) + (count > leaf_rows))
    rng = np.random.default_rng(SEED)
    trees = trees or trees_for(depth, sample, threshold)
    forest = spark.sparkContext.broadcast([grow(sample, depth, link_margin(threshold, dim), rng) for _ in range(trees)])

    def routed(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves of all trees, row by row and a row's leaves in order."""
        found = [route(tree, depth, unit) for tree in forest.value]
        at = np.concatenate([r for r, _ in found])
        code = np.concatenate([(k << 48) + path for k, (_, path) in enumerate(found)])
        order = np.lexsort((code, at))
        return at[order], code[order]

    def leaf_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                code, n = np.unique(routed(unit_of(whole.slice(start, 2000).column(0).to_pylist()))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["leaf", "n"])

    # Leaves with many rows, of which there are no more than one for each CROWDED * leaf_rows rows and copies.
    crowded = classes.select("raw").mapInArrow(leaf_sizes, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > CROWDED * leaf_rows)
    chunks = spark.sparkContext.broadcast({x.leaf: -(-x.n // (CROWDED * leaf_rows // 2)) for x in crowded.collect()})

    def into_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at, code = routed(unit_of(batch.column(2).to_pylist()))
                ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
                numbers = batch.column(0).to_numpy()
                own = [code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                cells = []
                for k, leaf in enumerate(code.tolist()):
                    n = chunks.value.get(leaf, 1)
                    c = int(mix64(numbers[at[k] : at[k] + 1].astype(np.uint64))[0] % np.uint64(n)) if n > 1 else 0
                    cells += [(k, c, min(c, j), max(c, j)) for j in range(n)]
                k, chunk, low, high = np.array(cells, np.int64).reshape(-1, 4).T
                columns = [code[k], low.astype(np.int32), high.astype(np.int32), chunk.astype(np.int32)]
                copies = batch.take(pa.array(at[k]))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *copies.columns, pa.array([own[i] for i in at[k]], pa.binary())], LEAF_SCHEMA_NAMES)

    leaves = classes.select("rep", "weight", "raw").mapInArrow(into_leaves, LEAF_SCHEMA)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        first = lambda name: group.column(name)[0].as_py()
        rep, weight, chunk = (group.column(x).to_numpy() for x in ("rep", "weight", "chunk"))
        codes = [np.frombuffer(x, np.int64) for x in group.column("codes").to_pylist()]
        links, edges = _leaf(rep, weight, unit_of(group.column("raw").to_pylist()), codes, first("leaf"), chunk, (first("low"), first("high")), threshold)
        has = np.flatnonzero(links)
        a = [*rep[has].tolist(), *(x for x, _ in edges)]
        b = [*[None] * len(has), *(y for _, y in edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*links[has].tolist(), *[0] * len(edges)], pa.int64())})

    found = checkpointed(leaves.groupBy("leaf", "low", "high").applyInArrow(compare, "a long, b long, n long"))
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = classes.select("mark", "rep", "weight").join(linked, "rep", "left").join(parts, F.col("rep") == F.col("id"), "left")
    known = known.select("mark", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("part"))
    ends = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("mark")).alias("mark")).join(known, "mark", "left")
    part = F.coalesce("part", "vec_id")
    return ends.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(part == F.col("vec_id"), F.lit(False)).alias("kept"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
