"""N-gram Jaccard join by grouped prefixes: which documents have nearly the same set of word n-grams, and what hangs together.

Every document becomes the set of its hashed n-grams under one global order (frequent ones last, else by hash). Two sets can
only reach the wanted similarity if their prefixes, a fixed share of the set, have an n-gram in common.

1. Equal sets are one class; classes with identical prefixes and size are one group. Only groups are joined.
2. Within a prefix n-gram and size band each group is paired with one anchor, each class with its group's first; the pairs are
   verified on whole texts and united. Copies in any number are thereby united in as many verifications as there are copies.
3. Groups that share a prefix n-gram and are still apart are paired, filtered by size, position and a bitmap of the set, expanded
   to their members and verified. Pairs inside a component need no look: links only decide components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, mix64, slices, some_of, table, tidy, utf8
from .components import connected_components
from .words import windows, word_hashes

#: The order of n-grams (nothing but speed hangs on it) is fitted on about so many documents; the list it gives is bounded.
ORDER_ROWS, ORDER_LEAST, ORDER_MOST = 8192, 6, 200_000


#: Bits of the parity bitmap of a set: each n-gram flips one, so two sets differ in at least as many n-grams as bitmaps in bits.
BITMAP = 512
BITS = [f"b{k}" for k in range(BITMAP // 64)]


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text, lower-cased in A-Z; with fewer words the whole sequence is one."""
    hashes = word_hashes(text.lower().split())
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, n)) if len(hashes) >= n else mix64(windows(hashes, len(hashes)) + np.uint64(len(hashes)))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """At most ``ORDER_MOST`` n-grams that a bounded sample holds in ``ORDER_LEAST`` documents or more, sorted."""
    rate = max(1, docs.count() // ORDER_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x, n) for x in utf8(part.column(0))]).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).select("text").mapInArrow(tidy(run, "words"), "h long")
    rows = some.groupBy("h").count().where(F.col("count") >= ORDER_LEAST).orderBy(F.desc("count"), "h").limit(ORDER_MOST).select("h")
    found = np.array([x.h for x in rows.collect()], dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _features(docs: DataFrame, n: int, percent: int) -> DataFrame:
    late = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes, marks, bitmaps, prefixes = [], [], [], []
            for text in utf8(part.column(1)):
                grams = shingles(text, n)
                frequent = late.value[np.minimum(np.searchsorted(late.value, grams), len(late.value) - 1)] == grams if len(late.value) else np.zeros(len(grams), bool)
                prefix = np.concatenate([grams[~frequent], grams[frequent]])[: prefix_length(len(grams), percent)]
                sizes.append(len(grams))
                marks.append([np.bitwise_xor.reduce(mix64(grams)), grams.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(prefix)), prefix.sum(dtype=np.uint64)])
                bitmaps.append(np.packbits((np.bincount((grams % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)).view(np.int64))
                prefixes.append(prefix.view(np.int64))
            marks = np.concatenate([np.array(marks, dtype=np.uint64).view(np.int64), np.array(bitmaps)], axis=1)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), *(pa.array(marks[:, k]) for k in range(marks.shape[1])), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes)))],
                ["doc_id", "n", "s1", "s2", "p1", "p2", *BITS, "prefix"],
            )

    return docs.mapInArrow(tidy(run, "words"), f"doc_id long, n long, s1 long, s2 long, p1 long, p2 long, {', '.join(f'{b} long' for b in BITS)}, prefix array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, repeated: bool, n: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose whole texts are similar enough, as ``(u, v)``."""
    texts = some_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), "doc_id")
    texts = texts.distinct() if repeated else texts
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, None
        for part in slices(batches, "text_b"):
            keep = []
            for x, y in zip(utf8(part.column(2)), utf8(part.column(3)), strict=True):
                if x != last:  # the rows of one anchor come together
                    last, grams = x, shingles(x, n)
                keep.append(linked(grams, shingles(y, n), percent))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(tidy(run, "words"), "u long, v long").distinct()


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``, linked where ``100 * intersection >= percent * union``.

    ``component_id`` is the smallest id reachable by links, itself included. A text without words (or null) has no shingles
    and no links. Repeated rows each keep their row; rows that share an id share its links. A row without id links to nothing
    and has no component. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    sets = checkpointed(_features(docs, n, percent))
    repeated = not sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("prefix").alias("prefix"), *(F.first(b).alias(b) for b in BITS))
    firsts = classes.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
    classes = checkpointed(classes.join(firsts, ["n", "p1", "p2"]).select("n", "s1", "s2", "rep", "gid", F.when(F.col("rep") == F.col("gid"), F.col("prefix")).alias("prefix"), *(F.when(F.col("members") == 1, F.col(b)).alias(b) for b in BITS)))

    # Prefix n-grams of at least two groups.
    grams = classes.where("rep = gid").select("gid", "n", F.posexplode("prefix").alias("at", "h"))
    gram = Window.partitionBy("h")  # one exchange; the rows of a gram are buffered on disk where memory is short
    grams = grams.select("*", F.min("gid").over(gram).alias("lo"), F.max("gid").over(gram).alias("hi")).where("lo < hi").select("gid", "n", "at", "h")
    band = F.floor(F.log("n") / math.log(100 / percent) if percent < 100 else F.col("n"))
    shared = checkpointed(grams.withColumn("band", band))

    # Anchors that share half of a group's prefix are looked at first; this only unites copies early, step 3 misses nothing.
    anchors = shared.groupBy("h", "band").agg(F.min("gid").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "band", "a")
    near = shared.join(anchors, ["h", "band"]).where("gid <> a").groupBy("a", F.col("gid").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    near = near.where(f"2 * c * 100 >= n * {100 - percent}").select("a", "b")
    inside = classes.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    first_links = _verified(checkpointed(near.union(inside).distinct()), docs, repeated, n, percent)
    if repeated:  # an id with several texts ties their classes together
        first_links = first_links.union(sets.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).where("doc_id <> rep").select("doc_id", "rep"))
    united = connected_components(first_links)

    named = classes.select("rep", "gid", "n").join(united, F.col("rep") == F.col("id"), "left").select("rep", "gid", F.coalesce("component_id", "rep").alias("part"))
    named = checkpointed(named)
    apart = shared.join(named.select("gid", "part").distinct(), "gid")
    open_grams = apart.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("h")
    bitmaps = classes.where("rep = gid").select("gid", *BITS)  # null for a group of several sets
    apart = checkpointed(apart.join(open_grams, "h").join(bitmaps, "gid").select("h", "gid", "n", "at", "part", "band", *BITS))
    carried = ("gid", "n", "at", "part", *BITS)
    # The smaller set of a pair shares an n-gram within a shorter prefix: at least 2 percent / (100 + percent) of it is common.
    least_common = lambda n_: f"ceil({2 * percent} * {n_} / {100 + percent}.0)"
    small = apart.where(f"at <= n - {least_common('n')}").select("h", *(F.col(c).alias(f"{c}_a") for c in carried), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    large = apart.select("h", *(F.col(c).alias(f"{c}_b") for c in carried), "band")
    enough = (100 + percent, percent)  # overlap * (100 + percent) >= percent * (n_a + n_b)
    bound = lambda shared_so_far: f"({shared_so_far} + least(n_a - at_a, n_b - at_b)) * {enough[0]} >= {enough[1]} * (n_a + n_b)"
    differing = " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in BITS)
    alike = f"coalesce(({differing}) * {enough[0]} <= {100 - percent} * (n_a + n_b), true)"
    first_in = "(n_a < n_b OR n_a = n_b AND gid_a < gid_b)"
    met = small.join(large, ["h", "band"]).where(f"part_a <> part_b AND {first_in} AND 100 * n_a >= {percent} * n_b AND {bound('least(at_a, at_b)')} AND {alike}")
    met = met.groupBy("gid_a", "part_a", "n_a", "gid_b", "part_b", "n_b").agg(F.count(F.lit(1)).alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    met = met.where(bound("(c - 1)"))
    # Whichever prefix ends first, all common n-grams up to its end are counted in c: no more than what follows it can be added.
    met = met.where(f"(c + greatest({least_common('n_a')} - 1, ceil({percent} * n_b / 100.0) - 1)) * {enough[0]} >= {enough[1]} * (n_a + n_b)")
    ends = lambda end: named.select(F.col("rep").alias(end), F.col("gid").alias(f"gid_{end}"), F.col("part").alias(f"part_{end}"))
    pairs = met.select("gid_a", "part_a", "gid_b", "part_b").join(ends("a"), ["gid_a", "part_a"]).join(ends("b"), ["gid_b", "part_b"]).select("a", "b")
    split = named.groupBy("gid").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("gid")
    torn = named.join(split, "gid")
    within = torn.select("gid", F.col("rep").alias("a"), F.col("part").alias("x")).join(torn.select("gid", F.col("rep").alias("b"), F.col("part").alias("y")), "gid").where("x < y").select("a", "b")
    last_links = checkpointed(_verified(checkpointed(pairs.union(within).distinct()), docs, repeated, n, percent))
    if not last_links.isEmpty():
        united = connected_components(united.select(F.col("id").alias("u"), F.col("component_id").alias("v")).union(last_links))

    ends = classes.select("n", "s1", "s2", "rep").join(united, F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    return (
        sets.select("doc_id", "n", "s1", "s2").join(ends, ["n", "s1", "s2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component_id", "doc_id"), F.col("doc_id"))).alias("component_id"))
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
