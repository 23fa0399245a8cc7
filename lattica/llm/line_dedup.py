"""Line dedup by distinct-site spread: lines that many sites share are boilerplate, and go from all but one document.

The spread of a line is the number of distinct sites whose documents hold it, over all documents. HyperLogLog sketches of the
sites merge by aggregation; lines whose estimate lies near the threshold get exact distinct counts. A boilerplate line stays in
the document with the smallest id that holds it, so no content leaves the corpus.

Copies of one document of several lines are not evidence of boilerplate, however many sites carry them (that is for duplicate
removal): a line all of whose documents have the same signature (a hash of all their distinct lines) is none, unless it is all
that one of its documents holds.

DataFrame operations only. The lines of all documents meet the boilerplate lines in a broadcast join while those are few enough
by count; beyond that in a join on the line and a salt, so that a frequent line is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over three standard errors of a sketch (1.04 / 2 ** 6).
NEAR = 0.1
#: Up to so many boilerplate lines (about 80 bytes each) are broadcast; more are joined by shuffle, each repeated for every salt.
BROADCAST_LINES, SALTS = 500_000, 64


def _key(line: Column) -> Column:
    return F.md5(F.trim(line).cast("binary"))


def _keys(text: Column) -> Column:
    """The hash of each line, null for a blank one."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", _key(x)))


def line_spread(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, site_column: str = "source") -> DataFrame:
    """``line, first_doc`` of every boilerplate line: its hash and the smallest id that holds it. A null site does not count."""
    keyed = docs.select("doc_id", F.col(site_column).cast("string").alias("site"), _keys(F.col("text")).alias("keys"))
    distinct = F.array_sort(F.array_distinct(F.array_compact("keys")))
    keyed = keyed.select("doc_id", "site", "keys", F.xxhash64(distinct).alias("signature"), (F.size(distinct) == 1).alias("alone"))
    lines = keyed.select("doc_id", "site", "signature", "alone", F.explode("keys").alias("line")).where("line IS NOT NULL")
    held = lines.groupBy("line", "site").agg(F.min("doc_id").alias("first_doc"), F.min("signature").alias("low"), F.max("signature").alias("high"), F.max("alone").alias("alone"))
    spread = held.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("first_doc").alias("first_doc"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("alone").alias("alone")
    )
    spread = spread.where((F.col("sites") >= (1 - near) * min_sites) & (F.col("alone") | (F.col("low") < F.col("high"))))
    sure = spread.where(F.col("sites") > (1 + near) * min_sites).select("line", "first_doc")
    unsure = spread.where(F.col("sites") <= (1 + near) * min_sites).select("line", "first_doc")
    exact = held.select("line", "site").join(unsure.select("line"), "line", "left_semi").groupBy("line").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(unsure.join(exact.select("line"), "line", "left_semi"))


def _meet(lines: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """``lines`` joined with ``found`` on the line, whatever share of all rows one line has."""
    found = checkpointed(found)
    if found.count() <= most:
        return lines.join(F.broadcast(found), "line")
    repeated = found.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return lines.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(repeated, ["line", "__salt"]).drop("__salt")


def _flags(at: str) -> Column:
    """For each line up to the last of the sorted positions ``at`` whether it is one of them, so that a line's fate is one look-up: a search of the list takes the square of a text's lines."""
    steps = F.zip_with(at, F.concat(F.array(F.lit(-1)), at), lambda this, last: this - last)  # null at its end
    return F.flatten(F.transform(F.filter(steps, F.isnotnull), lambda n: F.concat(F.array_repeat(F.lit(False), n - 1), F.array(F.lit(True)))))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, site_column: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Every row of ``docs`` with its text without boilerplate lines, and ``n_removed``, the lines that went.

    Lines are compared without the spaces around them; blank lines stay. A null text stays null, an empty one empty. Repeated
    rows are handled alike, and each of them keeps a line that its id keeps; a null id keeps none. Other columns pass through
    (an own column named ``n_removed`` is replaced).
    """
    rest = docs.drop("n_removed")
    found = line_spread(rest, min_sites, near, site_column)
    keyed = rest.select("doc_id", F.xxhash64("text").alias("mark"), _keys(F.col("text")).alias("keys"))  # before the lines are dealt out: else each carries and hashes the whole text
    lines = keyed.select("doc_id", "mark", F.posexplode("keys").alias("at", "line")).where("line IS NOT NULL")
    gone = _meet(lines, found, broadcast_lines).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("__gone_id"), F.col("mark").alias("__gone_mark")).agg(F.sort_array(F.collect_set("at")).alias("__at"))  # of one text: no more than its lines
    gone = gone.select("__gone_id", "__gone_mark", _flags("__at").alias("__gone"), F.size("__at").alias("__n"))
    marked = rest.withColumn("__mark", F.xxhash64("text"))
    joined = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.col("__mark") == F.col("__gone_mark")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("__gone", i), F.lit(False))), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in rest.columns], F.coalesce("__n", F.lit(0)).cast("long").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE_SQL = f"""
WITH lines AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), keyed AS (
    SELECT *, md5(trim(raw, ' ')) AS line FROM lines WHERE trim(raw, ' ') <> ''
), sets AS (
    SELECT doc_id, string_agg(DISTINCT line, ',' ORDER BY line) AS all_lines, count(DISTINCT line) AS n_lines FROM keyed GROUP BY doc_id
), found AS (
    SELECT line, min(doc_id) AS first_doc FROM keyed JOIN sets USING (doc_id) GROUP BY line
    HAVING count(DISTINCT source) >= {MIN_SITES} AND (count(DISTINCT all_lines) > 1 OR min(n_lines) = 1)
), marked AS (
    SELECT l.doc_id, l.pos, l.raw, f.line IS NOT NULL AS gone
    FROM lines l LEFT JOIN found f ON md5(trim(l.raw, ' ')) = f.line AND trim(l.raw, ' ') <> '' AND f.first_doc <> l.doc_id
), whole AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(kept, d.text))::BIGINT AS n_chars_kept, md5(coalesce(kept, d.text)) AS text_md5
FROM documents d LEFT JOIN whole w ON d.doc_id = w.doc_id
"""
