"""Main text of web pages: gradient-boosted trees score the nodes of a page, a decoding over the tree chooses among them.

No page comes with its main text marked, so the trees are trained on invented pages of many layouts (``page_samples``) whose
marks are known; they take a second or two and are the same every time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import boosting
from .common import slices, strings, table, tidy, wider
from .html_dom import Page, decode, features, matrix, parse
from .page_samples import pages

FIT_PAGES, FIT_SEED = 600, 11
#: Nodes that are scored together.
BATCH_NODES = 20_000


@lru_cache(maxsize=1)
def model() -> boosting.Forest:
    rows, labels = [], []
    for source in pages(FIT_PAGES, FIT_SEED):
        page = parse(source)
        for row, label in zip(features(page), page.label, strict=True):
            if label >= 0:
                rows.append(row)
                labels.append(label)
    return boosting.fit(matrix(rows), np.array(labels, dtype=np.float64))


def main_texts(forest: boosting.Forest, sources: list[str]) -> Iterator[str]:
    """The main text of each page: kept blocks in page order, one line each; empty if there are none."""
    held: list[tuple[Page, int]] = []
    rows: list[tuple] = []

    def flush() -> Iterator[str]:
        score, at = boosting.predict(forest, matrix(rows)), 0
        for page, n in held:
            yield "\n".join(decode(page, score[at : at + n]))
            at += n
        held.clear()
        rows.clear()

    for source in sources:
        page = parse(source)
        held.append((page, len(page.tag)))
        rows.extend(features(page))
        if len(rows) >= BATCH_NODES:
            yield from flush()
    if held:
        yield from flush()


def extract_text(docs: DataFrame, html_column: str = "html") -> DataFrame:
    """Every row of ``docs`` with ``text`` and ``n_chars`` beside it (columns of those names are replaced).

    A null or empty page has the empty text. Markup that never closes runs to the end of the page; repeated rows each keep
    their row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())
    rest = docs.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_column):
            found = list(main_texts(shared.value, strings(part.column(part.schema.get_field_index(html_column)))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*part.schema.names, "text", "n_chars"])

    return rest.mapInArrow(tidy(run), wider(rest.schema, "text string, n_chars long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
