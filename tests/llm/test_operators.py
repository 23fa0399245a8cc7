"""The training-data operators against brute force, round trips and held-out labels, on small inputs with every odd case."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import boosting, chat_format, compression_classifier, html_extraction, line_dedup, ngram_jaccard, packing, page_samples, piece_sampling, projection_forest, quality_rules, queries, token_counts
from lattica.llm.components import connected_components
from lattica.llm.html_dom import parse

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n\n", "a", "A b", "a B", "é 😀 x\x1cy \x0bz", "</s> <|endoftext|> it's\t<|startoftext|>b", "▁ literal  spaces ", "word " * 3000, "x" * 5000, "same same same same same same same"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, a null id, columns with clashing names."""
    rows = [(k, t, "src", "x", 1, 0.5) for k, t in enumerate(ODD)]
    rows += [rows[5], (None, "a null id has this text", None, None, None, None), (3, "another text under a known id", "src", "x", 1, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, n_words int, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(WORD, text or "")


# -- quality rules ------------------------------------------------------------------------------------------------------------


def base(text):
    w, seen = words(text), collections.defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_rules(spark, docs, odd, none):
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = quality_rules.quality_rules(both, trusted).collect()
    assert len(rows) == docs.count() + odd.count()
    for x in rows:
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(x.text)
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert x.kept == (not x.base_failed and x.llr >= quality_rules.THRESHOLD)
    # The model and one score by hand.
    raw, good = collections.Counter(), collections.Counter()
    for x in rows:
        at = collections.Counter(quality_rules.buckets((x.text or "").encode()).tolist())
        raw += at
        good += at if x.doc_id in set(trusted) else collections.Counter()
    total = sum(raw.values()) + quality_rules.BUCKETS
    share = lambda b: (raw[b] + 1) / total
    weight = lambda b: math.log((good[b] + quality_rules.PRIOR_COUNT * share(b)) / (sum(good.values()) + quality_rules.PRIOR_COUNT) / share(b))
    for x in rows[:20]:
        at = quality_rules.buckets((x.text or "").encode()).tolist()
        assert x.llr == pytest.approx(sum(map(weight, at)) / len(at) if at else 0.0, abs=1e-8)
    assert quality_rules.quality_rules(none, []).count() == 0
    out = quality_rules.quality_rules(odd, [])
    assert out.schema["kept"].dataType.simpleString() == "boolean" and "score" in out.columns


def test_every_trusted_row_counts(spark, monkeypatch):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality").union(spark.createDataFrame([(None, 1), (30_000, 0)], "doc_id long, quality int"))
    assert len(quality_rules.trusted_ids(labels)) == 25_000
    docs = spark.range(25_001).selectExpr("id AS doc_id", "concat('w', id % 50, ' v') AS text")
    weights = quality_rules.fit(docs, quality_rules.trusted_rows(labels))
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)  # by shuffle
    assert (weights == quality_rules.fit(docs, quality_rules.trusted_rows(labels))).all()
    at = quality_rules.buckets(b"v")[0]
    raw, good, total = 25_002, 25_000, 3 * 25_001 + quality_rules.BUCKETS
    assert weights[at] == pytest.approx(math.log((good + quality_rules.PRIOR_COUNT * raw / total) / (3 * good + quality_rules.PRIOR_COUNT) / (raw / total)), abs=1e-9)


def test_no_words_are_lost_at_a_cut(spark):
    text = "alpha beta gamma delta epsilon " * 300_000  # over 8 MiB
    assert len(list(quality_rules.stretches(text.encode()))) > 1
    frame = spark.createDataFrame([(1, text), (2, "alpha gamma beta " * 50_000)], "doc_id long, text string")
    long, short = (np.bincount(quality_rules.buckets(x.text.encode()), minlength=quality_rules.BUCKETS) for x in frame.orderBy("doc_id").collect())
    share = (long + short + 1) / (long + short + 1).sum()
    weights = np.log((long + quality_rules.PRIOR_COUNT * share) / (long.sum() + quality_rules.PRIOR_COUNT) / share)
    assert np.abs(quality_rules.fit(frame, [1]) - weights).max() < 1e-9
    llr = {x.doc_id: x.llr for x in quality_rules.quality_rules(frame, [1]).select("doc_id", "llr").collect()}
    assert llr[1] == pytest.approx(weights @ long / long.sum(), abs=2e-9) and llr[2] == pytest.approx(weights @ short / short.sum(), abs=2e-9)


# -- chat ---------------------------------------------------------------------------------------------------------------------


def test_chat_fold_and_round_trip(spark):
    hostile = "\\</s>\\\\[INST] <|end|><<s>> <|turn|>\\"
    log = [(1, 1, 1, "message", "user", hostile), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "a"), (1, 4, 2, "delta", None, "b"), (1, 5, 3, "message", "user", "later"), (1, 6, 2, "regenerate", None, None), (1, 7, 2, "delta", None, hostile), (1, 8, 3, "message", "user", "new"), (1, 9, 1, "edit", None, "edited"), (1, 9, 1, "edit", None, "edited"), (None, 1, None, None, None, None)]
    frame = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {x.conv_id: x for x in chat_format.read_back(chat_format.chat_format(frame)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "edited"), ("assistant", hostile), ("user", "new")]
    assert got[1].learned == [hostile]
    assert [tuple(t) for t in got[None].turns] == [("", "")]
    inner = re.sub("|".join(map(re.escape, (chat_format.TURN, chat_format.TEXT, chat_format.END))), "", got[1].formatted)
    assert not any(c in inner for c in chat_format.CONTROL)
    assert chat_format.chat_format(frame.limit(0)).count() == 0


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {x.conv_id: x for x in queries.QUERIES["op2_chat_format"](spark, SF).collect()}
    by = collections.defaultdict(list)
    for x in rows:
        by[x.conv_id].append((x.turn, x.role, x.text or ""))
    by[-7] = [(0, "user", chat_format.HOSTILE), (1, "assistant", chat_format.HOSTILE)]
    assert set(got) == set(by)
    for k, turns in by.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == want


# -- pages --------------------------------------------------------------------------------------------------------------------


def article(source):
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\0", inner))).split("\0")
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for x in html_extraction.extract_text(pages).collect():
        assert x.text == article(x.html) and x.n_chars == len(x.text)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p>un<b>closed &lt;x&gt; &amp;amp; text"), (3, "<script>var a = '</p>'"), (4, "no markup at all, only words that go on for a while."), (5, "<div" * 500), (6, "<p>" + "long text, " * 50_000)], "page_id long, html string")
    got = [(x.page_id, x.text) for x in html_extraction.extract_text(odd).collect()]
    assert [x for x in got if x[0] in (1, 2)] == [(1, ""), (2, "")] and len(got) == 7
    assert html_extraction.extract_text(odd.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    pages = {
        "no tag ends": "<div" * 250_000, "nested": "<div>x" * 100_000, "mixed quotes": "<a \"'>" * 150_000, "heads": "<head>" * 150_000, "unmatched ends": "<div>" * 60_000 + "</section>" * 60_000,
        "items": "<li>x<p>" * 80_000, "comments": "<!--" * 250_000, "attributes": "<div " + 'id="' * 200_000 + ">", "cells": "<td><p>" * 80_000, "brackets": "<" * 1_000_000,
    }
    for name, source in pages.items():
        start = time.process_time()
        page = parse(source)
        assert time.process_time() - start < 20, name
        assert all(p < k for k, p in enumerate(page.parent)), name
    nested = parse(pages["nested"])
    assert nested.tag.count("div") == nested.tag.count("#text") == 100_000 and nested.parent[-1] == len(nested.tag) - 2


def test_tags_end_outside_quotes():
    runs = lambda source: [x for t in parse(source).texts for x in t]
    assert runs("<p title='it\"s > so'>a</p>") == ["a"] and runs('<p title="a>b\'c">x') == ["x"]
    assert runs('<p title="never closed>y') == ["y"] and runs("a <b") == ["a <b"] and runs("a <b <!-- c --> d") == ["a d"]
    assert runs("a <b <!-- c > d") == ["a d"] and runs("<p \"'>x<p '\">y") == ["y"]


def test_held_out_layouts():
    forest, right, wrong = html_extraction.model(), 0, 0
    for source in page_samples.pages(100, 99):
        page = parse(source)
        want = {page.texts[i][0] for i in range(len(page.tag)) if page.texts[i] and page.label[i] == 1}
        got = set(next(html_extraction.main_texts(forest, [source])).split("\n")) - {""}
        right, wrong = right + len(want & got), wrong + len(want ^ got)
    assert wrong / (right + wrong) < 0.03


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).random((3000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    assert ((boosting.predict(forest, x[2000:]) > 0) == y[2000:]).mean() > 0.95


# -- tokens and packing -----------------------------------------------------------------------------------------------------------


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_counts(spark, docs, odd, none):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = both.collect()
    got = collections.Counter((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.token_counts(both).collect())
    assert got == collections.Counter((x.doc_id, len((x.text or "").encode()), len(i), len(i) > 2048) for x, i in zip(texts, library_ids([x.text for x in texts]), strict=True))
    assert token_counts.token_counts(none).count() == 0


def test_stretches_change_nothing():
    text = " ".join(ODD[8:9] * 400)
    assert "".join(token_counts.stretches(text, 50)) == text
    counter = token_counts.encoder(token_counts.tokenizer_path("word_bpe_49k.json"))
    assert sum(counter.count(list(token_counts.stretches(text, 50)))) == counter.count([text])[0]


def test_packing(spark, docs, odd, none):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.packed(both.coalesce(2), block_tokens=50_000).collect()
    given = both.collect()
    want = {x.doc_id: [*ids, 2] for x, ids in zip(given, library_ids([x.text for x in given]), strict=True)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and x.length == len(x.ids) and x.doc_tokens == len(want[x.doc_id])
        pieces[x.doc_id].append((x.start, x.ids))
        sequences[x.sequence_id].append((x.offset, x.length))
    assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in pieces.items()} == want
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.packed(none).count() == 0
    assert packing.packed(odd, with_ids=False).where("length = doc_tokens OR doc_tokens > 0").count() >= odd.count()


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.lognormal(5.5, 0.6, 2000).astype(int).tolist()
    cost = collections.Counter()
    for _, _, n, sequence, _ in packing.pack(lengths):
        cost[sequence] += packing.LINEAR * n + packing.QUADRATIC * n * n
    whole = sorted(cost.values())[12:]
    assert np.std(whole) / np.mean(whole) < 0.25


# -- duplicates -----------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(2)
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [float("inf")] + [0.0] * 63), (9006, [1.0, 2.0]), (9007, [None] + [1.0] * 63)]
    centre = rng.standard_normal(64)
    near = [(10_000 + k, (centre + 0.02 * rng.standard_normal(64)).tolist()) for k in range(300)] + [(11_000 + k, (centre * (k + 1)).tolist()) for k in range(20)]
    frame = spark.createDataFrame([(i, None if v is None else list(v)) for i, v in rows + odd + near] + [near[0]], "vec_id long, embedding array<float>")
    data = frame.collect()
    got = collections.Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in projection_forest.embedding_components(frame, leaf_rows=128).collect())
    unit, good = projection_forest.unit_rows([x.embedding for x in data], 64)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    part = [x.vec_id for x in data]
    for _ in range(6):
        part = [min([part[i], *(part[j] for j in np.flatnonzero(close[i]))]) for i in range(len(data))]
    found = sum(k[1] * n for k, n in got.items())
    assert found <= close.sum() and found >= 0.97 * close.sum()
    assert collections.Counter((k[0], k[2], k[3]) for k in got.elements()) == collections.Counter((x.vec_id, part[i], part[i] == x.vec_id) for i, x in enumerate(data))
    assert projection_forest.embedding_components(frame.limit(0)).count() == 0


def brute_links(unit, threshold=0.9):
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    return close


def test_embeddings_in_crowded_leaves(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((4, 32))
    vectors = np.concatenate([centres[k % 4] + (0.1 + 0.1 * (k % 2)) * rng.standard_normal((150, 32)) for k in range(4)] + [rng.standard_normal((200, 32))])
    frame = spark.createDataFrame([(k, v.tolist(), "x", 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, mark string, rep int")
    close = brute_links(projection_forest.unit_rows(list(vectors), 32)[0])
    got = {x.vec_id: (x.n_links, x.component_id) for x in projection_forest.embedding_components(frame, leaf_rows=8).collect()}  # leaves of over 32 rows are dealt out
    assert len(got) == len(vectors) and 0.97 * close.sum() <= sum(n for n, _ in got.values()) <= close.sum()
    whole = {x.vec_id: (x.n_links, x.component_id) for x in projection_forest.embedding_components(frame, leaf_rows=1000).collect()}
    part = np.arange(len(vectors))
    for _ in range(20):
        part = np.array([min(part[k], *part[close[k]]) if close[k].any() else part[k] for k in range(len(part))])
    assert whole == {k: (int(close[k].sum()), int(part[k])) for k in range(len(vectors))}


def test_embedding_recall_beyond_the_sample(spark):
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((12_000, 48))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    away = rng.standard_normal((3000, 48))
    away -= (away * unit[:3000]).sum(1, keepdims=True) * unit[:3000]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate([unit, 0.903 * unit[:3000] + np.sqrt(1 - 0.903**2) * away])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = projection_forest.embedding_components(frame, leaf_rows=64, fit_rows=300)  # nine levels, of which the sample fits four
    assert 0.95 * 6000 <= found.agg(F.sum("n_links")).first()[0] <= 6000


def brute_components(rows, n, percent):
    def grams(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    part = {i: i for i, _ in rows if i is not None}
    find = lambda x: x if part[x] == x else find(part[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i == j:
                continue
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                part[max(find(i), find(j))] = min(find(i), find(j))
    return collections.Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, docs, odd, n, percent):
    rng = np.random.default_rng(3)
    words_ = [f"w{k}" for k in rng.integers(0, 200, 400)]
    near = []
    for k in range(60):
        w = list(words_)
        for at in rng.integers(0, len(w), int(rng.integers(0, 8))):
            w[at] = f"v{rng.integers(0, 9)}"
        near.append((20_000 + k, " ".join(w[: len(w) - int(rng.integers(0, 30))])))
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(x.doc_id, x.text) for x in both.collect()]
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_jaccard.jaccard_components(both, n, percent).collect())
    assert got == brute_components(rows, n, percent)


def test_jaccard_of_nothing(none):
    assert ngram_jaccard.jaccard_components(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(50)] + [(7, 7)]
    part = {x: x for e in chain for x in e}
    for _ in range(60):
        for a, b in chain:
            part[a] = part[b] = min(part[a], part[b])
    got = {x.id: x.component_id for x in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    linked = {x for a, b in chain if a != b for x in (a, b)}
    assert got == {x: part[x] for x in linked}


def test_line_dedup(spark, odd, none):
    rows = [(k, f"own line {k}\n  shared by many \nrare {k % 2}\n\nlast {k}", f"s{k % 12}") for k in range(40)]
    rows += [(100 + k, "copy one\ncopy two\ncopy three", f"s{k}") for k in range(12)]  # copies of one document are no boilerplate
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "shared by many", None), (203, "shared by many", "s3"), (203, "shared by many", "s3"), (None, "shared by many\nx", "s4")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.line_dedup(frame, min_sites=5)
    assert got.columns == ["doc_id", "text", "source", "n_removed"] and got.count() == len(rows)
    text = {x.doc_id: x.text for x in got.collect()}
    assert text[0] == rows[0][1] and text[1] == "own line 1\nrare 1\n\nlast 1" and text[110] == "copy one\ncopy two\ncopy three"
    assert text[200] is None and text[201] == "" and text[202] == "" and text[203] == "" and text[None] == "x"
    near = line_dedup.line_dedup(frame, min_sites=8, near=0.9)  # exact counts decide near the threshold
    assert {x.doc_id for x in near.where("n_removed > 0").collect()} >= {k for k in range(1, 40) if k != 0}
    assert line_dedup.line_dedup(frame, min_sites=13, near=0.5).where("n_removed > 0").count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert line_dedup.line_dedup(odd).count() == odd.count()


def test_line_dedup_counts_every_site(spark):
    footer = "\nfooter one\nfooter two\nfooter three"
    rows = [(k, f"own line {k}{footer}", f"s{k}") for k in range(12)]
    rows += [(100 + k, f"text {k // 12}\nbyline", f"t{k % 12}") for k in range(36)]  # three documents, each on the same sites
    rows += [(200 + k, "copy one\ncopy two", f"u{k}") for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for near in (0.0, 0.9):
        text = {x.doc_id: x.text for x in line_dedup.line_dedup(frame, near=near).collect()}
        assert text[0] == rows[0][1] and [text[k] for k in range(1, 12)] == [f"own line {k}" for k in range(1, 12)]
        assert text[100] == "text 0\nbyline" and not any("byline" in text[k] for k in range(101, 136))
        assert {text[k] for k in range(200, 212)} == {"copy one\ncopy two"}


def test_line_spread_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    expected = duckdb.sql(f"""
        WITH keyed AS (SELECT doc_id, source, md5(trim(raw, ' ')) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw FROM '{sf}/documents.parquet') WHERE trim(raw, ' ') <> ''),
        sets AS (SELECT doc_id, string_agg(line, ',' ORDER BY line) AS lines, count(*) AS n FROM (SELECT DISTINCT doc_id, line FROM keyed) GROUP BY doc_id)
        SELECT line, min(doc_id) FROM keyed JOIN sets USING (doc_id) GROUP BY line HAVING count(DISTINCT source) >= 10 AND (count(DISTINCT lines) > 1 OR min(n) = 1)
    """).fetchall()
    got = line_dedup.line_spread(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(expected) > 0 and sorted(map(tuple, got)) == sorted(expected)


def test_line_dedup_of_footers_and_lone_lines(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"body {k}\n" + "\n".join(f"{'AB'[k % 2]} footer {j}" for j in range(3)), f"site {k % 60}") for k in range(120)]  # two footers, 30 sites each
    rows += [(1000 + k, "only a notice", f"site {k}") for k in range(50)]  # boilerplate and nothing else
    rows += [(2000 + k, f"pair {k}\nleast {rng.integers(4)}", f"few {k % 9}") for k in range(90)]  # nine sites are too few
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_removed", F.lit("own")).withColumn("line", F.lit(1)).withColumn("gone", F.lit(2))
    want = {x[0]: x[1] for x in rows} | {k: f"body {k}" for k in range(2, 120)} | {k: "" for k in range(1001, 1050)}
    for most in (0, 500_000):  # by shuffle with salts, by broadcast
        got = line_dedup.line_dedup(frame, broadcast_lines=most)
        assert got.columns == [*[c for c in frame.columns if c != "n_removed"], "n_removed"]
        assert {x.doc_id: x.text for x in got.collect()} == want


def test_lines_do_not_carry_their_text(spark):
    rows = [(k, "\n".join(x for j in range(300) for x in (f"own {k} {j}", f" shared {j % 100}", "")), f"s{k}") for k in range(12)]
    import corpus_pipeline

    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.line_dedup(frame)
    for frames in (got, corpus_pipeline.line_stage(spark, frame.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1)), "")):
        plan = frames._jdf.queryExecution().optimizedPlan().toString()
        dealt = [x for x in plan.splitlines() if "Generate" in x]
        assert dealt and not any("text#" in x for x in dealt)  # each of these takes the square of a text's length
        assert "array_contains" not in plan and all(re.match(r"__gone#\d+", x) for x in re.split(r"\bget\(", plan)[1:])
    for x in got.collect():
        want = rows[x.doc_id][1] if x.doc_id == 0 else "\n".join(x for x in rows[x.doc_id][1].split("\n") if "shared" not in x)
        assert x.text == want and x.n_removed == (300 if x.doc_id else 0)


def test_line_query_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, None if k % 41 == 0 else "\n".join([f"line {k % 7}", "", f"  shared {k % 3} ", f"own {k}"][: 1 + k % 4]), None if k % 13 == 0 else f"s{k % 17}") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(f"SELECT doc_id, n_removed, n_chars_kept, text_md5 FROM ({line_dedup.ORACLE_SQL})").fetchall()
    got = line_dedup.op9_line_dedup(spark, str(tmp_path)).select("doc_id", "n_removed", "n_chars_kept", "text_md5").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(x[1] for x in want)


# -- classifier, pieces ---------------------------------------------------------------------------------------------------------


def test_classifier(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [x for x in queries.QUERIES["op7_quality_classifier"](spark, sf).collect()]
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    held = [(x.score, labels[x.doc_id]) for x in rows if x.held_out and x.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = compression_classifier.fit(*compression_classifier.fit_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    out = compression_classifier.classify(odd, model)
    assert out.count() == odd.count() and out.schema["score"].dataType.simpleString() == "double"
    assert compression_classifier.classify(none, model).count() == 0
    assert compression_classifier.classify(odd, compression_classifier.fit([], [])).where("score <> 0.5").count() == 0


def test_classifier_against_its_definition(spark, odd, none):
    import zstandard

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = compression_classifier.fit(*compression_classifier.fit_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))

    def size(text, dictionary):
        whole = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(whole.compress(text[k : k + 256])) for k in range(0, max(len(text), 1), 256))

    both = docs.union(odd.select("doc_id", "text"))
    rows = compression_classifier.classify(both, model).collect()
    assert len(rows) == both.count()
    for x in rows:
        raw = (x.text or "").encode()
        good, bad = size(raw, model.good), size(raw, model.bad)
        score = 1 / (1 + math.exp(-(model.slope * (bad - good) / max(good, bad) + model.level)))
        assert abs(x.score - score) < 1e-8 and x.predicted == (x.score >= 0.7)
    assert model.slope > 0 and compression_classifier.classify(none, model).count() == 0
    again = spark.createDataFrame([(7, "a"), (7, "b"), (7, None)] * 50, "doc_id long, text string")  # a repeated id is one labelled row
    assert len(compression_classifier.fit_rows(again, spark.createDataFrame([(7, 1)], "doc_id long, quality int"))[0]) == (zlib.crc32(b"7") % 4 != 2)


def test_classifier_of_long_texts(spark):
    sf = "/root/testdata/sf0.1"
    texts, y = compression_classifier.fit_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for draw in range(3):
        order = np.random.default_rng(draw).permutation(len(texts))
        rows = [(texts[k], y[k]) for k in order]
        scorer = compression_classifier.Scorer(compression_classifier.fit([t for t, _ in rows], [v for _, v in rows]))
        scores = scorer.score([t for t, _ in rows])
        for v in (0, 1):  # texts whose verdict is right, put together
            right = [t for (t, label), p in zip(rows, scores, strict=True) if label == v and len(t) > 500 and (p > 0.95 if v else p < 0.2)]
            long = (b"\n".join(right) * (1 + 2_000_000 // sum(map(len, right))))[:2_000_000]
            assert (scorer.score([long[:500_000], long]) >= 0.7).tolist() == [v == 1] * 2


def test_classifier_keeps_texts_off_the_driver(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    letters = {v: np.array(list("abcde \u00e9\U0001f600\n" if v else "fghij \u4e2d\n")) for v in (0, 1)}
    rows = [(k, "".join(rng.choice(letters[k % 2], 40_000 + k)) if k % 5 else f"short {k}") for k in range(80)] + [(3, "again"), (81, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    want = compression_classifier.fit(*compression_classifier.fit_rows(docs, labels))
    for t in [t for _, t in rows if t] + ["x" * 32_769, "\u00e9" * 200_000]:
        raw, pieces = t.encode(), compression_classifier.FIT_BYTES // compression_classifier.CHUNK_BYTES
        size = max(1, len(t) * compression_classifier.CHUNK_BYTES // len(raw))
        parts = [t[k * (len(t) - size) // (pieces - 1) :][:size] for k in range(pieces)]
        assert compression_classifier.spread_text(raw) == (raw if len(raw) <= compression_classifier.FIT_BYTES else "".join(parts).encode())

    got, kind = [], type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.append(collect(self)) or got[-1])
    import corpus_pipeline

    kept = corpus_pipeline.classifier_stage(spark, docs, str(tmp_path))
    op7 = compression_classifier.op7_quality_classifier(spark, str(tmp_path))
    monkeypatch.undo()
    sent = sum(len(x) for rows in got for r in rows for x in r if isinstance(x, (str, bytes, bytearray)))
    assert 0 < sent <= 2 * 45 * compression_classifier.DICTIONARY_CHUNKS * compression_classifier.CHUNK_BYTES  # of either fit every second row of at most 80
    assert compression_classifier.fit_tables(docs, labels) == want and want.slope > 0
    assert sorted(op7.select("doc_id", "score").collect()) == sorted(compression_classifier.classify(docs, want).select("doc_id", "score").collect())
    assert kept.count() == op7.where("predicted = 1").count()
    few = labels.where("doc_id < 8")
    assert compression_classifier.fit_tables(docs, few) == compression_classifier.fit(*compression_classifier.fit_rows(docs, few))


def test_classifier_fits_on_whole_texts(spark):
    long = "".join(f"{k % 10}" * 1000 for k in range(200)) + "\u00e9" * 20_000
    docs = spark.createDataFrame([(k, long if k % 2 else "short") for k in range(1, 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, quality int")
    held = {x.doc_id for x in docs.where(compression_classifier.held_out("doc_id")).collect()}
    texts, y = compression_classifier.fit_rows(docs, labels)
    assert len(texts) == 4 - len(held) and max(y) == 1
    for t, v in zip(texts, y, strict=True):
        assert t == b"short" if v == 0 else 0.9 < len(t) / compression_classifier.FIT_BYTES < 1.3 and set("0123456789\u00e9") <= set(t.decode())
    starts = compression_classifier.spread_starts(100_000)
    assert len(starts) == compression_classifier.DICTIONARY_CHUNKS and starts[0] == 0 and starts[-1] + compression_classifier.CHUNK_BYTES >= 100_000


def test_pieces(spark, docs, odd, none):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = piece_sampling.sample_pieces(both).collect()
    assert all(x.lossless and x.n_pieces == len(x.ids) for x in rows)
    decoded = piece_sampling.decode_pieces(piece_sampling.sample_pieces(both)).where("NOT (decoded <=> coalesce(text, ''))")
    assert decoded.count() == 0
    again = {(x.doc_id, x.text): x.ids for x in piece_sampling.sample_pieces(both.repartition(7)).collect()}
    assert all(again[x.doc_id, x.text] == x.ids for x in rows)
    other = piece_sampling.sample_pieces(docs.limit(20), seed=2).collect()
    assert any(again[x.doc_id, x.text] != x.ids for x in other)
    assert piece_sampling.sample_pieces(none).count() == 0


def test_piece_probabilities():
    lattice = piece_sampling.lattices(token_counts.tokenizer_path("piece_bpe_32k.model"), 1.0)

    def paths(u):
        if not u:
            yield (), 0.0
        for j in range(1, len(u) + 1):
            if found := lattice.pieces.get(u[:j]):
                yield from (((found[0], *p), found[1] + w) for p, w in paths(u[j:]))
        if u and u[0] not in lattice.pieces:
            raw = u[0].encode()
            yield from (((*(lattice.bytes[b] for b in raw), *p), len(raw) * lattice.byte_weight + w) for p, w in paths(u[1:]))

    for unit in ("hello", "a€", "the\n"):
        ways = dict(paths(" " + unit))
        total = sum(map(math.exp, ways.values()))
        seen = collections.Counter(tuple(x.tolist()) for x in lattice.sample([unit] * 20_000, piece_sampling.row_seeds(list(range(20_000)), 1)))
        assert set(seen) <= set(ways)
        assert max(abs(seen[p] / 20_000 - math.exp(w) / total) for p, w in ways.items()) < 0.015


# -- the pipeline -----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {x.doc_id: x.text for x in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        after = {x.doc_id: x.text for x in kept.collect()}
        assert set(after) <= set(before)
        if name == "ngram_jaccard":
            parts = brute_components(list(before.items()), 5, 80)
            assert set(after) == {i for i, _, p in parts if i == p}
    left = kept.collect()
    tokens = {x.doc_id: len(i) + 1 for x, i in zip(left, library_ids([x.text for x in left]), strict=True)}
    pieces = collections.Counter()
    for x in corpus_pipeline.packing_stage(spark, kept, SF).collect():
        pieces[x.doc_id] += x.length
    assert pieces == collections.Counter(tokens)


def test_counts_of_every_tokenizer():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    letters = list("abcXYZ éÉßñ0123'’.,;!<|>end of text\n\t  ﬁ中文ё😀­")
    texts = ["", "<|endoftext|> a<|startoftext|>b", "it's WE'LL don'T", "É́ ǅ ŉ", *("".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tokenizer = Tokenizer.from_file(token_counts.tokenizer_path(name))
        want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert token_counts.encoder(token_counts.tokenizer_path(name), True).count(texts).tolist() == list(map(len, want))
        flat, sizes = token_counts.encoder(token_counts.tokenizer_path(name)).ids(texts)
        assert flat.tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))
    processor = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    assert token_counts.encoder(token_counts.tokenizer_path("piece_bpe_32k.model"), True).count(texts).tolist() == [len(x) for x in processor.encode(texts)]


def test_remembered_bytes_are_bounded():
    from lattica.llm.common import Recent

    known, asked = Recent(20_000), []
    find = lambda keys: asked.extend(keys) or [x.encode() for x in keys]
    for k in range(50):
        keys = ["hot", "x" * 5000, *(f"{k}-{i}" for i in range(30))]
        assert known.look_up(keys, find) == [x.encode() for x in keys]
        assert sum(map(len, (*known.young, *known.old))) < 20_000 and "x" * 5000 not in known.young
    assert asked.count("hot") < 5 and asked.count("x" * 5000) == 50


def test_unbroken_text_is_counted():
    text = "Aé9!" * 60_000
    assert token_counts.encoder(token_counts.tokenizer_path("word_bpe_49k.json"), True).count([text]).tolist() == [len(library_ids([text])[0])]


def test_pipeline_stages_one_by_one(spark, odd, none, tmp_path):
    import corpus_pipeline

    duckdb = pytest.importorskip("duckdb")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    extra = odd.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumn("line", F.lit(1)).withColumn("mark", F.lit("m"))
    for start in (whole, none.withColumn("lang", F.lit("x")).withColumn("n_chars", F.lit(0).cast("long")), extra):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            folder = f"{tmp_path}/{len(start.columns)}-{start is whole}-{k}"
            stage(spark, docs, SF).write.parquet(folder)
            found, given = spark.read.parquet(folder), docs.collect()
            if k < 4:
                assert found.columns == start.columns and found.dtypes == docs.dtypes
            rows = found.collect()
            if name == "quality_rules":
                trusted = quality_rules.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet"))
                kept = {x.doc_id for x in quality_rules.quality_rules(docs.select("doc_id", "text"), trusted).where("kept").collect()}
                assert sorted(map(repr, rows)) == sorted(repr(x) for x in given if x.doc_id in kept and len(words(x.text)) >= 10)
            elif name == "quality_classifier":
                scorer = compression_classifier.Scorer(compression_classifier.fit(*compression_classifier.fit_rows(whole, spark.read.parquet(f"{SF}/labels.parquet"))))
                assert sorted(map(repr, rows)) == sorted(repr(x) for x in given if scorer.score([(x.text or "").encode()])[0].round(9) >= 0.7)
            elif name == "line_dedup" and start is whole:
                duck = duckdb.connect()
                documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
                want = {i: (n, md5) for i, n, md5 in duck.execute(f"SELECT doc_id, n_chars_kept, text_md5 FROM ({line_dedup.ORACLE_SQL})").fetchall()}
                assert all((x.n_chars, hashlib.md5(x.text.encode()).hexdigest()) == want[x.doc_id] for x in rows)
                gone = {x.doc_id for x in given} - {x.doc_id for x in rows}
                assert all(want[i][1] == hashlib.md5(b"\n" * want[i][0]).hexdigest() for i in gone)  # nothing but line ends was left
            elif name == "ngram_jaccard":
                part = {i: c for (i, _, c) in brute_components([(x.doc_id, x.text) for x in given], 5, 80)}
                assert {x.doc_id for x in rows if x.doc_id is not None} == {i for i, c in part.items() if i == c and i is not None}
            elif name == "packing":
                want = {(x.doc_id, tuple([*ids, 2])) for x, ids in zip(given, library_ids([x.text for x in given]), strict=True)}
                pieces = collections.defaultdict(list)
                for x in rows:
                    pieces[x.doc_id].append((x.start, x.ids))
                if start is not extra:
                    assert {(i, tuple(t for _, ids in sorted(v) for t in ids)) for i, v in pieces.items()} == want
                assert sum(x.length for x in rows) == sum(len(ids) for _, ids in want) or start is extra
            docs = found


def test_workers_forget_other_operators_tables():
    from lattica.llm import common, token_counts, words

    words.word_hashes([b"one", b"two"])
    token_counts._ENCODERS["a path", True] = object()
    seen = []

    def run(batches):
        seen.append((bool(words._HASHES), bool(token_counts._ENCODERS)))
        yield from batches

    assert list(common.tidy(run, "words")([1, 2])) == [1, 2] and seen == [(True, False)]
    list(common.tidy(run)([]))
    assert seen[1] == (False, False)
