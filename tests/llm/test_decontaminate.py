"""Windows of the benchmark in documents, against a search of every place."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate
from millrace.llm.decontaminate import Settings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def wanted(docs, items, window=10):
    """A row a document: id, words, words hit, the ids of items."""
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - window + 1)) if ws else ():
            windows.setdefault(tuple(ws[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(ws) - m + 1):
                if (own := windows.get(tuple(ws[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= own
        yield doc_id, len(ws), len(hit), sorted(found)


def check(docs, bench, settings=Settings()):
    want = Counter((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, n, h, f in wanted([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], settings.window))
    assert Counter(map(tuple, decontaminate.digests(docs, bench, settings).collect())) == want
    return want


@pytest.fixture(scope="module")
def few_words(spark):
    """Texts over few words, so that windows come again and again, overlap and touch; items of all lengths, repeated and null ones."""
    r = random.Random(5)
    some = lambda n, vocab: " ".join(r.choice(vocab) for _ in range(n))
    vocab = ["a", "B", "é", "x1", "Zed"]
    items = [(i % 30, some(r.choice([0, 1, 2, 3, 4, 9, 10, 11, 25, 60]), vocab)) for i in range(40)] + [(None, "unseen words of a null item that has no id at all here"), (7, None), (8, " .,; "), (99, "a B"), (99, "a B")]
    texts = []
    for i in range(60):
        parts = [some(r.choice([0, 3, 12, 40]), vocab + ["other", "more"])] + [t or "" for _, t in r.sample(items, 2)]
        r.shuffle(parts)
        texts.append((i // 2 if i % 19 else None, " - ".join(parts).upper() if i % 3 else "; ".join(parts)))
    docs = spark.createDataFrame([*texts, (5, None), (6, ""), (6, "...")], "doc_id long, text string").withColumn("items", F.lit("mine")).withColumn("n_words", F.lit(-1))
    return docs.repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("settings", [Settings(), Settings(lane=3), Settings(held=60, piece=7), Settings(window=4, block=2), Settings(window=2, block=1, piece=1, held=20)])
def test_few_words(few_words, settings):
    assert any(c[2] for c in check(*few_words, settings))


def test_table(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert any(c[2] for c in check(docs, bench))
    check(docs, bench.filter("item_id % 3 = 0"), Settings(held=100, piece=15))


def test_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "runs along the river until it is out of sight"), (2, "SHORT item"), (3, "one"), (10, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6")], "item_id long, text string")
    assert any(c[2] for c in check(edge, bench))
    none = bench.limit(0)
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.digests(edge, none).collect()} == {(0, 0, False)}
    assert decontaminate.digests(empty, bench).count() == 0


def test_spans_and_items(spark):
    bench = spark.createDataFrame([(10, "b c d"), (9, "d e f"), (2, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A b c d e f g x")], "doc_id long, text string")
    (r,) = decontaminate.scan(docs, bench, Settings(window=3)).collect()
    assert [tuple(s) for s in r.spans] == [(1, 6), (7, 8)] and r["items"] == ["10", "2", "9"]


def test_clean(spark, edge):
    bench = spark.createDataFrame([(1, "jumps over the lazy dog and runs along the river until it")], "item_id long, text string")
    kept = decontaminate.clean(edge, bench)
    assert kept.columns == edge.columns
    bad = {r.doc_id for r in decontaminate.digests(edge, bench).filter("contaminated").collect()}
    assert bad and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in edge.collect() if not ("lazy dog and runs" in (r.text or "")))


def test_shifts_skip_places():
    """Places far from every pattern are passed over: of a text without any of the benchmark's words one in eight is looked at."""
    flat = np.arange(1, 31, dtype=np.int32)
    search = decontaminate.Search(flat, np.arange(21), [(0, 30)], 10, 3)
    seen = []
    plain = search._hash
    search._hash = lambda ids, ends, n, skip=0: (seen.append(len(ends)), plain(ids, ends, n, skip))[1]
    ids = np.zeros(8_000, np.int32)
    ids[4_000:4_012] = flat[5:17]
    at, place = search.run(ids, np.array([0]), np.array([8_000]), 8_000)
    assert sorted(at.tolist()) == [4_009, 4_010, 4_011] and search.at[place].tolist() == [5, 6, 7]
    assert sum(seen) < 1_100


def test_a_hot_window_and_equal_hashes(spark):
    """Hundreds of items with one window; and patterns that only the comparison tells apart."""
    bench = spark.createDataFrame([(i, "which of the following is the best one of all" if i < 400 else f"n{i} which of the following is the best one of") for i in range(410)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Which of the following is the best one of all?"), (2, "n405, which of the following is the best one of all")], "doc_id long, text string")
    check(docs, bench)
    check(docs, bench, Settings(held=500))
    search = decontaminate.Search(np.arange(1, 41, dtype=np.int32), np.array([0, 10, 20, 30]), [(a, 10) for a in (0, 10, 20, 30)], 10, 3)
    search.key[:] = search.key[0]  # as if all hashes were equal
    search._key = lambda ids, ends: np.full(len(ends), search.key[0])
    at, place = search.run(np.arange(1, 41, dtype=np.int32), np.array([0]), np.array([40]), 512)
    assert sorted(zip(at.tolist(), search.at[place].tolist(), strict=True)) == [(9, 0), (19, 10), (29, 20), (39, 30)]
