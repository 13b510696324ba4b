import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import common, components, jaccard, language, license, lm, mixing, packing, quality, tokens, topk

WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_quality_base(request, table):
    df = request.getfixturevalue(table)
    want = Counter((i, *brute.quality_base(t)) for i, t in pairs(df))
    got = quality.quality(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_judges_labels(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    j = quality.quality(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in j if r.quality == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)
    assert sum(r.kept for r in j if r.quality == 0) <= 0.2 * sum(r.quality == 0 for r in j)


def test_quality_filter_and_empty(edge, empty):
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(edge).collect() if r.kept}
    assert quality.quality(empty).count() == 0 == quality.keep_good(empty).count()


def test_quality_rules_are_a_table(docs):
    none = quality.quality(docs, ())
    assert none.filter("kept <> (NOT base_failed)").count() == 0
    strict = (quality.Rule("all_long", "n_words", low=1e9),)
    assert quality.quality(docs, strict).filter("kept").count() == 0


# ---------------------------------------------------------------- 2, 3


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_the_library(edge_rows, path):
    texts = [r[1] or "" for r in edge_rows] + ["a  b", " a", "a ", "a\n b", "a \n\nb", "a\t b", "　x y", "don't, we'll... (x) 1,000.5!", "a\0b c", "<|endoftext|> a <|endoftext|>b", "ǅ ß ẞ ΑΣ", "a\x1c b\x85 c", "x," * 150]
    library = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    for _ in range(2):
        assert [np.frombuffer(g, enc.wide).tolist() for g in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.style == ("word" if path == WORD else "byte")


@pytest.mark.parametrize("path,hot", [(WORD, 300_000), (WORD, 3), (BYTE, 3)])
def test_token_counts(edge, path, hot):
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(edge))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(edge, path, hot=hot).collect()) == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_token_counts_of_a_table_and_of_text_without_blanks(spark, docs, path):
    library = Tokenizer.from_file(path)
    long = spark.createDataFrame([(-1, "abc,Déf.12-" * 300), (-2, "x" * 5000 + "!" * 300), (-3, "東京都は" * 200), (-4, "ab<|endoftext|>" * 100), (-5, "a\u0301É'll" * 90)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(long)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(df))
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, path, hot=2000).collect()) == want


def test_token_counts_empty(empty):
    assert tokens.token_counts(empty, WORD).count() == 0


@pytest.mark.parametrize("table", ["edge", "docs", "empty"])
def test_token_files(spark, request, table):
    df, out = request.getfixturevalue(table), common.new_path(spark, "test")
    library = Tokenizer.from_file(BYTE)
    manifest = tokens.write_token_files(df, out, BYTE, end_id=2, partitions=3)
    got = tokens.read_token_files(manifest, out).orderBy("start").collect()
    want = Counter()
    for i, t in pairs(df):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)


# ---------------------------------------------------------------- 4


def test_mixing_targets(edge):
    got = mixing.mix(edge).collect()
    rows = [(r.doc_id, r.source, len(brute.words(r.text))) for r in edge.select("doc_id", "source", "text").collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, brute.level([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == Counter((i, n, sizes[s], round(target[s], 6)) for i, s, n in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sorted(map(tuple, mixing.mix(edge.repartition(2)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixing_comes_near(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = mixing.mix(df).join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.06 for r in by)


def test_mixing_of_the_table_is_within_its_spread(spark):
    """Every source of the real table within four times the spread that the docstring states."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("q")).collect()
    assert len(by) > 10
    for r in by:
        f = r.g / r.n % 1
        assert abs(r.t - r.g) <= 4 * (f * (1 - f) * r.q) ** 0.5 + 1


def test_mixed_rows(edge, empty):
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(edge.filter("doc_id > 5")).collect() if r.size}
    got = Counter(r.doc_id for r in mixing.mixed(edge.filter("doc_id > 5")).collect())
    assert {i: got[i] for i in taken} == taken
    assert mixing.mixed(edge).columns == edge.columns
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_license_base(request, table):
    df = request.getfixturevalue(table)
    got = license.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *brute.licenses(t)) for i, t in pairs(df))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in got)


def test_license_notices(spark, empty):
    mit = license.NOTICES["mit"][0]
    bent = mit.replace("free of charge", "freely of any charge")  # a word more: a neighbouring diagonal
    half = " ".join(mit.split()[:20])
    df = spark.createDataFrame([(1, "x y z " + mit.upper() + " end"), (2, bent), (3, half), (4, mit + " q " * 50 + mit)], "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan(df).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "mit", "", "mit"]
    assert got[1].score == 1.0 and 0.75 < got[2].score < 1 and got[4].n_base == 0
    assert license.scan(empty).count() == 0


def test_license_is_native(docs):
    plan = license.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- 6


def test_language_held_out(docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (brute.fold_of(r.doc_id, 3) == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_language_edges(edge, empty, docs):
    got = {r.doc_id: r for r in language.identify(edge).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    assert language.identify(empty).count() == 0
    assert language.keep_known(empty).columns == empty.columns
    kept = language.keep_known(docs.withColumn("token", F.lit(1)))
    assert kept.columns == [*docs.columns, "token"] and kept.count() >= 0.97 * docs.count()
    unlabelled = language.identify(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_back_off():
    m = language.Model(["a", "b"], (["ab"], np.array([[-1.0, -2.0]])), ([" x", "y", " "], np.array([[-1.0, -5.0], [-3.0, -1.0], [-1.0, -1.0]])), 3)
    s = language.Scorer(m)
    assert s.total(Counter(["ab"])).tolist() == [-1.0, -2.0]
    assert s.total(Counter(["xy"])).tolist() == pytest.approx([-5 / 3, -7 / 3])  # " x", "y", " "
    assert s.text("12 3") == ("und", 0.0)
    full = language.Scorer(m, 0)
    assert full.total(Counter({"xy": 2, "ab": 1})).tolist() == pytest.approx([-13 / 3, -20 / 3])


def test_language_is_the_slow_version(docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in rows if brute.fold_of(r.doc_id, 3) != 1 and r.lang is not None and r.text is not None]
    want = brute.languages(train, [r.text for r in rows], language.Settings().longest)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-9)


def test_language_sample_keeps_rare_languages_and_bounds_copies(spark):
    rows = [(i, "the same english text", "en") for i in range(3000)] + [(5000 + i, "petit texte", "fr") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(df, F.lit(True), language.Settings(sample=100))
    n = dict(zip(m.words[0], np.exp(m.words[1]).tolist()))
    assert m.langs == ["en", "fr"] and n["petit"][1] > n["petit"][0]
    # About a hundred copies of four words: (n + 1) / (4 n + 6 words + 1).
    copies = (1 - 7 * n["same"][0]) / (4 * n["same"][0] - 1)
    assert 60 < copies < 140


def test_two_models_stay_apart(spark, docs):
    other = docs.withColumn("lang", F.concat(F.lit("x-"), "lang"))
    one, two = language.fit(docs, F.lit(True)), language.fit(other, F.lit(True))
    for _ in range(2):
        a, b = (language.predict(docs, m).select("doc_id", "lang_pred").collect() for m in (one, two))
        assert {r.doc_id: r.lang_pred if r.lang_pred == "und" else "x-" + r.lang_pred for r in a} == {r.doc_id: r.lang_pred for r in b}


def test_language_looks_at_text_alone(docs):
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    swapped = docs.withColumn("lang", F.when(language.fold() == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(swapped).collect()} == a


# ---------------------------------------------------------------- 7


def check_packing(df, rows, capacity):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in pairs(df):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), capacity)):
            want[i, p, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("table,capacity", [("edge", 64), ("docs", 2048), ("empty", 2048)])
def test_packing(request, table, capacity):
    df = request.getfixturevalue(table)
    rows = packing.pack(df, WORD, 0, capacity).collect()
    n = check_packing(df, rows, capacity)
    assert n <= -(-sum(r.length for r in rows) // capacity) * 1.05 + 1


def test_best_fit_is_best_fit():
    """By runs as piece by piece."""
    r = np.random.default_rng(1)
    for _ in range(20):
        lengths = r.integers(1, 51, 200).tolist() + [7] * 50
        runs = packing.best_fit(Counter(lengths), 50)
        used = Counter()
        for run in runs:
            assert run.n % run.per == 0
            for k in range(run.n // run.per):
                used[run.sequence + k] += run.length * run.per
        assert sum(x.n for x in runs) == len(lengths)
        assert sorted(50 - u for u in used.values()) == brute.best_fit(lengths, 50)


# ---------------------------------------------------------------- 8


def brute_top(rows, is_query, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(256 * np.array(v, np.float64)).tolist()))
    out = []
    for q, x in good:
        if is_query(q):
            own = [int(c) for c in x]
            near = sorted((-sum(a * int(b) for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_top_k(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    small = topk.Settings(pivots=8, page=10, fanout=3, deal=15, first=2, queries=3)
    want = brute_top([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 50 == 0, 5)
    for settings in (topk.Settings(), small):
        got = topk.search(df, topk.every_nth(50), settings).select("query_id", "rank", "vec_id", "score")
        assert sorted(map(tuple, got.collect())) == want


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 0.0]), (7, [-1.0, 2.0]), (7, [3.0, 0.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (50, [2.0, -3.0]), (100, [0.1]), (101, [0.2]), (8, []), (9, [2.0**41, 1.0]), (10, [-(2.0**41), 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string")
    want = brute_top([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 50 == 0, 5)
    for settings in (topk.Settings(), topk.Settings(pivots=2, page=2, fanout=2, deal=3, first=1)):
        got = topk.search(df, topk.every_nth(50), settings).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == want
    assert topk.search(df.limit(0), topk.every_nth(50)).count() == 0


def test_top_k_spares_products(spark):
    """Clustered vectors, one of them a third of all: exact, and few of all pairs are multiplied."""
    r = np.random.default_rng(3)
    middles = r.normal(0, 4, (30, 8))
    rows = [(i, [float(x) for x in middles[i % 30] + r.normal(0, 0.05, 8)]) for i in range(3000)] + [(3000 + i, [float(x) for x in middles[0]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    computed = spark.sparkContext.accumulator(0)
    got = topk.search(df, topk.every_nth(50), topk.Settings(pivots=16, page=64, fanout=8, deal=500), computed).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_top(rows, lambda i: i % 50 == 0, 5)
    assert 0 < computed.value < 0.2 * 90 * len(rows)


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("table,k,percent", [("edge", 4, 85), ("docs", 4, 85), ("docs", 5, 80)])
def test_jaccard(request, table, k, percent):
    df = request.getfixturevalue(table)
    got = jaccard.join(df, jaccard.Settings(k, percent, 3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute.jaccard(pairs(df), k, percent)


def test_jaccard_family(spark, empty):
    """A large group of near copies about the threshold, cut into many blocks; a phrase that all share."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        ws = list(base)
        for j in r.integers(0, 60, int(r.integers(0, 3))):
            ws[j] = f"e{int(r.integers(0, 5))}"
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, "a shared passage of words " + " ".join(f"v{i}x{j}" for j in range(20))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(df, jaccard.Settings(block=40)).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in got) == brute.jaccard(rows, 4, 85)
    assert jaccard.join(empty).count() == 0


def test_buckets_meet():
    """Any two sets that link have a bucket in common, in the scheme of the smaller one's class."""
    r = np.random.default_rng(0)
    for percent in (80, 85):
        classes = jaccard.Classes(percent)
        for _ in range(300):
            n = int(r.integers(1, 120))
            a = r.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[int(r.integers(0, 1 + n // 12)) :], r.integers(0, 2**63, int(r.integers(0, 1 + n // 12))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            c = min(int(classes.of(len(a))), int(classes.of(len(b))))
            assert max(int(classes.of(len(a))), int(classes.of(len(b)))) <= c + 1
            assert len(np.intersect1d(classes.signatures(a, c), classes.signatures(b, c)))


def test_keep_one(edge, empty):
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids and ids[3] == ids[4] == 1
    assert jaccard.keep_one(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 50)] + [(300, 299), (299, 7), (500, 500)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert all(got[x] == 100 for x in range(100, 161)) and all(got[x] == 1 for x in range(1, 50)) and got[300] == got[7] == 1
    assert len(got) == 61 + 49 + 2


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("table,hot", [("edge", 5), ("docs", 300_000)])
def test_lm_base(request, table, hot):
    df = request.getfixturevalue(table)
    got = lm.scored(df, lm.Settings(unit=60_000, shard=100_000, hot=hot)).collect()
    want = brute.unigram(pairs(df), lambda i: brute.fold_of(i, 7) == 2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)
    assert all(r.score < 0 and r.held_out == (r.doc_id is not None and brute.fold_of(r.doc_id, 7) == 2) for r in got)


def test_lm_empty(empty):
    assert lm.scored(empty).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_hard_texts(path):
    """Random texts of letters, marks, blanks and special strings, short and long units, against the library."""
    import random

    r = random.Random(3)
    ends = "aZéßİıǅŉǰΣͅ½²Ⅷ٣中한ʼn" + "".join(chr(c) for c in range(0xC0, 0x250, 3))
    pieces = [*ends, *".,;:!?|-'\"()[]", " ", "  ", "\n", "\t", "\r\n", " ", "　", "̇", "́", "'ll", "'s", "<|endoftext|>", "1,000.5", "MERKEZİ", "word", "x" * 30]
    texts = ["MERKEZİ.", "İ?", "İ", "MERKEZİ. " * 60, "İ.," * 120]
    for _ in range(10_000):
        texts.append("".join(r.choice(pieces) for _ in range(r.choice((2, 3, 5, 9, 20)))))
    texts += ["".join(r.choice(pieces[:-2]) for _ in range(400)).replace(" ", "") for _ in range(50)]
    library, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(g, enc.wide).tolist() for g in enc.encode(texts)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    for t, w in zip(texts, want, strict=True):
        us = enc.units(t)
        n = len(library.encode(t, add_special_tokens=False).ids) if us is None else sum(len(enc.ids_of([p])[0]) // enc.wide.itemsize for u in us if u for p in enc.parts(u))
        assert n == len(w), t


def test_only_letters_say_a_language(spark, docs):
    rows = [(1, "½ ² 12"), (2, "Ⅷ ① ٣ ௧"), (3, ".,;! ́̇"), (4, "é"), (5, "中"), (6, "א ½"), (7, "ª")]
    texts = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-i, t, None) for i, t in rows], "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(texts).filter("doc_id < 0").collect()}
    assert {i for i, (p, _) in got.items() if p == "und"} == {-1, -2, -3}


def test_many_dirty_labels(spark):
    """Labels are rows, not columns."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.concat(F.lit("l"), F.col("id") % 700).alias("lang"))
    assert language.identify(df).count() == 3000


def test_blocks_follow_shingles(spark):
    """Groups of long near copies are cut by their shingles; links stay all the same."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: 299 - i % 7] + [f"x{i % 5}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(rows, 4, 85)
    for s in (jaccard.Settings(), jaccard.Settings(shingles=2_000), jaccard.Settings(block=7, shingles=100)):
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(df, s).collect()) == want


@pytest.mark.parametrize("huge", [[1e200, -1e200, 1e140], [1.7e305] * 3])
def test_top_k_of_huge_vectors(spark, huge):
    """Finite vectors of any norm among ordinary ones: exact, for ordinary and for huge queries."""
    r = np.random.default_rng(8)
    v = np.round(r.normal(size=(160, 4)), 3)
    for i, x in enumerate(huge):
        v[50 * (i + 1) if i % 2 == 0 else 50 * i + 7] = [x, 1.0, -x / 3, 0.5]
    v[11] = v[50]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(np.floor(256 * c)) for c in row] for row in v.tolist()]
    want = []
    for q in range(0, 160, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], x, strict=True)), i) for i, x in enumerate(whole) if i != q)[:5]
        want += [(q, k + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, i) in enumerate(scores)]
    for settings in (topk.Settings(), topk.Settings(pivots=8, page=20, fanout=4, deal=50, first=2)):
        assert sorted(map(tuple, topk.search(df, topk.every_nth(50), settings).collect())) == want


def test_top_k_writes_no_pairs(spark):
    """Where no page can be spared, the tables that a search writes still have rows by vectors and queries, not by pairs of queries and pages."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, 1, 24)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("**/*.parquet"))
    got = topk.search(df, topk.every_nth(5), topk.Settings(pivots=16, page=8, fanout=4, deal=300, queries=100)).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 5 == 0, 5)
    written = sum(pq.ParquetFile(f).metadata.num_rows for f in set(shared.glob("**/*.parquet")) - before if f.is_file())
    assert written < 30 * len(rows)
