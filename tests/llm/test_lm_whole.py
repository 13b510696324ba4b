"""The language model counts over everything, adapts at every decision, and agrees with a slow version of its own."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from millrace.llm import lm


def lines():
    r = np.random.default_rng(0)
    vocabulary = ["the", "cat", "sat", "on", "Mat", "and", "a", "dog", "ran", "über", "extraordinarilylongword", "it."]
    return [" ".join(r.choice(vocabulary, int(r.integers(0, 40)))) for _ in range(60)] + ["zq xj vk " * 30, "same line of words"] + ["same line of words"] * 5


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def code_of(spark, texts):
    given = spark.createDataFrame([(0, t, True) for t in texts], "doc_id long, text string, learn boolean")
    return lm.make_code(lm._pairs(lm.token_table(lm.pack(given, lm.Settings()))))


def test_code_is_a_prefix_code(spark):
    code = code_of(spark, lines())
    for before in (10, 32, 97, 200):
        own = code.length[before * 256 : before * 256 + 256]
        assert sum(2.0 ** -int(n) for n in own) == pytest.approx(1)
        words = sorted(format(int(b), "032b")[: int(n)] for b, n in zip(code.bits[before * 256 : before * 256 + 256], own))
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


@pytest.mark.parametrize("settings", [lm.Settings(unit=1500, shard=700, window=100), lm.Settings(window=64)])
def test_scores_are_those_of_the_slow_version(spark, settings):
    """Units, shards and windows of a few hundred bytes: counts come from all training texts, whatever unit they are in."""
    rows = list(enumerate(lines()))
    got = {r.doc_id: r for r in lm.scored(table(spark, rows), settings).collect()}
    texts = [lm.normal(lm.words(t)) for _, t in rows]
    learnt = [t for (i, _), t in zip(rows, texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    code = code_of(spark, [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    # Only texts of one piece: in a longer one windows begin with the piece as well.
    short = [i for i, t in enumerate(texts) if len(t) + lm.LEAD <= settings.unit // 4]
    want = brute.mixed_bits([texts[i] for i in short], learnt, code.length, code.bits, settings)
    assert len(short) > 50
    for i, bits in zip(short, want, strict=True):
        assert got[i].bits_per_byte * len(texts[i]) == pytest.approx(bits, rel=2e-3, abs=0.05)
        assert got[i].score == pytest.approx(-bits * math.log10(2), rel=2e-3, abs=0.05)


def test_pieces_keep_the_contexts():
    text = lm.normal([b"word%d" % i for i in range(200)])
    pieces = list(lm.cut_text(text, 100))
    assert b"".join(p[lm.LEAD :] for p in pieces) == text and len(pieces) > 10
    assert all(len(p) <= 100 + lm.LEAD for p in pieces)
    padded, at = b"\n" * lm.LEAD + text, 0
    for p in pieces:
        assert p == padded[at : at + len(p)]
        at += len(p) - lm.LEAD
    whole, cut = lm.Lookup([padded], 64), lm.Lookup(pieces, 64)
    for a, b in zip(whole.orders, cut.orders, strict=True):
        assert np.array_equal(a.keys, b.keys) and np.array_equal(a.at, b.at)
    assert list(lm.cut_text(b"x" * 500 + b"\n", 100)) == [b"\n" * lm.LEAD + b"x" * 500 + b"\n"]


def test_mixing_contexts_is_a_bijection():
    for bits in lm.ORDERS.values():
        x = np.random.default_rng(1).integers(0, 1 << bits, 1000).astype(np.uint64)
        assert np.array_equal(lm.unmixed(lm.mixed(x, bits), bits), x) and int(lm.mixed(x, bits).max()) < 1 << bits


def test_numbers_come_back():
    for x in ([], [0], [3, 255], [70_000, 1], [1 << 40, 0, 5]):
        assert lm.widened(lm.narrow(np.array(x, np.uint64))).tolist() == x


def test_chances_of_all_next_bytes_add_up_to_one():
    texts = [lm.normal(t.encode().split()) for t in lines()]
    s = np.frombuffer(b"\n" + b"".join(texts), np.uint8).astype(int)
    code = lm.make_code(np.bincount(s[:-1] * 256 + s[1:], minlength=1 << 16).reshape(256, 256))
    lead, head = b"\n" * lm.LEAD, b"the cat s"

    def bits(text):
        pieces = [lead + t for t in [*texts, text]]
        look = lm.Lookup(pieces, 4096)
        learn = np.repeat(np.arange(len(pieces)) < len(texts), look.n_bytes)
        values = [lm.predictions(o.keys, np.bincount(o.at, learn, len(o.keys)).astype(np.int64), code, wide)[0] for o, wide in zip(look.orders, lm.ORDERS.values(), strict=True)]
        return lm.unit_bits(pieces, values, code, lm.Settings())[-1]

    before = bits(head)
    assert sum(2.0 ** (before - bits(head + bytes([b]))) for b in range(256)) == pytest.approx(1, abs=1e-3)


def test_held_out_text_is_better_than_by_its_words_alone(spark):
    """Words not met in training cost the unigram base little, so it is held against the bits of the known ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm.scored(docs).collect() if r.held_out]
    assert np.mean([r.bits_per_byte for r in got if r.n_tokens > 20]) < 3
    assert Counter(r.score < 0 for r in got) == {True: len(got)}


def test_weights_and_refinement_move_within_a_short_text():
    texts = [lm.normal(t.encode().split()) for t in lines()]
    s = np.frombuffer(b"\n" + b"".join(texts), np.uint8).astype(int)
    code = lm.make_code(np.bincount(s[:-1] * 256 + s[1:], minlength=1 << 16).reshape(256, 256))
    odd = [b"\n" * lm.LEAD + b"zqx " * 60 + b"\n"]
    values = [np.zeros(int(code.length[lm.code_rows(o.keys, wide)].sum()), np.int8) for o, wide in zip(lm.Lookup(odd, 2048).orders, lm.ORDERS.values(), strict=True)]
    moving = lm.unit_bits(odd, values, code, lm.Settings())[0]
    frozen = lm.unit_bits(odd, values, code, lm.Settings(rate=0.0, refine=0.0))[0]
    assert moving < frozen - 50


def test_few_calls_a_decision(monkeypatch):
    """Both chances of a decision come of one exponential, and a window's bits of one logarithm for many decisions."""
    calls = Counter()
    for name in ("exp", "log2"):
        own = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *a, f=own, name=name, **k: (calls.update([name]), f(*a, **k))[1])
    decisions, pad = 1000, np.zeros(64, np.int8)
    st = [np.concatenate([np.random.default_rng(k).integers(-100, 100, 2 * decisions).astype(np.int8), pad]) for k in range(2)]
    st[1][: 2 * decisions] = st[1][: 2 * decisions] & ~1 | st[0][: 2 * decisions] & 1
    bits = lm._advance(st, np.array([0, decisions, 2 * decisions]), lm.Settings())
    assert (bits > 0).all() and calls["exp"] == decisions and calls["log2"] == -(-decisions // 64)
