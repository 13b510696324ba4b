"""Operator 10: language-model scores by online logistic context mixing, beside a unigram base."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language import fold
from .shingles import words

#: Of seven folds by crc32 of the doc_id as text, the one held out.
FOLDS, HELD_OUT = 7, 2


@dataclass(frozen=True)
class Settings:
    """unit: bytes of text, about, that one task scores together; shard: bytes of text, about, whose contexts of one order
    are added up together; window: bytes after which a text's weights and refinement begin anew; rate, refine: steps of
    the weights and of the refinement at each decision; start: first weight of every predictor; hot: words whose counts
    are broadcast.
    """

    unit: int = 4_000_000
    shard: int = 64_000_000
    window: int = 2048
    rate: float = 0.02
    refine: float = 0.005
    start: float = 0.3
    hot: int = 300_000


#: Contexts by name: how many bytes before, or the word so far; and the bits that a context has.
ORDERS = {"four": 32, "word": 40}
#: Bytes that a context may look back; what stands before a text are end marks.
LEAD = 24
END = 10
#: Decisions that all windows take before their bits are added up.
_STEPS = 64
#: Stretched probabilities go through the shuffle in eighths.
_FINE = 8.0
#: Bytes whose decisions are laid out in one go.
_PART = 1 << 18
#: Chance that a bit has at least.
_LEAST = 2.0**-14


def normal(ws: list[bytes]) -> bytes:
    """What the model codes: the words, one blank between them, and an end mark."""
    return b" ".join(ws) + b"\n"


# ---------------------------------------------------------------- the code of decisions


@dataclass
class Code:
    """Prefix codes of the byte values, one for each byte before: row ``before * 256 + byte`` has a length and bits, from the top of 32."""

    length: np.ndarray
    bits: np.ndarray


def huffman(histogram: np.ndarray) -> list[tuple[int, int]]:
    """(length, bits) of each byte value; every one has a code, met or not, and none is rarer than one in 4096 here."""
    least = int(histogram.sum()) // 4096 + 1
    heap: list[tuple[int, int, object]] = [(max(int(n), least), i, i) for i, n in enumerate(histogram)]
    heapq.heapify(heap)
    following = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], following, (a[2], b[2])))
        following += 1
    out, stack = [(0, 0)] * 256, [(heap[0][2], 0, 0)]
    while stack:
        at, length, bits = stack.pop()
        if isinstance(at, tuple):
            stack += [(at[0], length + 1, bits * 2), (at[1], length + 1, bits * 2 + 1)]
        else:
            out[at] = (length, bits << (32 - length))
    return out


def make_code(pairs: np.ndarray) -> Code:
    """From a 256 x 256 table of how often a byte follows another; what follows nothing met shares one code."""
    plain = huffman(pairs.sum(0))
    rows = [x for b in range(256) for x in (huffman(pairs[b]) if pairs[b].any() else plain)]
    return Code(np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.uint64))


# ---------------------------------------------------------------- contexts

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_STEP = 0x2545F4914F6CDD1D


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of ``bits`` bits: contexts that are alike get far apart."""
    mask = np.uint64((1 << bits) - 1)
    x = x * np.uint64(_ODD[0]) & mask
    x ^= x >> np.uint64(bits // 2)
    return x * np.uint64(_ODD[1]) & mask


def unmixed(x: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    x = x * np.uint64(pow(_ODD[1], -1, 1 << 64)) & mask
    x ^= x >> np.uint64(bits // 2)
    return x * np.uint64(pow(_ODD[0], -1, 1 << 64)) & mask


def _powers(of: int) -> np.ndarray:
    x = np.full(_BLOCK + 64, of, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


#: Places that are looked at in one go, and the powers of a step and of its inverse.
_BLOCK = 1 << 15
_POWER, _INVERSE = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def grams(s: np.ndarray) -> np.ndarray:
    """The number of (context, byte) at every place of ``s`` from LEAD on, a row an order: the mixed context, then the byte.

    A context's lowest byte is the byte before. Four bytes are exact; the word
    so far (16 bytes of it at most) is a hash of 32 bits.
    """
    out = np.empty((len(ORDERS), len(s) - LEAD), np.uint64)
    for a in range(0, out.shape[1], _BLOCK):
        part = s[a : a + _BLOCK + LEAD]
        n = len(part) - LEAD
        u = part.astype(np.uint64)
        byte, ctx = u[LEAD:], u[LEAD - 1 : -1].copy()
        for k in range(2, 5):
            ctx |= u[LEAD - k : LEAD - k + n] << np.uint64(8 * (k - 1))
        out[0, a : a + n] = mixed(ctx, ORDERS["four"]) << np.uint64(8) | byte
        at = np.arange(LEAD, LEAD + n)
        # Where the word that goes on after each byte began; its last 16 bytes count.
        start = np.maximum.accumulate(np.where((part == 32) | (part == END), np.arange(1, len(part) + 1), 0))
        first = np.maximum(start[LEAD - 1 : -1], at - 16)
        # Sums of letters times powers of their places; the power of the first place is divided out.
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((u + np.uint64(7)) * _POWER[: len(u)], out=total[1:])
        word = (total[LEAD:-1] - total[first]) * _INVERSE[first]
        word = (word ^ (word >> np.uint64(29))) * np.uint64(_ODD[0]) >> np.uint64(32)
        out[1, a : a + n] = mixed(word << np.uint64(8) | u[LEAD - 1 : -1], ORDERS["word"]) << np.uint64(8) | byte
    return out


class Index:
    """The distinct (context, byte) of one order in a text, sorted, and for each place which one stands there."""

    def __init__(self, keys: np.ndarray) -> None:
        of, met = pd.factorize(keys)
        order = np.argsort(met)
        self.keys = met[order]
        rank = np.empty(len(met), np.int32)
        rank[order] = np.arange(len(met), dtype=np.int32)
        self.at = rank[of]


def code_rows(keys: np.ndarray, bits: int) -> np.ndarray:
    """Row in the code of each (context, byte): the byte before is the context's lowest."""
    return ((unmixed(keys >> np.uint64(8), bits) & np.uint64(255)) << np.uint64(8) | (keys & np.uint64(255))).astype(np.int64)


def stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log odds of a 1, in eighths."""
    return np.rint(np.clip(np.log((one + 0.4) / (zero + 0.4)), -7.8, 7.8) * _FINE).astype(np.int8)


def predictions(keys: np.ndarray, n: np.ndarray, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What each context says at the decisions that code its byte: (values one after the other, how many each key has).

    A value holds the stretched probability in its upper bits and the decision,
    which the byte alone determines, in the lowest.

    ``keys`` are sorted and whole contexts. Under a context, the bytes whose
    codes begin alike stand side by side; their counts, split by the next bit,
    are the zeros and ones met there.
    """
    rows = code_rows(keys, bits)
    length = code.length[rows]
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.int8)
    context = np.cumsum(np.concatenate([[0], (keys[1:] >> np.uint64(8)) != (keys[:-1] >> np.uint64(8))])) if len(keys) else np.zeros(0, np.int64)
    place = context.astype(np.uint64) << np.uint64(32) | code.bits[rows]
    left = np.argsort(place)
    place, count = place[left], n[left].astype(np.int64)
    for d in range(int(length.max(initial=0))):
        on = length[left] > d
        if not on.all():
            left, place, count = left[on], place[on], count[on]
        same = place >> np.uint64(32 - d)
        edge = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        bit = (place >> np.uint64(31 - d) & np.uint64(1)).astype(np.int64)
        total, one = np.add.reduceat(count, edge), np.add.reduceat(count * bit, edge)
        out[start[left] + d] = np.repeat(stretched(total - one, one) << 1, np.diff(np.append(edge, len(left)))) | bit
    return out, length


# ---------------------------------------------------------------- mixing


class Lookup:
    """The pieces of a unit, each behind its lead: the distinct (context, byte) of each order, where they stand, and the windows."""

    def __init__(self, pieces: list[bytes], window: int) -> None:
        s = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        keep = np.ones(len(s), bool)
        for k in range(LEAD):
            keep[starts + k] = False
        self.keep = keep[LEAD:]
        keys = grams(s)
        self.orders = [Index(keys[k][self.keep]) for k in range(len(ORDERS))]
        self.rows = (s[LEAD - 1 : -1].astype(np.uint16) * np.uint16(256) + s[LEAD:])[self.keep]
        # A piece's bytes in windows: all of the same size but the last.
        self.n_bytes = ends - starts - LEAD
        n = -(-self.n_bytes // window)
        self.piece = np.repeat(np.arange(len(pieces)), n)
        rank = np.arange(len(self.piece)) - np.repeat(np.cumsum(n) - n, n)
        self.sizes = np.minimum(window, self.n_bytes[self.piece] - rank * window)


def bits_of(look: Lookup, values: list[np.ndarray], code: Code, settings: Settings) -> np.ndarray:
    """Bits of each window.

    All windows advance together, a decision each: predictors of every order,
    stretched, are combined by the weights that the gate picks (whether the word
    so far tells anything), and the result is refined by a scale and a shift
    that follow what came true. After each decision the window's own weights,
    scale and shift move. What a window gets does not depend on those beside it.
    """
    first_value = [(np.cumsum(size) - size).astype(np.int32) for size in (code.length[code_rows(o.keys, wide)] for o, wide in zip(look.orders, ORDERS.values(), strict=True))]
    edges = np.concatenate([[0], np.cumsum(look.sizes)])
    decisions, ends, done = [[] for _ in values], [np.zeros(1, np.int64)], 0
    # Decisions are laid out some windows at a time, which then advance all together.
    cuts = [0, *(np.flatnonzero(np.diff(edges[1:] // _PART)) + 1).tolist(), len(look.sizes)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        at = slice(edges[i], edges[j])
        length = code.length[look.rows[at]]
        stop = np.cumsum(length)
        first, run = stop - length, np.arange(int(length.sum()), dtype=np.int32)
        for k, (o, v) in enumerate(zip(look.orders, values, strict=True)):
            place = np.repeat((first_value[k][o.at[at]] - first).astype(np.int32), length)
            place += run
            decisions[k].append(v.take(place))
        ends.append(done + stop[edges[i + 1 : j + 1] - 1 - edges[i]])
        done += len(run)
    if not done:
        return np.zeros(len(look.sizes))
    # Some more stand behind the last ones, so that _STEPS can be read from any place.
    pad = np.zeros(_STEPS, np.int8)
    return _advance([np.concatenate([*decisions.pop(0), pad]) for _ in values], np.concatenate(ends), settings)


def _advance(st: list[np.ndarray], ends: np.ndarray, settings: Settings) -> np.ndarray:
    """Bits of windows whose decisions stand one after the other, parted at ``ends``; predictions as predictions() gives them, and _STEPS more values."""
    total = np.diff(ends)
    order = np.argsort(-total, kind="stable")
    start, total = ends[:-1][order], total[order]
    lanes = len(order)
    # A gate's weights meet zeros where another gate is open: no window's weights are ever looked up. The shut gate's
    # weights of the word, which says nothing then, would meet zeros alone and are left out.
    w, scale, shift = np.full((3, lanes), -settings.start, np.float32), np.ones(lanes, np.float32), np.zeros(lanes, np.float32)
    cost, steps_of = np.zeros(lanes), np.array([[settings.rate], [settings.refine]], np.float32)
    four, word = (np.lib.stride_tricks.sliding_window_view(v, _STEPS) for v in st)
    for t in range(0, int(total[0]), _STEPS):
        # Those that still decide are always the first ones; who ends within these steps goes on with what does not count.
        live = int(np.searchsorted(-total, -t))
        steps, at = min(_STEPS, int(total[0]) - t), start[:live] + t
        own = np.ascontiguousarray(four[at].T[:steps]), np.ascontiguousarray(word[at].T[:steps])
        bs = (own[0] & 1).astype(np.float32)
        x = np.empty((steps, 3, live), np.float32)
        np.multiply(own[0] >> 1, np.float32(1 / _FINE), out=x[:, 0])
        np.multiply(own[1] >> 1, np.float32(1 / _FINE), out=x[:, 2])
        np.multiply(x[:, 0], x[:, 2] != 0, out=x[:, 1])
        x[:, 0] -= x[:, 1]
        # Weights, shift and sums are kept with the other sign, which is the one that the exponential takes.
        w, scale, shift = w[:, :live], scale[:live], shift[:live]
        error, sums, product, moved = np.empty((steps, 2, live), np.float32), np.empty((2, live), np.float32), np.empty((3, live), np.float32), np.empty((2, live), np.float32)
        dot, refined = sums
        with np.errstate(over="ignore"):  # an endless exponential is a chance of nothing
            for own_x, b, e in zip(x, bs, error, strict=True):
                np.multiply(w, own_x, out=product)
                np.add.reduce(product, 0, out=dot)
                np.multiply(dot, scale, out=refined)
                refined += shift
                np.exp(sums, out=e)
                e += 1
                np.reciprocal(e, out=e)
                np.subtract(b, e, out=e)
                np.multiply(e, steps_of, out=moved)
                np.multiply(own_x, moved[0], out=product)
                w -= product
                shift -= moved[1]
                moved[1] *= dot
                scale -= moved[1]
        # Neither bit is ever out of the question.
        chance = np.abs(error[:, 1])
        np.multiply(chance, np.float32(2 * _LEAST - 1), out=chance)
        chance += np.float32(1 - _LEAST)
        chance[np.arange(t, t + steps)[:, None] >= total[None, :live]] = 1
        # _STEPS chances of _LEAST at least are no smaller together than a double can be.
        cost[:live] -= np.log2(np.multiply.reduce(chance, 0, dtype=np.float64))
    out = np.zeros(lanes)
    out[order] = cost
    return out


def unit_bits(pieces: list[bytes], values: list[np.ndarray], code: Code, settings: Settings) -> np.ndarray:
    """Bits of each piece of a unit."""
    look = Lookup(pieces, settings.window)
    return np.bincount(look.piece, bits_of(look, values, code, settings), len(pieces))


# ---------------------------------------------------------------- Spark


def unit_words(pieces: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, which of them each token is, its piece) of pieces in normal form; a piece ends with a word."""
    split = pc.split_pattern(pa.array([p[LEAD:].rstrip(b" \n") for p in pieces], pa.binary()), b" ")
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    met = split.flatten().dictionary_encode()
    of, piece = met.indices.to_numpy(), np.repeat(np.arange(len(pieces)), n)
    there = of != pc.index(met.dictionary, pa.scalar(b"")).as_py()  # of a piece without words
    return met.dictionary, of[there], piece[there]


def token_table(units: DataFrame) -> DataFrame:
    """(token, c) of the training texts of ``units``: words, and '' for the end of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for b in batches for u in b.to_pylist()):
            learnt = [p for p, learn in zip(unpack(unit["text"], unit["size"]), unit["learn"], strict=True) if learn]
            if learnt:
                kinds, of, _ = unit_words(learnt)
                n = np.bincount(of, minlength=len(kinds))
                ends = sum(p.endswith(b"\n") for p in learnt)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([b""], pa.binary()), kinds]), pa.array([ends, *n.tolist()], pa.int64())], ["token", "c"])

    return units.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0")


def _pairs(counts: DataFrame) -> np.ndarray:
    """How often each byte follows another in the normal form of the training texts, from the table of words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(1 << 16)
        for k in range(0, batch.num_rows, 50_000):
            tokens = batch.column("token")[k : k + 50_000].to_pylist()
            c = np.array(batch.column("c")[k : k + 50_000].to_pylist(), np.float64)
            # Each word with the blank on either side; an end mark follows a blank here.
            s = np.frombuffer(b"".join(b" %b " % t if t else b" \n " for t in tokens), np.uint8).astype(np.int64)
            of = np.repeat(np.arange(len(tokens)), [max(1, len(t)) + 2 for t in tokens])
            pair = s[:-1] * 256 + s[1:]
            total += np.bincount(pair, c[of[:-1]] * (of[:-1] == of[1:]), 1 << 16)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in common.map_arrow(counts, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        out[r.pair] = r.n
    return out.reshape(256, 256)


_UNIT = "unit long, doc_id array<long>, row array<long>, learn array<boolean>, size array<long>, text binary"
_UNIT_ARROW = pa.schema([("unit", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("row", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("text", pa.binary())])


def cut_text(text: bytes, most: int) -> Iterator[bytes]:
    """A text as pieces of about ``most`` bytes that end after a blank, each behind the LEAD bytes before it (end marks at first)."""
    a, lead = 0, bytes([END]) * LEAD
    while a < len(text):
        b = len(text) if len(text) - a <= most else (text.rfind(b" ", a, a + most) + 1 or text.find(b" ", a + most) + 1 or len(text))
        yield lead + text[a:b]
        lead, a = (lead + text[max(a, b - LEAD) : b])[-LEAD:], b


def pack(given: DataFrame, settings: Settings) -> DataFrame:
    """Rows (doc_id, text, learn) as units of about ``unit`` bytes of texts in normal form, a row each; a longer text goes in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, rows, held, size = common.RowIds(), common.RowIds(), [], 0

        def unit() -> pa.RecordBatch:
            row = {"unit": units.take(1)[0], "doc_id": [h[0] for h in held], "row": [h[1] for h in held], "learn": [h[2] for h in held], "size": [len(h[3]) for h in held], "text": packed(b"".join(h[3] for h in held))}
            return pa.RecordBatch.from_pylist([row], _UNIT_ARROW)

        for batch in batches:
            for doc_id, t, learn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "learn")), strict=True):
                row = rows.take(1)[0]
                for piece in cut_text(normal(words(t)), settings.unit // 4):
                    held.append((doc_id, row, learn, piece))
                    size += len(piece)
                    if size >= settings.unit:
                        yield unit()
                        held, size = [], 0
        if held:
            yield unit()

    return common.bounded(given.select("doc_id", "text", "learn")).mapInArrow(run, _UNIT)


def unpack(text: bytes, sizes: list[int]) -> list[bytes]:
    """The pieces of a unit, each behind its lead."""
    text, ends = unpacked(text), np.cumsum(sizes).tolist()
    return [text[b - n : b] for b, n in zip(ends, sizes, strict=True)]


def packed(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def unpacked(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers by their lowest bytes, then the next ones: as many as the largest needs, zeros side by side."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return packed(bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())


def widened(b: bytes) -> np.ndarray:
    b = unpacked(b)
    out = np.zeros(((len(b) - 1) // b[0], 8), np.uint8)
    out[:, : b[0]] = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1).T
    return out.view("<u8")[:, 0]


def asks(unit: dict, settings: Settings, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(order, shard, contexts with their bytes, counts in training texts) of a unit; shards are ranges of mixed contexts."""
    look = Lookup(unpack(unit["text"], unit["size"]), settings.window)
    learn = np.repeat(np.array(unit["learn"], np.float64), look.n_bytes)
    for k, (order, wide) in enumerate(zip(look.orders, ORDERS.values(), strict=True)):
        n = np.bincount(order.at, learn, len(order.keys)).astype(np.uint64)
        edges = np.searchsorted(_shard(order.keys, wide, shards), np.arange(shards + 1)).tolist()
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                yield k, i, narrow(np.diff(order.keys[a:b], prepend=np.uint64(0))), narrow(n[a:b])


def _shard(keys: np.ndarray, wide: int, shards: int) -> np.ndarray:
    """Rises with the key; all bytes of a context are in one shard."""
    return (((keys >> np.uint64(8)) >> np.uint64(wide - 16)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


def answers(order: int, keys: list[bytes], counts: list[bytes], code: Code) -> list[bytes]:
    """To each unit of a shard, from the counts of all: the predictions at its keys, in their order."""
    asked = [np.cumsum(widened(k)) for k in keys]
    look = Index(np.concatenate(asked))
    n = np.bincount(look.at, np.concatenate([widened(c) for c in counts]).astype(np.float64), len(look.keys)).astype(np.int64)
    values, size = predictions(look.keys, n, code, list(ORDERS.values())[order])
    start, out, at = np.cumsum(size) - size, [], 0
    for k in asked:
        own = look.at[at : at + len(k)]
        at += len(k)
        stop = np.cumsum(size[own])
        out.append(packed(values[np.arange(int(stop[-1])) + np.repeat(start[own] - stop + size[own], size[own])].tobytes()))
    return out


def with_predictors(units: DataFrame, code: Code, settings: Settings):
    """``units`` beside the answers that each gets: a cogroup by unit.

    The counts (order, context, byte) of all training texts are a table that
    grows with them and is held by no task: every unit sends its distinct
    contexts and bytes, with the counts of its own training texts, to shards; a
    shard adds them up and answers each unit. A frequent context comes to its
    shard once a unit, however often the texts repeat it.
    """
    shared = units.sparkSession.sparkContext.broadcast(code)
    size, n_units = units.agg(F.coalesce(F.sum(F.expr("aggregate(size, 0L, (a, x) -> a + x)")), F.lit(0)), F.count("*")).first()
    shards = min(1 << 16, max(4, -(-size // settings.shard)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for b in batches for u in b.to_pylist()):
            got = list(asks(unit, settings, shards))
            cols = zip(*got, strict=True) if got else ([], [], [], [])
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([unit["unit"]] * len(got), pa.int64()), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], ["unit", "ord", "shard", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        got = answers(table.column("ord")[0].as_py(), table.column("keys").to_pylist(), table.column("counts").to_pylist(), shared.value)
        return table.select(["unit", "ord", "shard"]).append_column("values", pa.array(got, pa.binary()))

    asked = units.mapInArrow(ask, "unit long, ord int, shard int, keys binary, counts binary")
    told = asked.repartition(shards * len(ORDERS), "ord", "shard").groupBy("ord", "shard").applyInArrow(answer, "unit long, ord int, shard int, values binary")
    parts = max(1, min(n_units, 1 << 16))
    return units.repartition(parts, "unit").groupBy("unit").cogroup(told.repartition(parts, "unit").groupBy("unit"))


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base_score double, bits double, n_bytes long, token binary, f long"


def score(docs: DataFrame, learn: F.Column, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: a row per row of ``docs``.

    Rows where ``learn`` holds are learnt from. The base is a unigram model: its
    counts are a table, of which the ``hot`` most frequent words reach the tasks
    by broadcast and the rest by a join of (word, document, frequency) rows. The
    score comes from the mixer: texts are coded byte by byte as decisions of a
    prefix code; for each, two predictors (in the context of the four bytes before,
    and of the word so far), counted over all training texts, are combined by
    weights that the decision's gate picks and refined by a scale and a shift.
    Weights and refinement begin alike for every ``window`` bytes of a text, and
    at the pieces of a text that is longer than a unit, and move after each
    decision; contexts go on across windows. Both scores are log10 probabilities of the tokens; the
    mixer's text is the words with one blank between and an end mark.

    Null text is empty: one token, the end. Without any training row N and V are
    0. Repeated rows are learnt from and scored each for itself, whatever their
    ids; a null doc_id is an id like others. A text of any length is scored whole, in
    pieces that tasks hold one unit at a time (a single word is not cut). Other
    columns, whatever their names, are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    units = common.cut(pack(given, settings), "units")
    counts = common.cut(token_table(units), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    base = math.log10(n + v + 1)
    code = make_code(_pairs(counts))
    top = common.frequent(counts, "c", settings.hot).toArrow()
    end = counts.filter(F.length("token") == 0).first()  # the end mark is known to every task, frequent or not
    shared = spark.sparkContext.broadcast((code, top.column("token").combine_chunks(), np.log10(top.column("c").to_numpy() + 1.0), math.log10(end.c + 1) if end else None))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        code, known, logs, end_log = shared.value
        unit = left.to_pylist()[0]
        pieces = unpack(unit["text"], unit["size"])
        by_order: list[dict[int, bytes]] = [{} for _ in ORDERS]
        for k, shard, b in zip(*(right.column(c).to_pylist() for c in ("ord", "shard", "values")), strict=True):
            by_order[k][shard] = b
        values = [np.frombuffer(b"".join(unpacked(own[i]) for i in sorted(own)), np.int8) for own in by_order]
        bits = unit_bits(pieces, values, code, settings).tolist()
        kinds, of, piece = unit_words(pieces)
        found = pc.index_in(kinds, known).fill_null(-1).to_numpy()
        log, met = np.append(logs, 0.0)[found], found >= 0
        ends = np.array([p.endswith(b"\n") for p in pieces])
        size = np.bincount(piece, minlength=len(pieces)) + ends
        here = met[of]
        n_known = np.bincount(piece[here], minlength=len(pieces)) + ends * (end_log is not None)
        total = np.bincount(piece[here], log[of[here]], len(pieces)) + ends * (end_log or 0.0) - size * base
        pairs, freq = np.unique(piece[~here].astype(np.int64) * len(kinds) + of[~here], return_counts=True)
        tokens, at = kinds.take(pa.array(pairs % max(1, len(kinds)))), np.array(unit["row"], np.int64)[pairs // max(1, len(kinds))].tolist()
        own = list(zip(size.tolist(), n_known.tolist(), total.tolist(), (len(p) - LEAD for p in pieces), strict=True))
        cold = lambda kind: pa.nulls(len(tokens), kind)
        join = lambda a, kind: pa.concat_arrays([pa.array(a, kind), cold(kind)])
        # A piece's own row has a key that no word can have, for it holds a blank: rows spread evenly over the join.
        keys = [b"%d %d" % (unit["unit"], i) for i in range(len(own))]
        return pa.table(
            {
                "row": pa.array([*unit["row"], *at], pa.int64()),
                "doc_id": join(unit["doc_id"], pa.int64()),
                "n_tokens": join([o[0] for o in own], pa.int64()),
                "n_known": join([o[1] for o in own], pa.int64()),
                "base_score": join([o[2] for o in own], pa.float64()),
                "bits": join(bits, pa.float64()),
                "n_bytes": join([o[3] for o in own], pa.int64()),
                "token": pa.concat_arrays([pa.array(keys, pa.binary()), tokens]),
                "f": pa.array([*([0] * len(own)), *freq.tolist()], pa.int64()),
            }
        )

    rows = with_predictors(units, code, settings).applyInArrow(run, _SCORED)
    joined = rows.join(counts, "token", "left")
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("f")).otherwise(0))).alias("n_known"),
        (F.sum("base_score") + F.sum(F.col("f") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))).alias("base_score"),
        F.sum("bits").alias("bits"),
        F.sum("n_bytes").alias("n_bytes"),
    )
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (-F.col("bits") * math.log10(2)).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def scored(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """score() with the held-out fold: doc_id, held_out, then its columns. Rows with null doc_id are in no fold and not learnt from."""
    out = score(docs, fold(FOLDS) != HELD_OUT, settings)
    return out.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
