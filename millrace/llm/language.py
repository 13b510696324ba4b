"""Operator 6: language identification by words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Bytes of text that a task looks at at once.
SLICE = 8 << 20
#: Runs of letters are words; digits, marks and signs say nothing about a language.
_WORD = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Settings:
    """sample: labelled texts of each language that the model is fitted on, about (a bound on the fit, the same at every
    size). All words and n-grams of these are kept.
    longest: characters of the longest n-grams; a word has one blank put on either side.
    """

    sample: int = 2_000
    longest: int = 4


@dataclass
class Model:
    """Features beside a row of log probabilities each, a column a language."""

    langs: list[str]
    words: tuple[list[str], np.ndarray]
    grams: tuple[list[str], np.ndarray]
    longest: int


def _grams(words: Counter, longest: int) -> Counter:
    grams: Counter = Counter()
    for w, n in words.items():
        w = f" {w} "
        for k in range(1, longest + 1):
            for i in range(len(w) - k + 1):
                grams[w[i : i + k]] += n
    return grams


def fit(docs: DataFrame, train: F.Column, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows where ``train`` holds and lang and text are not null.

    Of each language about ``sample`` rows are taken, those whose hash of doc_id
    and text is smallest: reruns agree, rare languages stay, and copies of a text
    come in by their share alone. Counts are made in the tasks and summed by
    Spark; what reaches the driver is the model of the sample. A language's
    probabilities come from its own counts, with one added to each.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"))
    # The bound is held by a threshold on the hash, so that no task has to gather and sort texts. One row a language.
    shares = {r.lang: min(1.0, settings.sample / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if any(s < 1 for s in shares.values()):
        share = F.create_map(*[F.lit(x) for at, s in sorted(shares.items()) for x in (at, s)])
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    rows = rows.drop("doc_id")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        # Words are added up by language first: n-grams are then cut from each distinct word once.
        by_lang: dict[str, Counter] = {}
        for t, at in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by_lang.setdefault(at, Counter()).update(_WORD.findall(t.lower()))
        out = {(kind, f, at): n for at, words in by_lang.items() for kind, found in enumerate((words, _grams(words, settings.longest))) for f, n in found.items()}
        kind, feature, at = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(feature, pa.string()), pa.array(at, pa.string()), pa.array(list(out.values()), pa.int64())], ["kind", "feature", "lang", "n"])

    counts = common.cut(common.map_arrow(rows, count, "kind int, feature string, lang string, n long").groupBy("kind", "feature", "lang").agg(F.sum("n").alias("n")), "language")
    totals = counts.filter("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
    langs = [r.lang for r in totals]
    if not langs:
        return Model([], ([], np.zeros((0, 0))), ([], np.zeros((0, 0))), settings.longest)
    kinds, column = [], {at: i for i, at in enumerate(langs)}
    for kind in (0, 1):
        own = counts.filter(F.col("kind") == kind)
        size = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        table = own.select("feature", "lang", "n").toArrow()  # of the sample: bounded with it
        feature, at = table.column("feature").combine_chunks().dictionary_encode(), table.column("lang").to_pylist()
        n = np.zeros((len(feature.dictionary), len(langs)))
        n[feature.indices.to_numpy(), [column[x] for x in at]] = table.column("n").to_numpy()
        kinds.append((feature.dictionary.to_pylist(), np.log((n + 1) / (np.array([size.get(at, 0) for at in langs]) + len(n) + 1))))
    return Model(langs, *kinds, settings.longest)


class Scorer:
    """Log frequencies of words, known or backed off; remembers some hundred thousand words beside those of the model."""

    def __init__(self, model: Model, room: int = 300_000) -> None:
        self.model, self.n, self.room = model, len(model.words[0]), room
        self.place = {w: i for i, w in enumerate(model.words[0])}
        self.grams = {g: i for i, g in enumerate(model.grams[0])}
        self.rows = np.zeros((self.n + room, len(model.langs)))
        self.rows[: self.n] = model.words[1]

    def back_off(self, w: str) -> np.ndarray:
        """Cover the word from the left by the longest known n-grams; what no n-gram knows says nothing.

        Mean over the pieces, so that an unseen word weighs as a known one.
        """
        w, grams, i, found = f" {w} ", self.grams, 0, []
        while i < len(w):
            for k in range(min(self.model.longest, len(w) - i), 0, -1):
                if (g := grams.get(w[i : i + k])) is not None:
                    found.append(g)
                    break
            i += k
        return self.model.grams[1][found].mean(0) if found else np.zeros(len(self.model.langs))

    def total(self, words: Counter) -> np.ndarray:
        """Sum over the words of a text of their log frequencies, a column a language."""
        at, n, out = [], [], np.zeros(len(self.model.langs))
        for w, k in words.items():
            place = self.place.get(w)
            if place is None:
                if self.n == len(self.rows) or len(w) > 40:
                    out += k * self.back_off(w)
                    continue
                place = self.place[w] = self.n
                self.rows[place] = self.back_off(w)
                self.n += 1
            at.append(place)
            n.append(k)
        return out + np.array(n, float) @ self.rows[at] if at else out

    def text(self, text: str | None) -> tuple[str, float]:
        words = Counter(_WORD.findall(text.lower())) if text else Counter()
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total = self.total(words)
        best = int(total.argmax())
        # Posterior of the winner at the mean evidence of a word times the root of their number: long texts are no more than sure.
        scale = 1 / math.sqrt(sum(words.values()))
        return self.model.langs[best], float(1 / np.exp(np.maximum(-700.0, (total - total[best]) * scale)).sum())


_scorers: list = [None, None]


def _forget() -> None:
    _scorers[:] = [None, None]


def scorer_of(model: Model) -> Scorer:
    """One Scorer a worker process and model: the tasks that follow each other share it."""
    common.claim("language", _forget)
    if _scorers[0] is not model:
        _scorers[:] = [model, Scorer(model)]
    return _scorers[1]


def predict(docs: DataFrame, model: Model, columns: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """``columns`` (name -> type; doc_id by default) of each row, lang_pred and score. Only ``text`` is looked at."""
    columns = columns or {"doc_id": "long"}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = scorer_of(shared.value)
        got = [scorer.text(t) for t in batch.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*columns, "lang_pred", "score"])

    given = docs.select(*columns, F.col(text).alias("__text"))
    return common.map_arrow(given, run, ", ".join([*[f"`{c}` {t}" for c, t in columns.items()], "lang_pred string, score double"]), SLICE)


#: Of three folds by crc32 of the doc_id as text, the one held out.
FOLDS, HELD_OUT = 3, 1


def fold(n: int = FOLDS, column: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs``.

    The model learns from text and lang of the rows outside the held-out fold; a
    prediction looks at the text alone. ``und`` with score 0 where the text is
    null or has no letter. A row with null doc_id is in no fold: not learnt from,
    held_out false. With no labelled row at all every text is ``und``. Repeated rows
    and equal doc_ids are predicted each for itself, a text of any length whole;
    languages that are equally likely: the first by code point. An empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    learnt = F.coalesce(fold() != HELD_OUT, F.lit(False))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(given, learnt, settings)
    return predict(given, model).select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, settings: Settings = Settings(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, predicted with a score of ``least`` or more; all their columns.

    A null text has none. Repeated rows are kept or go alike; columns may have any
    names; an empty table gives no rows.
    """
    learnt = F.coalesce(fold() != HELD_OUT, F.lit(False))
    model = fit(docs.select(F.col("doc_id"), "text", "lang"), learnt, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = scorer_of(shared.value)
        got = [scorer.text(t) for t in batch.column("text").to_pylist()]
        return batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= least for g in got], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema, SLICE)


def crc32_fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
