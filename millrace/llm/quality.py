"""Operator 1: quality rules, a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

#: Frequent function words; a text of some length without any is hardly prose.
STOP_WORDS = """
the be to of and that have with is was are for in on it this from
le la les de des et un une est que qui pour dans du en au pas
der die das und ist mit von den dem ein eine zu im sich auf nicht
el los las del una por para con no se su y es al lo
""".split()


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure`` lies outside [low, high]; looked at from ``from_words`` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 1

    def sql(self) -> str:
        out = [f"({self.measure}) < {self.low}D"] * (self.low is not None) + [f"({self.measure}) > {self.high}D"] * (self.high is not None)
        return f"(n_words >= {self.from_words} AND ({' OR '.join(out)}))"


#: Measures are SQL over the counts that measured() names; all ratios are of doubles.
RULES = (
    Rule("word_length", "word_chars / n_words", 2, 30),
    Rule("symbol_ratio", "n_symbols / n_words", high=0.25),
    Rule("alpha_words", "n_alpha_words / n_words", low=0.55),
    Rule("stop_words", "n_stop_words / n_words", low=0.01, from_words=50),
    Rule("dup_lines", "n_dup_lines / n_lines", high=0.4),
    Rule("dup_line_chars", "dup_line_chars / greatest(n_chars, 1)", high=0.3),
    Rule("shouting", "n_upper_words / n_words", high=0.5, from_words=10),
    Rule("bullet_lines", "n_bullet_lines / n_lines", high=0.9, from_words=10),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", high=0.3, from_words=10),
)

#: Contract of every document: at least so many words, at most so large a part in repeated windows.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


def measured(docs: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``docs`` as column ``__row`` (a struct) beside the counts that rules are made of. Null text has no words."""
    t = "__t"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words or STOP_WORDS)
    word_hash = ", ".join(["__words[i]", *(f"__words[i + {k}]" for k in range(1, WINDOW))])
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias(t))
    split = base.selectExpr("__row", t, f"filter(split({t}, r'{BLANKS}', -1), w -> w <> '') AS __words", rf"filter(split({t}, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]') AS __lines")
    hashed = split.selectExpr(
        "*",
        f"CASE WHEN size(__words) >= {WINDOW} THEN transform(sequence(0, size(__words) - {WINDOW}), i -> xxhash64({word_hash})) ELSE array() END AS __hashes",
        "array_distinct(__lines) AS __once",
    )
    # Windows are sorted only in the few texts where one comes twice.
    sorted_ = hashed.selectExpr("*", "CASE WHEN size(array_distinct(__hashes)) < size(__hashes) THEN sort_array(transform(__hashes, (h, i) -> struct(h AS h, i AS i))) ELSE array() END AS __sorted")
    starts = sorted_.selectExpr("*", "sort_array(transform(filter(__sorted, (x, j) -> (j > 0 AND get(__sorted, j - 1).h = x.h) OR get(__sorted, j + 1).h = x.h), x -> x.i)) AS __starts")
    counts = [
        "CAST(size(__words) AS LONG) AS n_words",
        "CAST(length(array_join(__words, '')) AS LONG) AS word_chars",
        f"CAST(regexp_count({t}, '[#*$%&|<>]') AS LONG) AS n_symbols",
        "CAST(size(__lines) - size(__once) AS LONG) AS n_dup_lines",
        f"CAST(aggregate(__starts, struct(-{WINDOW} AS last, 0 AS n), (a, p) -> struct(p AS last, a.n + least({WINDOW}, p - a.last) AS n), a -> a.n) AS LONG) AS n_repeat_words",
        "CAST(size(__lines) AS LONG) AS n_lines",
        f"CAST(length({t}) AS LONG) AS n_chars",
        "CAST(length(array_join(__lines, '')) - length(array_join(__once, '')) AS LONG) AS dup_line_chars",
        r"CAST(size(filter(__words, w -> w rlike '\\p{L}')) AS LONG) AS n_alpha_words",
        r"CAST(size(filter(__words, w -> w rlike '^[^\\p{Ll}]*\\p{Lu}[^\\p{Ll}]*$')) AS LONG) AS n_upper_words",
        f"CAST(size(filter(__words, w -> lower(w) IN ({stops}))) AS LONG) AS n_stop_words",
        r"CAST(size(filter(__lines, l -> l rlike '^\\s*[-*•]')) AS LONG) AS n_bullet_lines",
        r"CAST(size(filter(__lines, l -> l rlike '(\\.\\.\\.|…)\\s*$')) AS LONG) AS n_ellipsis_lines",
    ]
    # A generator ends the chain: a filter on a count would be pushed below the projections, and the measures written into it over and over.
    return starts.selectExpr("__row", f"inline(array(struct({', '.join(counts)})))")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """measured() with ``base_failed``, ``broken`` (names of the rules that a text breaks) and ``kept``.

    A text fails the base with fewer than MIN_WORDS words, or with more than
    MAX_REPEAT_PERCENT of its words in WINDOW-word windows that come twice or
    more. Everything is one row's own matter: repeated rows get equal rows, an
    empty table an empty result, extra columns stay inside ``__row``.
    """
    broken = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in rules)
    return measured(docs, text).selectExpr(
        "*",
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed",
        f"array_compact(array({broken})) AS broken",
    ).selectExpr("*", "NOT base_failed AND size(broken) = 0 AS kept")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` with its counts and verdict.

    Null and empty texts have no words and fail the base. A text of any length is
    measured whole, inside its row. Repeated rows and equal or null doc_ids get a
    row each; an empty table gives none; extra columns, whatever their names, stay out.
    """
    return judged(docs, rules).selectExpr("__row.doc_id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "array_join(broken, ',') AS broken_rules")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with all their columns; null and empty texts go, repeated rows stay repeated."""
    return judged(docs, rules).filter("kept").select("__row.*")


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """quality() over table ``documents`` as DuckDB SQL."""
    stops = ", ".join("'" + w + "'" for w in STOP_WORDS)
    broken = ", ".join(f"CASE WHEN {r.sql().replace('D)', ')').replace('D OR', ' OR')} THEN '{r.name}' END" for r in rules)
    blank = "[^\\x20\\x09-\\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{blank}+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{blank}')) AS lines FROM d),
w AS (SELECT r, i, list_aggregate(words[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM w) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
m AS (SELECT s.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(t) AS n_chars,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0) AS dup_line_chars,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
  len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) AS n_upper_words,
  len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
  len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM s LEFT JOIN covered USING (r)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, list_filter([{broken}], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS broken_rules FROM j
"""
