"""Operator 11: fill-in-middle texts, cut at the zero-width boundaries of a unit grammar."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LAST = "\U0010ffff"


@dataclass(frozen=True)
class Grammar:
    """Units by what stands side by side: ``classes`` are Java character classes that each code point is in exactly one of;
    two neighbours stay in one unit where their pair of classes is in ``joined``.
    """

    classes: dict[str, str]
    joined: frozenset[tuple[str, str]] = field(default_factory=frozenset)

    def boundary(self) -> str:
        """A regex without width that matches between two units and nowhere else, neither before nor after the text.

        Left of any place stands a code point of one class, so an alternative a
        class is enough: what it looks ahead to are the classes that it is not joined with.
        """
        out = []
        for left, before in self.classes.items():
            after = [c for name, c in self.classes.items() if (left, name) not in self.joined]
            if after:
                # The regex engine looks back by code points, and not by halves of a pair, only past a group with a code point above the first plane.
                whole = before if LAST in before else f"[{before}&&[\\x{{0}}-{LAST}]]"
                out.append(f"(?<={whole})(?={after[0] if len(after) == 1 else '[' + ''.join(after) + ']'})")
        return "|".join(out)


def _together(*names: str) -> frozenset[tuple[str, str]]:
    """Each class joined with itself."""
    return frozenset((n, n) for n in names)


#: code_points: one each. words: the blanks before a word belong to it. lines: a line ends after its newline.
#: tokens: runs of letters, of digits and of blanks; any other code point by itself.
GRAMMARS = {
    "code_points": Grammar({"any": rf"[\x{{0}}-{LAST}]"}),
    "words": Grammar({"blank": r"[\x20\x09-\x0D]", "other": r"[^\x20\x09-\x0D]"}, _together("blank", "other") | {("blank", "other")}),
    "lines": Grammar({"end": r"[\n]", "other": r"[^\n]"}, _together("other") | {("other", "end")}),
    "tokens": Grammar({"letter": r"[\p{L}]", "digit": r"[\p{N}]", "blank": r"[\x20\x09-\x0D]", "sign": r"[^\p{L}\p{N}\x20\x09-\x0D]"}, _together("letter", "digit", "blank")),
}


@dataclass(frozen=True)
class Settings:
    """seed: begins what is hashed for a document's draws; plain_from: percent of the draws from which on a text stays as it
    is; spm_below: percent of the others that get their suffix first; the marks stand before prefix, suffix and middle.
    """

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text, which joined are the text again; an empty text has none (a split would give an empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def _draw(digest: Column, nth: int) -> Column:
    """The ``nth`` group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def cut_texts(docs: DataFrame, grammar: Grammar = GRAMMARS["code_points"], settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``__row`` (a struct of all columns), text, n, form, prefix, middle, suffix and output: a row per row of ``docs``.

    Two draws from the hash of doc_id end the prefix and the middle, each after 0
    to n units; a third leaves some texts plain, as texts that are empty or hold
    a mark are; a fourth says which of the two orders is taken. Plain texts have
    null parts. Null text counts as empty; a null doc_id is hashed as no digits.
    Rows with equal doc_ids draw alike. Each text is cut whole, inside its row,
    whatever its length; nothing is shuffled; an empty table gives no rows.
    """
    s = settings
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    name = F.coalesce(F.col("__row.doc_id").cast("string"), F.lit(""))
    split = base.select("__row", "text", units(F.col("text"), grammar).alias("units"), F.sha2(F.concat(F.lit(f"{s.seed}:"), name), 256).alias("digest"))
    sized = split.select("*", F.size("units").alias("size"))
    ends = [F.pmod(_draw(F.col("digest"), k), (F.col("size") + 1).cast("long")).cast("int") for k in (0, 1)]
    marked = F.lit(False)
    for m in s.marks():
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (_draw(F.col("digest"), 2) % 100 >= s.plain_from), "plain").when(_draw(F.col("digest"), 3) % 100 < s.spm_below, "spm").otherwise("psm")
    placed = sized.select("__row", "text", "units", "size", form.alias("form"), F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"))
    own = F.col("form") != "plain"
    part = lambda first, n: F.when(own, F.array_join(F.slice("units", first, n), ""))
    parts = placed.select(
        "__row",
        "text",
        F.col("size").cast("long").alias("n"),
        "form",
        part(F.lit(1), F.col("lo")).alias("prefix"),
        part(F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("middle"),
        part(F.col("hi") + 1, F.col("size") - F.col("hi")).alias("suffix"),
    )
    first, second = F.concat(F.lit(s.prefix), "prefix"), F.concat(F.lit(s.suffix), "suffix")
    output = F.when(~own, F.col("text")).when(F.col("form") == "psm", F.concat(first, second, F.lit(s.middle), "middle")).otherwise(F.concat(second, first, F.lit(s.middle), "middle"))
    return parts.select("*", output.alias("output"))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that ``output`` was made of.

    Marks stand in it once each: a text with marks stays plain, and a mark that
    began in a part and ended in one of the marks would need ``<`` inside a mark.
    """
    s = settings
    between = lambda a, b: F.substring(output, F.locate(a, output) + F.lit(len(a)), F.locate(b, output) - F.locate(a, output) - F.lit(len(a)))
    rest = lambda a: F.substring(output, F.locate(a, output) + F.lit(len(a)), F.length(output))
    psm = F.concat(between(s.prefix, s.suffix), rest(s.middle), between(s.suffix, s.middle))
    spm = F.concat(between(s.prefix, s.middle), rest(s.middle), between(s.suffix, s.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill(docs: DataFrame, grammar: Grammar = GRAMMARS["code_points"], settings: Settings = Settings()) -> DataFrame:
    """``docs`` with the output in place of the text, and all other columns as they were; see cut_texts() for nulls and ties."""
    done = cut_texts(docs, grammar, settings)
    return done.select(*[(F.col("output") if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame, grammar: Grammar = GRAMMARS["code_points"], settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, and hashes of the output and of the text rebuilt from it."""
    done = cut_texts(docs, grammar, settings)
    return done.select(
        F.col("__row.doc_id").alias("doc_id"),
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), settings).cast("binary"), 256).alias("restored_sha256"),
    )


#: digests() by code points over table ``documents``, for DuckDB.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
c AS (SELECT *, substring(t, 1, lo) AS a, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS z FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
