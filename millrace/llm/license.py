"""Operator 5: license scans by diagonal voting, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Words of k-grams. No phrase may be shorter.
K = 3
#: Word separators once A-Z are lower-cased: all of ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices, as published with the licenses; a span that covers enough of one gives its label.
NOTICES = {
    "gpl-3": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "gpl-2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "apache-2": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
}


@dataclass(frozen=True)
class Settings:
    """coverage: part of a notice's words that a span has to hold; drift: words that a span may have more or less than the
    notice, at any of its places: the diagonals merged to a span lie within so many of each other.
    """

    coverage: float = 0.75
    drift: int = 6


def template_grams(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """(gram, t_pos, template, label, exact, n_grams): a few hundred rows, fixed by the template tables."""
    rows = []
    for template, (text, label, exact) in enumerate([(p, at, True) for p, at in phrases.items()] + [(n, at, False) for at, ns in notices.items() for n in ns]):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        rows += [(" ".join(words[i : i + K]), i, template, label, exact, len(words) - K + 1, len(words)) for i in range(len(words) - K + 1)]
    # The end mark of every text: no k-gram holds an upper-case letter.
    rows.append(("END", 0, -1, None, False, 1, 0))
    return spark.createDataFrame(rows, "t_gram string, t_pos int, template int, label string, exact boolean, n_grams int, t_words int").withColumn("t_hash", F.xxhash64("t_gram"))


def matches(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Rows (__row, doc_id, pos and a template's columns): each rolling k-gram of each text that a template has.

    All k-grams of all texts meet the templates in a join on their hashes; equal
    words are asked for after equal hashes, so a span is verified word by word.
    Each text also gives one end mark, at its number of words, so that it stays
    in the result without a second reading. The broadcast side is fixed by the
    template tables, not by the data.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("__row"),
        F.col("doc_id"),
        F.expr(f"filter(split(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), r'{SEPARATORS}', -1), w -> w <> '')").alias("__words"),
    )
    gram = "concat_ws(' ', " + ", ".join(f"__words[i + {k}]" if k else "__words[i]" for k in range(K)) + ")"
    grams = words.selectExpr("__row", "doc_id", "size(__words) AS __n", f"CASE WHEN size(__words) >= {K} THEN transform(sequence(0, size(__words) - {K}), i -> {gram}) ELSE array() END AS __grams")
    rolled = grams.selectExpr("__row", "doc_id", "posexplode(concat(__grams, array('END'))) AS (pos, gram)", "__n").selectExpr("__row", "doc_id", "CASE WHEN gram = 'END' THEN __n ELSE pos END AS pos", "gram", "xxhash64(gram) AS __hash")
    return rolled.join(F.broadcast(templates), F.col("__hash") == F.col("t_hash")).filter("gram = t_gram").drop("gram", "t_gram", "__hash", "t_hash")


def scan(docs: DataFrame, settings: Settings = Settings(), text: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: a row per row of ``docs``.

    Method: each match votes for the diagonal (position in the text less position
    in the template), and votes are summed by diagonal. From every diagonal of a
    notice on, those up to ``drift`` words further are merged to a span, never
    further: so what a span holds stands in the notice's order, up to that drift,
    and is no longer than the notice and the drift. A span is verified by the
    share of the template's words that agree with the text's along its diagonals,
    each word once however often it is repeated (all of them, on one diagonal, for
    a phrase); of notices verified on one diagonal the best one counts. Labels: of all verified spans; base labels: of the phrases. score
    is the best share of a notice or phrase held by a verified span, 0 to 1.

    Null text has no words: zero counts, null places, empty labels, score 0. So
    has an empty text. Repeated rows and equal or null doc_ids give a row each; a
    text of any length is scanned whole, by the task that reads it; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    hits = matches(docs, templates if templates is not None else template_grams(docs.sparkSession), text)
    keys = ["__row", "doc_id", "template", "label", "exact", "n_grams", "t_words"]
    # A text that repeats a notice a million times still leaves one row a diagonal and place: votes are counted before the shuffle.
    votes = hits.groupBy(*keys, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("places"), F.min("pos").alias("lo"))
    merged = f"collect_list(places) OVER (PARTITION BY __row, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {settings.drift} FOLLOWING)"
    spans = votes.selectExpr("*", f"CASE WHEN exact OR template < 0 THEN places ELSE array_distinct(flatten({merged})) END AS held").drop("places").withColumnRenamed("held", "places")
    # A k-gram at a place holds the words from there on; words that several hold count once.
    share = f"CASE WHEN template < 0 THEN 0.0D ELSE size(array_distinct(flatten(transform(places, p -> sequence(p, p + {K - 1}))))) / t_words END"
    found = spans.selectExpr("__row", "doc_id", "template", "CAST(lo AS LONG) AS lo", f"{share} AS share", "label", "exact", "diagonal").filter(f"template < 0 OR share >= CASE WHEN exact THEN 1 ELSE {settings.coverage} END")
    # Notices that are alike but for a version: of those on one diagonal the one that agrees best.
    found = found.selectExpr("*", "max(share) OVER (PARTITION BY __row, exact, diagonal) AS best").filter("template < 0 OR share = best")
    return found.groupBy("__row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("template") < 0, F.col("lo"))).alias("n_words"),
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("lo"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("lo"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    ).drop("__row")
