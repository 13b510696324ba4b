"""Corpus pipeline: documents through quality rules, language ID, near-duplicate removal, source mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of documents, but for the last, which returns the packed
pieces. No stage holds rows on the driver; what models need is bounded and
broadcast by the operators. An empty table passes through all stages as one;
other columns, whatever their names, stay with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, jaccard, language, mixing, packing, quality, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and all rules keep; null and empty texts go, repeated rows are judged alike."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the text shows; those without letters (null and empty texts too), or of no clear language, go.

    Learnt from the rows with a lang outside the held-out fold; a null doc_id is in
    no fold. Without any labelled row no language is known, and all go.
    """
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id (null ids last).

    Repeated rows are copies of each other; documents without words all stay.

    Five words and a similarity of 0.8, as for all stages on word shingles; the
    query of the join by itself takes four words and 0.85.
    """
    return jaccard.keep_one(docs, jaccard.Settings(k=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is one of its own; equal rows draw alike."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; longer documents in pieces, null and empty ones as their end id, repeated rows each for itself."""
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Stages 2 to 5 (a trained model, set similarity over components, hashed draws, token ids) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again by the next."""
    docs = common.tables(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, name)
    return docs
