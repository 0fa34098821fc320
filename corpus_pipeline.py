"""The corpus pipeline: documents through the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them in order. A driver
may as well write each stage's result as Parquet and give it, read again, to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustflow.llm import line_rules, mixing, near_dedup, packing, quality_fm
from gustflow.llm.common import columns_of, materialise, private, table

#: Columns that stages look at; ``lang`` and ``n_chars`` may be missing, and others may be there.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a step keeps of docs, with the columns of docs in their order.

    Other columns than COLUMNS travel as one, so that none of them meets a column of the step's.
    """
    others = columns_of(docs, COLUMNS)
    if not others:
        return step(docs).select(*docs.columns)
    packed = private(docs) + "others"
    known = [c for c in docs.columns if c.lower() in COLUMNS]
    out = step(docs.select(*known, F.struct(*others).alias(packed)))
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return out.select(*(F.col(c if c in known else f"{packed}.{quoted(c)}").alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, takes for good.

    Null and empty texts are scored as empty ones; repeated rows are scored alike; a score at the threshold
    keeps. An empty table gives no rows, one without labels is scored by an even model.
    """
    model = quality_fm.learn(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda df: quality_fm.classify(df, model).filter("predicted = 1"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that more than 20 documents of their host hold.

    Null, empty and short texts go; n_chars follows the text that is left; a null source is a host; repeated rows of
    one id count as one document. An empty table gives no rows.
    """

    def step(df: DataFrame) -> DataFrame:
        ruled = line_rules.apply_rules(df).filter("kept").withColumn("text", F.col("clean_text"))
        return ruled.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in df.columns else ruled

    return _kept(docs, step)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id, linked at a similarity of 0.8 or more.

    Documents without words and rows with a null id stay; rows of one id stay or go together. An empty table
    gives no rows.
    """
    return _kept(docs, lambda df: near_dedup.deduplicate(df, percent=80))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix holds them: two times at most, a row for each.

    A null source is a source of its own; null and empty texts have no words and fill nothing. Repeated rows are
    taken alike. An empty table gives no rows.
    """

    def step(df: DataFrame) -> DataFrame:
        mixed = mixing.mix(df).filter("copies > 0")
        return mixed.withColumn(private(mixed) + "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return _kept(docs, step)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: one row per piece.

    A null or empty text is the closing id alone; repeated rows are packed as often as they come; columns of docs
    with names of the pieces' columns give way. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_deduplication", near_deduplication),
    ("mixing", mixing_sources),
    ("packing", sequence_packing),
]

#: Learned models and tokenizers cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table; each one's rows are computed once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
