"""The registered queries of the numbered operators: each applies its operator to its whole table.

Each query is thin: it calls the operator with production parameters and derives the contract's
columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_codec,
    bpe_count,
    chat_format,
    fill_middle,
    langid,
    line_rules,
    mixing,
    near_dedup,
    order_minhash,
    packing,
    quality_fm,
    spelling,
    toxicity,
)
from .common import held_out, table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.learn(docs, table(spark, sf_dir, "labels"))
    return quality_fm.classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = line_rules.apply_rules(table(spark, sf_dir, "documents"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def op3_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


def op4_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), path)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    made = chat_format.format_conversations(turns.unionByName(probe))
    back = made.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs, model).select("doc_id", held_out(parts=3, at=1).alias("held_out"), "lang_pred", "score")


def op8_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    like = order_minhash.likeness
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("bins")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_bins")).alias("edited_fingerprint"),
        like(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        like(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.observed_words(table(spark, sf_dir, "documents"))
    return spelling.variant_groups(words).select("word", "n", "n_near", "form", "form_n", "root")


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_codec.encode_and_decode(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_fm,
        op2_line_rules,
        op3_bpe_count,
        op4_power_packing,
        op5_toxicity,
        op6_chat_format,
        op7_language_id,
        op8_fair_mixing,
        op9_order_minhash,
        op10_near_dedup,
        op11_spelling_variants,
        op12_bpe_codec,
        op13_fill_middle,
    )
}
