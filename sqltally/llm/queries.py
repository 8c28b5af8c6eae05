"""Registered queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltally.llm import decontaminate, fingerprints, html_extract, langid, line_dedup, packing, periodic_runs, pieces, quality, repair
from sqltally.llm import simhash, token_counts, toxicity
from sqltally.llm.common import held_out, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_later_copies(table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc_id", "removed_lines", "removed_runs", "text")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out, "toxic")
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return model.score(docs).select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    found = langid.identify(docs, ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages")


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text("fingerprint").alias("fingerprint"), fingerprints.as_text("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=4096)
    return packed.drop("text_key")


@query
def op8_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.section_tokens(docs, ranks, public_tokenizers.PATTERN, rule="start")


@query
def op9_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, width=4, radius=4)
    return found.select("doc_id", simhash.fp_hex().alias("fingerprint"), "component_id")


@query
def op10_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    model, rate = quality.train(docs, table(spark, sf_dir, "labels"), ~out, "quality")
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return quality.score(docs, model, rate).select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"), "passages")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(docs, exponent=4, shortest=6)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    # runs come by start, then period, so the first of equals stays
    longer = lambda a, b: b.length * a.period > a.length * b.period
    top = F.aggregate("runs", F.get("runs", 0), lambda a, b: F.when(longer(a, b), b).otherwise(a))
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees",
    )


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.with_damage(table(spark, sf_dir, "conversations"))
    return repair.repair(damaged, present=F.col("present"))
