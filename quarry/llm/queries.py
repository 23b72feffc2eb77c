"""The queries that apply each operator to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, fmindex, langid, linededup, mixing, pitmanyor, pseudonyms, simhash, tokenfile, toxicity
from .subword import held_out
from .tables import table


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quarry.pii.key", None)
    if key is None:  # no key is written down anywhere: without one, pseudonyms link within this session
        key = secrets.token_hex(32)
        spark.conf.set("spark.quarry.pii.key", key)
    done = pseudonyms.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii", ",").alias("kinds"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.vector_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_documents(table(spark, sf_dir, "documents"))


def op4_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.find_phrases(docs, table(spark, sf_dir, "benchmark"), "found")
    return found.select(
        "doc_id",
        "found.n_words",
        fmindex.n_hit("found").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        fmindex.contaminated("found").alias("contaminated"),
    )


def op5_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_removed", F.md5("text").alias("text_md5"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), "found")
    return found.select("doc_id", held_out().alias("held_out"), "found.lang_pred", "found.score", "found.rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_feistel_pseudonyms": op1_feistel_pseudonyms, "op2_cover_tree": op2_cover_tree, "op3_pitman_yor": op3_pitman_yor, "op4_fmindex": op4_fmindex, "op5_sainte_lague": op5_sainte_lague, "op6_subword_toxicity": op6_subword_toxicity, "op7_orc_tokens": op7_orc_tokens, "op8_simhash": op8_simhash, "op9_line_windows": op9_line_windows, "op10_langid": op10_langid}
