"""Registered corpus queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import conversation_digests, format_windows
from .common import as_struct_rows, table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language_id import identify
from .license_scan import scan_licences
from .lm_score import score_texts
from .oracles import SQL
from .phrase_mining import collocations
from .quality import score_quality
from .quality_rules import apply_rules
from .secret_scan import count_kind, find_secrets, span_list
from .simhash_dedup import near_duplicates
from .source_audit import audit_sources
from .source_mix import label_domains, mix_rates

QUERIES = {}
ORACLES = dict(SQL)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("text_key")


@_query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = as_struct_rows(spark, [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"),
                                            F.lit(role).alias("role"), F.lit(own).alias("text"))
                                   for turn, role in enumerate(("user", "assistant"))])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_windows(rows))


@_query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels"))).drop("text_key")


@_query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).drop("text_key")


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *kinds, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@_query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "languages")


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


@_query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
