"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    bpe,
    conversation_repair,
    cover_lloyd,
    embedding_dedup,
    jaccard_join,
    packing,
    pii,
    quality,
    sql,
    suffix_tree,
    tool_calls,
    urls,
    winnow,
    word_tree,
)
from .common import fold, load, met, stored

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "array<struct<key:string,kind:string>>"
    schemas = spark.createDataFrame([("reply", [("prompt", "string"), ("turn", "integer")]), ("configure", [("text", "string")])], f"name string, fields {fields}")
    return tool_calls.link_conversations(load(spark, sf_dir, "conversations"), schemas, turns_depend=True)


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op4_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return bpe.digests(bpe.decode(encoded))


def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(load(spark, sf_dir, "documents"), training=fold("doc_id", 7) != 2, held_out=fold("doc_id", 7) == 2, tree=word_tree.gains)


def op10_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(load(spark, sf_dir, "documents"))


def op6_token_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(load(spark, sf_dir, "documents"), k=4, percent=85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op12_cover_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cover_lloyd.Quantiser(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    # Equal labels, nulls together, by their text and whether they are missing.
    label = F.col("others.label")
    rows = found.encode().select(F.col("key").alias("vec_id"), code.alias("code"), "error", F.isnull(label).alias("none"), F.coalesce(label.cast("string"), F.lit("")).alias("label"))
    rows = stored(rows, "codes")
    sums = stored(rows.groupBy("none", "label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    out = met(rows, sums, ["none", "label"], "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(found.text()), 256).alias("codebooks_sha256"))


def op13_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(load(spark, sf_dir, "conversations"))
    return conversation_repair.summarised(conversation_repair.repaired(rows))


QUERIES = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op2_quality_compression": op2_quality_compression,
    "op3_swap_packing": op3_swap_packing,
    "op4_bpe_speculate": op4_bpe_speculate,
    "op5_spherical_caps": op5_spherical_caps,
    "op6_token_combinations": op6_token_combinations,
    "op7_url_filter": op7_url_filter,
    "op8_one_bit_codes": op8_one_bit_codes,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_information_pii": op10_information_pii,
    "op11_winnowing": op11_winnowing,
    "op12_cover_lloyd": op12_cover_lloyd,
    "op13_viterbi_repair": op13_viterbi_repair,
}

ORACLES: dict[str, str] = {"op1_tool_call_linking": sql.OP1, "op5_spherical_caps": sql.OP5, "op6_token_combinations": sql.OP6, "op11_winnowing": sql.OP11, "op12_cover_lloyd": sql.OP12, "op13_viterbi_repair": sql.OP13}
