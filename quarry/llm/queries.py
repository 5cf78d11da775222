"""The registered query of each training-data operator: ``opN_<name>`` runs the
operator with production parameters over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (cnn_quality, decontaminate, dual_tree, embedding_dedup, hmm_lm, license_scan, line_dedup, oracles,
                        packing, prefix_trie, simhash, stable_search, substring_dedup, tool_chat)
from quarry.llm.common import stage

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_path() -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_license_scan(spark, sf_dir):
    return license_scan.report(license_scan.scan(table(spark, sf_dir, "documents")))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contamination(decontaminate.find_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op4_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op5_hmm_scores(spark, sf_dir):
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def chat_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as the conversations' turns have them: a user turn is a
    call that needs the call two turns before it; an assistant turn is the result
    of the call one turn before it.  Calls of other turns do not exist, so some
    results are orphans and some needs are missing."""
    text = F.coalesce("text", F.lit(""))

    def call_id(turn):
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    t = F.col("turn")
    arguments = F.to_json(F.struct(
        F.col("text").alias("prompt"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"),
        t.alias("turn")), {"ignoreNullFields": "true"})
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").alias("conv"), "turn", call_id(t).alias("call_id"),
        F.when(t < 2, F.lit("ask")).otherwise(F.lit("follow_up")).alias("name"), arguments.alias("arguments"),
        F.when(t >= 2, F.array(call_id(t - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), "turn", call_id(t - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


CHAT_SCHEMAS = {
    name: {"type": "object", "required": ["prompt", "turn", "words"], "additionalProperties": False,
           "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", **turn},
                          "words": {"type": "integer", "minimum": 1, "maximum": 60}}}
    for name, turn in (("ask", {"minimum": 0, "maximum": 1}), ("follow_up", {"minimum": 2}))
}


def op6_tool_calls(spark, sf_dir):
    linked = tool_chat.link(*chat_calls(table(spark, sf_dir, "conversations")), CHAT_SCHEMAS)
    return linked.withColumnRenamed("conv", "conv_id")


def op7_cnn_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return cnn_quality.scores(docs, cnn_quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark, sf_dir):
    # the pages' text is taken from their HTML once, as the operator reads it more than once
    pages = stage(table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"),
                                                       line_dedup.page_text(F.col("html")).alias("text")), "page-text")
    left = line_dedup.drop_lines(pages, F.col("host"), n_lines="n_lines", n_dropped="n_dropped")
    return left.select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_substring_dedup(spark, sf_dir):
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    first = F.array_join(F.array_sort(F.transform("first_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "start", "stop", "n_words", "n_units", first.alias("first_doc_ids"))


def op11_lexical_search(spark, sf_dir):
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_stable_search(spark, sf_dir):
    index = stable_search.build_index(table(spark, sf_dir, "embeddings"))
    return stable_search.search(index, table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0), k=10)


def op13_prefix_trie(spark, sf_dir):
    turns = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns, group=5, longest=8))


def queries():
    return {f.__name__: f for f in (
        op1_embedding_dedup, op2_license_scan, op3_decontamination, op4_simhash_dedup, op5_hmm_scores, op6_tool_calls,
        op7_cnn_quality, op8_line_dedup, op9_packing, op10_substring_dedup, op11_lexical_search, op12_stable_search,
        op13_prefix_trie)}


def oracle_sql():
    return oracles.oracle_sql()
