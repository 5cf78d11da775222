"""Hybrid querying: fuse per-method hit lists, score confidence, build context.

Every method produces ``(query_id, rank, doc_id, score)``.  Fusion follows
the fixed method order (dense "SPIDER", lexical "BM25", cluster "GMM"):

1. union all method hits (``method``, ``method_order``, ``method_rank``);
2. keep the first occurrence of each document per query — first method in
   the fixed order wins, not the best score;
3. rank by score (desc), ties by method order then method rank; keep k.

All windows are partitioned by ``query_id``; each group holds at most
(number of methods)·k rows, so no group can grow with the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Method labels and their run order.
METHOD_LABELS = {"spider": "SPIDER", "bm25": "BM25", "gmm": "GMM"}
METHOD_ORDER = ["spider", "bm25", "gmm"]
# Confidence: per-method bonus and cap, per-hit bonus and cap, overall cap.
METHOD_BONUS, METHOD_BONUS_CAP = 0.1, 0.3
COUNT_BONUS, COUNT_BONUS_CAP = 0.05, 0.2
CONTEXT_HITS, CONTEXT_CHARS = 5, 500
TIE_DECIMALS = 9

PROMPT_TEMPLATE = (
    "You are a careful research assistant. Answer the question using only the context below.\n"
    "If the context is not enough, say what is missing and cite the documents you rely on.\n\n"
    "Context:\n{context}\n\nQuestion: {question}\n\nAnswer:"
)


def union_hits(method_hits: dict[str, DataFrame]) -> DataFrame:
    """Union the chosen methods' hits in the fixed order (names outside it raise)."""
    unknown = set(method_hits) - set(METHOD_ORDER)
    if unknown:
        raise ValueError(f"unknown retrieval methods: {sorted(unknown)}")
    parts = []
    for name in METHOD_ORDER:
        if name in method_hits:
            h = method_hits[name]
            parts.append(h.select(
                "query_id", "doc_id", F.col("score").cast("double").alias("score"),
                F.col("rank").cast("int").alias("method_rank"),
                F.lit(METHOD_LABELS[name]).alias("method"),
                F.lit(METHOD_ORDER.index(name)).alias("method_order")))
    if not parts:
        raise ValueError("no retrieval method selected")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup_first(union: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "doc_id").orderBy("method_order", "method_rank")
    return union.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1).drop("_first")


def rank_fused(deduped: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", TIE_DECIMALS)), "method_order", "method_rank")
    return deduped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(method_hits: dict[str, DataFrame], k: int) -> DataFrame:
    """(query_id, rank, doc_id, score, method, method_rank)."""
    top = rank_fused(dedup_first(union_hits(method_hits)), k)
    return top.select("query_id", "rank", "doc_id", "score", "method", "method_rank")


def confidence(fused: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_results, n_methods, confidence); queries without hits get 0."""
    agg = fused.groupBy("query_id").agg(
        F.avg("score").alias("_avg"), F.countDistinct("method").alias("n_methods"),
        F.count("*").alias("n_results"))
    conf = F.least(
        F.col("_avg")
        + F.least(F.col("n_methods") * METHOD_BONUS, F.lit(METHOD_BONUS_CAP))
        + F.least(F.col("n_results") * COUNT_BONUS, F.lit(COUNT_BONUS_CAP)),
        F.lit(1.0))
    with_conf = agg.select("query_id", "n_results", "n_methods", conf.alias("confidence"))
    return (queries.select("query_id").distinct().join(with_conf, "query_id", "left")
            .select("query_id",
                    F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
                    F.coalesce("n_methods", F.lit(0)).cast("long").alias("n_methods"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence")))


def context_block(rank: Column, score: Column, content: Column) -> Column:
    return F.concat(F.lit("Document "), rank.cast("string"), F.lit(" (Score: "),
                    F.format_string("%.3f", score), F.lit("):\n"),
                    F.substring(content, 1, CONTEXT_CHARS), F.lit("..."))


def context(fused: DataFrame, contents: DataFrame, content_col: str = "text") -> DataFrame:
    """(query_id, n_context, context_text) from the first five hits.

    The hit list is joined to the document text only after top-k, so at
    most five texts per query are touched.
    """
    top = fused.where(F.col("rank") <= CONTEXT_HITS).join(
        contents.select("doc_id", F.col(content_col).alias("_content")), "doc_id", "left")
    blocks = top.select("query_id", "rank", context_block(F.col("rank"), F.col("score"),
                                                          F.coalesce("_content", F.lit(""))).alias("_b"))
    return blocks.groupBy("query_id").agg(
        F.count("*").alias("n_context"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_b"))), lambda s: s["_b"]),
                     "\n\n").alias("context_text"))


def prompt(ctx: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, prompt) — fixed instruction, context, question."""
    head, rest = PROMPT_TEMPLATE.split("{context}")
    mid, tail = rest.split("{question}")
    joined = queries.select("query_id", F.col(text_col).alias("_q")).join(ctx, "query_id", "left")
    return joined.select("query_id", F.concat(
        F.lit(head), F.coalesce("context_text", F.lit("")), F.lit(mid), F.col("_q"), F.lit(tail)).alias("prompt"))


def responses(hits: DataFrame, conf: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per query: query_id, query, documents (its ranked hits, at most k
    structs with all their columns), total_results, methods, confidence."""
    cols = [c for c in hits.columns if c not in ("query_id", "rank")]
    docs = hits.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.struct(*cols).alias("hit")))).alias("_d"),
        F.array_sort(F.collect_set("method")).alias("methods"))
    met = (queries.select("query_id", F.col(text_col).alias("query")).join(docs, "query_id", "left")
           .join(conf.select("query_id", "confidence"), "query_id", "left"))
    return met.select("query_id", "query", F.transform("_d", lambda d: d["hit"]).alias("documents"),
                      F.when(F.col("_d").isNull(), F.lit(0)).otherwise(F.size("_d")).alias("total_results"),
                      F.coalesce("methods", F.array().cast("array<string>")).alias("methods"),
                      F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def answer(prompts: DataFrame, answer_fn, out_col: str = "answer") -> DataFrame:
    """Optional answer column from a user-supplied ``answer_fn(list[str]) -> list[str]``
    called once per Arrow batch (no client is shipped with the engine)."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(list(answer_fn(p.fillna("").tolist())))

    return prompts.withColumn(out_col, run(F.col("prompt")))


def conversation_queries(turns: DataFrame, history: int = 2, role: str = "user") -> DataFrame:
    """Multi-turn query text: each ``role`` turn joined (newline) with the
    previous ``history`` turns of the same role in its conversation.

    (conv_id, turn, n_turns, query_text).  Built so that no conversation,
    however long, lands in one task: turns get consecutive global positions
    (``consecutive_numbers``), each turn contributes its text to itself and
    the next ``history`` turns, and the grouping key (conversation, turn
    rank) holds at most ``history + 1`` rows.
    """
    from quarry.operators.numbering import consecutive_numbers

    t = turns.where(F.col("role") == role).select("conv_id", "turn", "text")
    numbered = consecutive_numbers(t, ["conv_id", "turn"])
    # first position of each conversation: a combinable aggregate; the join
    # back is split by AQE if one conversation is very large
    first = numbered.groupBy("conv_id").agg(F.min("_g").alias("_g0"))
    ranked = numbered.join(first, "conv_id").select("conv_id", "turn", "text", (F.col("_g") - F.col("_g0")).alias("_r"))
    contrib = ranked.select("conv_id", F.col("turn").alias("_turn"), "text", "_r",
                            F.explode(F.sequence(F.lit(0), F.lit(history))).alias("_j"))
    grouped = contrib.groupBy("conv_id", (F.col("_r") + F.col("_j")).alias("_target")).agg(
        F.max(F.when(F.col("_j") == 0, F.col("_turn"))).alias("turn"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct(F.col("_j"), F.col("text"))), asc=False).alias("_parts"))
    # targets past a conversation's last turn have no own (j = 0) row
    return grouped.where(F.col("turn").isNotNull()).select(
        "conv_id", "turn", "n_turns",
        F.array_join(F.transform("_parts", lambda p: p["text"]), "\n").alias("query_text"))
