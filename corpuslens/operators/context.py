"""Context packing for questions: history, ranked blocks, token budget, prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import scalars
from corpuslens.operators import vectors

#: The default instruction; callers give their own.
SYSTEM = "Answer questions about the source code below. Use only the context that is given, name files and lines, and say so where the context is not enough."


def recent_history(messages: DataFrame, most: int = 6) -> DataFrame:
    """Of each session, the last `most` user and assistant messages before its newest message, with position in time order."""
    by = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    older = messages.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") > 1).filter(F.col("role").isin("user", "assistant"))
    kept = older.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_r")))).drop("_k", "_r")


def newest_question(messages: DataFrame) -> DataFrame:
    """session_id and the text of its newest message."""
    return messages.groupBy("session_id").agg(F.max_by("content", F.struct("created_at", "message_id")).alias("question"))


def retrieve_context(questions: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None, k: int = 8, provider: Callable[[list[str]], list[list[float]]] = vectors.hashed_terms) -> DataFrame:
    """The k best chunks of each question's repository: question_id, rank, score, path, start_line, end_line, content and symbol_name.

    questions: repository_id, question_id, question. chunks: repository_id, chunk_id, path, start_line, end_line, content, symbol_id and the
    embedding of the same provider. symbols: symbol_id and name; a chunk without one has no symbol_name. A question of a repository without
    chunks has no row. cite_sources gives the citations.
    """
    asked = vectors.embed(questions.select("repository_id", F.col("question_id").alias("query_id"), "question"), "question", provider)
    near = vectors.nearest(asked.withColumnRenamed("embedding", "query"), chunks, k)
    told = near.join(chunks.select("chunk_id", "path", "start_line", "end_line", "content", "symbol_id"), "chunk_id")
    named = told.withColumn("symbol_name", F.lit(None).cast("string")) if symbols is None else told.join(symbols.select("symbol_id", F.col("name").alias("symbol_name")), "symbol_id", "left")
    return named.select(F.col("query_id").alias("question_id"), "rank", "score", "path", "start_line", "end_line", "content", "symbol_name")


def cite_sources(ranked: DataFrame) -> DataFrame:
    """The first of each (path, start_line, end_line) of a question in rank order, whether or not the budget keeps it."""
    by = Window.partitionBy("question_id", "path", "start_line", "end_line").orderBy("rank")
    return ranked.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def context_blocks(ranked: DataFrame) -> DataFrame:
    """ranked (question_id, rank, path, start_line, end_line, content and maybe symbol_name) with block."""
    symbol = F.col("symbol_name") if "symbol_name" in ranked.columns else None
    return ranked.withColumn("block", scalars.context_block(F.col("rank"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content"), symbol))


def fit_budget(blocks: DataFrame, fixed: DataFrame, max_context: int = 128_000, share: float = 0.7) -> DataFrame:
    """Blocks that fit: the total of a prefix grows with its length, so a running length decides; the first one always stays.

    fixed: question_id, fixed_tokens (of system prompt and history), fixed_chars (of the prompt around the blocks).
    """
    run = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.char_length("block")).over(run) + F.count("*").over(run) - 1  # blocks are joined by a line end
    out = blocks.join(fixed, "question_id").withColumn("total_tokens", F.col("fixed_tokens") + F.floor((F.col("fixed_chars") + chars) / 4))
    return out.filter((F.col("total_tokens") <= int(max_context * share)) | (F.col("rank") == 1))


def assemble_prompts(messages: DataFrame, ranked: DataFrame, system: str = SYSTEM, max_context: int = 128_000, history: int = 6) -> DataFrame:
    """A row for each session: question, prompt, history (role and content in order), n_blocks, total_tokens and sources.

    ranked has question_id = session_id. Totals count tokens as a quarter of the characters of each message.
    """
    past = recent_history(messages, history)
    told = past.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"),
        F.sum(scalars.estimate_tokens(F.col("content"))).alias("_h"),
    )
    around = F.char_length(scalars.prompt(F.coalesce("question", F.lit("")), F.lit("")))
    asked = newest_question(messages).join(told, "session_id", "left").withColumn("fixed_tokens", F.coalesce("_h", F.lit(0)) + len(system) // 4).withColumn("fixed_chars", around).drop("_h")
    fixed = asked.select(F.col("session_id").alias("question_id"), "fixed_tokens", "fixed_chars")
    kept = fit_budget(context_blocks(ranked), fixed, max_context)
    text = kept.groupBy(F.col("question_id").alias("session_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("context"), F.count("*").alias("n_blocks"))
    cited = cite_sources(ranked).groupBy(F.col("question_id").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "start_line", "end_line"))), lambda x: F.struct(x["path"].alias("path"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))).alias("sources"))
    out = asked.join(text, "session_id", "left").join(cited, "session_id", "left").withColumn("prompt", scalars.prompt(F.coalesce("question", F.lit("")), F.col("context")))
    return out.select("session_id", "question", "prompt", "history", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), (F.col("fixed_tokens") + scalars.estimate_tokens(F.col("prompt"))).alias("total_tokens"), "sources")


def echo(prompts: list[str]) -> list[str]:
    """An offline provider: the question line of each prompt."""
    return [next((x.removeprefix("User Question: ") for x in p.split("\n") if x.startswith("User Question: ")), "") for p in prompts]


def complete(prompts: DataFrame, provider: Callable[[list[str]], list[str]] = echo) -> DataFrame:
    """prompts with answer, from a provider that takes an Arrow batch of prompts at a time."""

    @F.pandas_udf("string")
    def answer(p: pd.Series) -> pd.Series:
        return pd.Series(provider(p.tolist()), dtype="object")

    return prompts.withColumn("answer", answer("prompt"))


def list_messages(messages: DataFrame) -> DataFrame:
    """Messages with their position in their session, and sources that default to an empty list."""
    none = F.array().cast("array<struct<path:string,start_line:int,end_line:int,symbol_name:string>>")
    sources = F.coalesce("sources", none) if "sources" in messages.columns else none
    return messages.withColumns({"sources": sources, "position": F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "message_id"))})


def join_fragments(fragments: DataFrame) -> DataFrame:
    """Streamed fragments of each session joined in order."""
    return fragments.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda x: F.coalesce(x["content"], F.lit(""))), "").alias("answer"))
