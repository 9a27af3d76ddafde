"""Rule-based tree search and answers: the offline stand-in for the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what a question without any context is answered.
NOTHING = "I could not find relevant information in this document to answer your question."


def terms(text: Column | str) -> Column:
    """Distinct lower-case words of three letters or more."""
    column = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def search(questions: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, doc_id, thinking, node_ids)``: the ``k`` nodes of the asked document with most question words.

    Ties go by node id. Words are joined, not nodes with questions, so cost follows the matches.
    """
    asked = questions.select("query_id", "doc_id", F.explode(terms("question")).alias("term"))
    text = F.concat_ws(" ", "title", "summary")
    held = nodes.where("node_id is not null").select("doc_id", "node_id", F.explode(terms(text)).alias("term"))
    scores = asked.join(held, ["doc_id", "term"]).groupBy("query_id", "doc_id", "node_id").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "node_id")
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    listed = top.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id")))["node_id"].alias("node_ids"))
    none = F.array().cast("array<string>")
    return questions.select("query_id", "doc_id").join(listed, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.lit("words shared with title and summary").alias("thinking"), F.coalesce("node_ids", none).alias("node_ids")
    )


def answers(questions: DataFrame, contexts: DataFrame, excerpt: int = 200) -> DataFrame:
    """``(query_id, doc_id, answer, context, citations)``: the start of the context, or a fixed sentence without one."""
    none = F.array().cast("array<struct<node_id:string,title:string,start_page:int,end_page:int>>")
    joined = questions.select("query_id", "doc_id").join(contexts, ["query_id", "doc_id"], "left")
    context = F.coalesce("context", F.lit(""))
    answer = F.when(context == "", F.lit(NOTHING)).otherwise(F.substring(context, 1, excerpt))
    return joined.select("query_id", "doc_id", answer.alias("answer"), context.alias("context"), F.coalesce("citations", none).alias("citations"))


def first_sentence(text: Column, limit: int = 200) -> Column:
    """The first sentence of a text, or its first characters."""
    sentence = F.regexp_extract(text, r"(?s)\A\s*(.*?[.!?])(?:\s|\z)", 1)
    return F.when((sentence != "") & (F.length(sentence) <= limit), sentence).otherwise(F.substring(text, 1, limit))
