"""Fine-tuning examples from trees, and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import truncate_for_training

BUILD_ROLE = "You turn documents into section trees. Reply with JSON."
SEARCH_ROLE = "You find the nodes of a section tree that answer a question. Reply with JSON."
QUESTIONS = (
    "What does the part on {} say?", "Where is {} treated?", "Summarise {}.", "What are the findings about {}?", "Explain {}.",
)


def messages(system: str, user: Column, assistant: Column) -> Column:
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", user), said("assistant", assistant))


def build_examples(documents: DataFrame, max_tokens: int = 8000) -> DataFrame:
    """``(doc_id, messages)`` of ``documents(doc_id, doc_name, document_text, structure)``: text in, tree out."""
    tree = F.concat(F.lit('{"doc_name":'), F.to_json(F.array("doc_name")).substr(F.lit(2), F.length(F.to_json(F.array("doc_name"))) - 2), F.lit(',"structure":'), "structure", F.lit("}"))
    return documents.select("doc_id", messages(BUILD_ROLE, truncate_for_training(F.col("document_text"), max_tokens), tree).alias("messages"))


def search_examples(nodes: DataFrame, structures: DataFrame) -> DataFrame:
    """``(doc_id, node_id, template, messages)``: every node with id and summary times every question template.

    The templates are a handful of literals, exploded in place; the document's structure joins once.
    """
    asked = nodes.where("coalesce(node_id, '') <> '' and coalesce(summary, '') <> ''")
    spread = asked.select("doc_id", "node_id", "title", F.posexplode(F.array(*map(F.lit, QUESTIONS))).alias("template", "q"))
    question = F.replace("q", F.lit("{}"), F.col("title"))
    reply = F.to_json(F.struct(F.lit("The section fits.").alias("thinking"), F.array("node_id").alias("node_list")))
    joined = spread.join(structures.select("doc_id", "structure"), "doc_id")
    user = F.concat(question, F.lit("\n\nTree:\n"), "structure")
    return joined.select("doc_id", "node_id", "template", messages(SEARCH_ROLE, user, reply).alias("messages"))


def split(examples: DataFrame, key: Column, eval_share: float = 0.1, seed: str = "") -> DataFrame:
    """Examples with ``split``: the first share by a seeded hash is ``eval``, at least one row, the rest ``train``.

    The border is the hash at that rank. Rows are counted by the first four digits of their hash, at
    most 65,536 counts, and only the one group that holds the border is ordered: a 65,536th of all
    rows. Equal keys share a hash and so a split.
    """
    hashed = examples.withColumn("_h", F.md5(F.concat(F.lit(seed), key.cast("string"))))
    group = F.substring("_h", 1, 4)
    counts = sorted((r["g"], r["n"]) for r in hashed.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect() if r["g"] is not None)
    take = max(1, int(sum(n for _, n in counts) * eval_share))
    border, before = "", 0
    for name, n in counts:
        if before + n >= take:
            border = hashed.where(group == name).select("_h").orderBy("_h").limit(take - before).agg(F.max("_h")).first()[0]
            break
        before += n
    return hashed.withColumn("split", F.when(F.col("_h") <= F.lit(border), "eval").otherwise("train")).drop("_h")
