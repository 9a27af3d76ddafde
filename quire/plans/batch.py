"""Jobs over folders of documents: training pairs, resume, progress, and a comparison of providers."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.completion.base import Completer
from quire.config import Settings
from quire.functions.text import estimated_cost
from quire.operators import tree
from quire.plans import training
from quire.plans.build import TreeBuilder
from quire.runtime import cut
from quire.sources import pages as page_source
from quire.sources import records

# What a comparison of providers asks of each document, and the tokens it counts for a section.
QUESTIONS = ("What is the main contribution?", "Which methods are used?", "What are the limitations?")
TOKENS_PER_NODE = 80


def training_pairs(pages: DataFrame, names: DataFrame, builder: TreeBuilder, provider: str) -> DataFrame:
    """``(arxiv_id, document_text, page_count, total_tokens, tree, metadata, error, elapsed_seconds)`` of documents.

    ``names(doc_id, doc_name)`` gives the ids. All documents are built at once, so the seconds are
    the job's, shared evenly; a document that fails has its ``error`` and no tree.
    """
    began = time.monotonic()
    nodes, failures = builder.build(pages)
    nodes, failures = cut(nodes), cut(failures)
    structures = tree.to_json(nodes, ("title", "start_index", "end_index", "node_id", "summary"))
    texts = page_source.document_texts(pages)
    joined = cut(texts.join(names, "doc_id").join(structures, "doc_id", "left").join(failures, "doc_id", "left"))
    seconds = round((time.monotonic() - began) / max(1, joined.count()), 1)
    name = F.to_json(F.struct("doc_name"))
    whole = F.concat(F.left(name, F.length(name) - 1), F.lit(',"structure":'), F.coalesce("structure", F.lit("[]")), F.lit("}"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    about = F.struct(F.lit(builder.settings.model).alias("model"), F.lit(provider).alias("provider"), F.lit(seconds).alias("generation_time_seconds"), stamp)
    return joined.select(
        F.col("doc_name").alias("arxiv_id"), "document_text", "page_count", "total_tokens", whole.alias("tree"), about.alias("metadata"),
        "error", F.lit(seconds).alias("elapsed_seconds"),
    )


def pending_documents(spark: SparkSession, folder: str, good: str, bad: str, limit: int | None = None) -> DataFrame:
    """``(doc_id, doc_name, path)`` of a folder's files in name order that neither folder of results holds."""
    listed = page_source.list_documents(spark, folder).withColumn("arxiv_id", F.col("doc_name"))
    done, failed = (records.known(spark, where) for where in (good, bad))
    return records.pending(listed, done, failed, "arxiv_id", limit).drop("arxiv_id")


def run_batch(
    spark: SparkSession, folder: str, good: str, bad: str, progress: str, builder: TreeBuilder | None = None, provider: str = "rule",
    limit: int | None = None, max_pages: int | None = None, readers=page_source.extractors,
) -> DataFrame:
    """One job over the pending PDF files of a folder: pairs, errors, and the counters of ``progress``, which it returns.

    The paths are read on the driver, as many as are pending; their contents are not.
    """
    made = builder or TreeBuilder(Settings(max_tokens_per_node=8000))
    waiting = cut(pending_documents(spark, folder, good, bad, limit))
    skipped = page_source.list_documents(spark, folder).count() - waiting.count()
    paths = [r["path"] for r in waiting.select("path").toLocalIterator()]
    if not paths:
        empty = spark.createDataFrame([], "arxiv_id string, error string")
        records.save_progress(empty, progress, skipped)
        return records.progress(empty, skipped)
    read = cut(page_source.read_pdf(spark, paths, max_pages, readers))
    names = read.select("doc_id", "doc_name").distinct()
    pairs = training_pairs(read.where("page_number is not null").select("doc_id", "page_number", "text", "token_count"), names, made, provider)
    unread = read.where("error is not null").select(F.col("doc_name").alias("arxiv_id"), "error", F.lit(0.0).alias("elapsed_seconds"))
    results = cut(pairs.unionByName(unread, allowMissingColumns=True))
    records.write_results(results, good, bad)
    records.save_progress(results, progress, skipped)
    return records.progress(results, skipped)


def write_examples(spark: SparkSession, pairs: DataFrame, folder: str, eval_share: float = 0.1) -> DataFrame:
    """Fine-tuning examples of ``pairs(arxiv_id, document_text, tree)`` as JSON lines, one folder a kind and split.

    Returns ``(kind, split, examples)``.
    """
    documents = pairs.where("tree is not null").select(
        F.xxhash64("arxiv_id").alias("doc_id"), F.get_json_object("tree", "$.doc_name").alias("doc_name"), "document_text",
        F.get_json_object("tree", "$.structure").alias("structure"),
    )
    documents = cut(documents.dropDuplicates(["doc_id"]))
    nodes = cut(tree.from_json(documents.select("doc_id", "structure")))
    kinds = {
        "treegen": (training.build_examples(documents), F.col("doc_id").cast("string")),
        "treesearch": (training.search_examples(nodes, documents), F.concat_ws(":", F.col("doc_id").cast("string"), "node_id", F.col("template").cast("string"))),
    }
    counts: DataFrame | None = None
    for kind, (examples, key) in kinds.items():
        marked = cut(training.split(examples, key, eval_share))
        for part in ("train", "eval"):
            marked.where(F.col("split") == part).select("messages").write.mode("overwrite").json(f"{folder}/{kind}/{part}")
        mine = marked.groupBy("split").agg(F.count(F.lit(1)).alias("examples")).select(F.lit(kind).alias("kind"), "split", "examples")
        counts = mine if counts is None else counts.unionByName(mine)
    assert counts is not None
    return counts


def compare_providers(pages: DataFrame, completers: Mapping[str, Completer], settings: Settings | None = None) -> DataFrame:
    """``(provider, gen_seconds, search_seconds, documents, pages, nodes, depth, requests, cost)`` of the same documents.

    ``search_seconds`` is the mean of ``QUESTIONS``; ``requests`` counts the calls of all stages but
    the sequential ones; a provider that breaks has its ``error`` and no figures.
    """
    spark = pages.sparkSession
    pages = cut(pages)
    size = pages.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")).first()
    rows = []
    for name, completer in completers.items():
        try:
            builder = TreeBuilder(settings or Settings(), completer, count_requests=True)
            began = time.monotonic()
            nodes = cut(builder.build(pages)[0])
            generated, began = time.monotonic() - began, time.monotonic()
            asked = nodes.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*map(F.lit, QUESTIONS))).alias("n", "question"))
            cut(builder.search(asked.select(F.xxhash64("doc_id", "n").alias("query_id"), "doc_id", "question"), nodes))
            searched = (time.monotonic() - began) / len(QUESTIONS)
            shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()
            rows.append((name, round(generated, 1), round(searched, 2), size["documents"], size["pages"], shape["n"], shape["d"], sum(builder.requested.values()), None))
        except Exception as error:
            rows.append((name, None, None, size["documents"], size["pages"], None, None, None, f"{type(error).__name__}: {error}"))
    schema = "provider string, gen_seconds double, search_seconds double, documents long, pages long, nodes long, depth int, requests long, error string"
    spent = F.when(F.col("error").isNull(), estimated_cost(F.col("provider"), F.lit(size["tokens"]), F.col("nodes") * TOKENS_PER_NODE))
    return spark.createDataFrame(rows, schema).withColumn("cost", spent)
