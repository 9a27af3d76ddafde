"""Flat section lists: normalisation, range checks, boundaries, preface, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.json_text import parse_index


def normalize_items(items: DataFrame) -> DataFrame:
    """``(doc_id, pos, structure, title, physical_index)`` of raw reply items.

    Indices are read from any notation and rows without one dropped; a null structure becomes
    ``None``; further fields fall away.
    """
    index = parse_index(F.col("physical_index").cast("string"))
    named = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return items.select(
        "doc_id", "pos", named("structure").alias("structure"), named("title").alias("title"), index.alias("physical_index")
    ).where("physical_index is not null")


def in_range(items: DataFrame, total_pages: Column, start_index: int = 1) -> DataFrame:
    """Items whose index is a page of the document; others are dropped, never moved."""
    return items.where(F.col("physical_index").between(F.lit(start_index), total_pages + (start_index - 1)))


def boundaries(items: DataFrame, total_pages: Column) -> DataFrame:
    """Items with ``start_index`` and ``end_index``.

    A section ends on the page before the next one if that starts its page, else on the same page;
    the last ends with the document; never before it starts.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = items.where("physical_index is not null")
    following = F.lead("physical_index").over(order)
    starts = F.lead("appear_start").over(order) == "yes"
    end = F.when(following.isNull(), total_pages).when(starts, following - 1).otherwise(following)
    return rows.withColumn("start_index", F.col("physical_index")).withColumn("end_index", F.greatest(end, F.col("physical_index")))


def add_preface(items: DataFrame, start_index: int = 1) -> DataFrame:
    """A first item ``Preface`` where the first section begins after the first page."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "pos").alias("first"), F.min("pos").alias("pos"))
    preface = first.where(F.col("first") > start_index).select(
        "doc_id", (F.col("pos") - 1).cast("int").alias("pos"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"),
        F.lit(start_index).alias("physical_index"), F.lit("yes").alias("appear_start"),
    )
    return items.select("doc_id", "pos", "structure", "title", "physical_index", "appear_start").unionByName(preface)


def merge_batches(batches: DataFrame) -> DataFrame:
    """Items of several batches ``(doc_id, batch, pos, structure, title, physical_index)`` merged by title.

    The first batch is taken as it is. Later ones, without their null indices, update the last item
    of the same title that an earlier batch brought, the latest batch winning; titles not seen before
    are appended, duplicates within their batch included. Returns ``(doc_id, pos, ...)``.
    """
    first = Window.partitionBy("doc_id")
    rows = batches.withColumn("first", F.min("batch").over(first)).where("batch = first or physical_index is not null")
    title = Window.partitionBy("doc_id", "title")
    rows = rows.withColumn("born", F.min("batch").over(title))
    last = Window.partitionBy("doc_id", "title", "born_here")
    rows = rows.withColumn("born_here", F.col("batch") == F.col("born")).withColumn("last_pos", F.max("pos").over(last))
    later = F.when(~F.col("born_here"), F.struct("batch", "pos", "physical_index"))
    rows = rows.withColumn("update", F.max(later).over(title))
    kept = rows.where("born_here")
    index = F.when((F.col("pos") == F.col("last_pos")) & F.col("update").isNotNull(), F.col("update.physical_index")).otherwise(F.col("physical_index"))
    order = Window.partitionBy("doc_id").orderBy("batch", "pos")
    return kept.select("doc_id", F.row_number().over(order).alias("pos"), "structure", "title", index.alias("physical_index"))


def item_json(items: DataFrame) -> DataFrame:
    """Items with ``json``: structure, title, index and start of a list item as an object without its nulls."""
    return items.withColumn("json", F.to_json(F.struct("structure", "title", "physical_index", "appear_start")))
