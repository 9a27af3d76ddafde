"""Verification of section lists against pages: appearance, starts, corrections, routing.

The rules are the offline completer's: a title appears on a page that holds it, both without white
space and in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def on_page(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the text of the page they name as ``page``; null where there is none."""
    named = pages.select("doc_id", F.col("page_number").alias("physical_index"), F.col("text").alias("page"))
    return items.join(named, ["doc_id", "physical_index"], "left")


def appears(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with ``ok``: whether the title appears on the named page; false without such a page."""
    title = squeezed(F.col("title"))
    ok = F.coalesce((title != "") & F.contains(squeezed(F.col("page")), title), F.lit(False))
    return on_page(items, pages).withColumn("ok", ok).drop("page")


def appear_start(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with ``appear_start``: ``yes`` where the page begins with the title, else ``no``."""
    title = squeezed(F.col("title"))
    starts = F.coalesce((title != "") & F.startswith(squeezed(F.col("page")), title), F.lit(False))
    return on_page(items, pages).withColumn("appear_start", F.when(starts, "yes").otherwise("no")).drop("page")


def accuracy(checked: DataFrame) -> DataFrame:
    """``(doc_id, items, correct, accuracy)`` of items with ``ok``."""
    counts = checked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("ok"), 1)).alias("correct"))
    return counts.withColumn("accuracy", F.col("correct") / F.col("items"))


def route(scored: DataFrame, gate: float = 0.6) -> DataFrame:
    """Documents with ``route``: ``keep`` when all is right, ``fix`` above the gate, else ``fallback``."""
    choice = F.when(F.col("accuracy") == 1.0, "keep").when(F.col("accuracy") > gate, "fix").otherwise("fallback")
    return scored.withColumn("route", choice)


def fix_candidates(items: DataFrame, pages: DataFrame, window: int = 5) -> DataFrame:
    """Wrong items with the pages around their index, one row a page: the band as an equi-join."""
    near = F.sequence(F.col("physical_index") - window, F.col("physical_index") + window)
    spread = items.where("not ok").select("doc_id", "pos", "title", "physical_index", F.explode(near).alias("page_number"))
    return spread.join(pages.select("doc_id", "page_number", "text"), ["doc_id", "page_number"])


def fixed(items: DataFrame, pages: DataFrame, window: int = 5) -> DataFrame:
    """Items with the nearest page in the window that holds the title; unchanged where none does.

    Corrections go by position, not by title; ties go to the earlier page. ``ok`` tells what is right
    now.
    """
    title = squeezed(F.col("title"))
    holds = (title != "") & F.contains(squeezed(F.col("text")), title)
    best = F.min_by("page_number", F.struct(F.abs(F.col("page_number") - F.col("physical_index")), F.col("page_number")))
    better = fix_candidates(items, pages, window).where(holds).groupBy("doc_id", "pos").agg(best.alias("better"))
    joined = items.join(better, ["doc_id", "pos"], "left")
    return joined.withColumn("physical_index", F.coalesce("better", "physical_index")).withColumn("ok", F.col("ok") | F.col("better").isNotNull()).drop("better")


def toc_pages(pages: DataFrame, first: int = 20) -> DataFrame:
    """The pages among the first that look like a table of contents: three lines or more that end in a number."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\A.*\S[ .]{2,}\d+\s*\z"))
    return pages.where((F.col("page_number") <= first) & (F.size(lines) >= 3))


def mostly_empty(pages: DataFrame, threshold: float = 0.8, least: int = 10) -> DataFrame:
    """``(doc_id, pages, mostly_empty)``: whether the share of pages with hardly any text reaches the threshold."""
    from quire.functions.text import strip

    bare = F.length(strip(F.coalesce("text", F.lit("")))) < least
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(bare, 1)).alias("bare"))
    return counts.select("doc_id", "pages", (F.col("bare") / F.col("pages") >= threshold).alias("mostly_empty"))


def large_nodes(nodes: DataFrame, pages: DataFrame, max_pages: int = 10, max_tokens: int = 20_000) -> DataFrame:
    """Leaves with more than ``max_pages`` pages and at least ``max_tokens`` tokens."""
    parents = nodes.select("doc_id", F.col("parent_pos").alias("pos")).where("pos is not null").distinct()
    leaves = nodes.join(parents, ["doc_id", "pos"], "left_anti").where(F.col("end_index") - F.col("start_index") + 1 > max_pages)
    spread = leaves.select("doc_id", "pos", F.explode(F.sequence("start_index", "end_index")).alias("page_number"))
    sizes = spread.join(pages.select("doc_id", "page_number", "token_count"), ["doc_id", "page_number"]).groupBy("doc_id", "pos").agg(F.sum("token_count").alias("tokens"))
    return leaves.join(sizes.where(F.col("tokens") >= max_tokens), ["doc_id", "pos"])
