"""Markdown into sections, parents and thinned sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import count_tokens, pad_id, strip

HEADER = r"\A(#{1,6})\s+(.+)\z"


def sections(files: DataFrame) -> DataFrame:
    """``(doc_id, pos, level, line_num, title, text)`` of ``files(doc_id, content)``.

    A header is one to six signs and white space, indented or not, outside code fences. Lines in
    fences stay in the text; text before the first header is left out. One shuffle by document.
    """
    lines = files.where("content is not null").select("doc_id", F.posexplode(F.split("content", "\n")).alias("line", "raw"))
    lines = lines.withColumn("s", strip(F.col("raw")))
    lines = lines.withColumn("fence", F.col("s").startswith("```"))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("inside", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)
    lines = lines.withColumn("header", ~F.col("fence") & ~F.col("inside") & F.col("s").rlike(HEADER))
    lines = lines.withColumn("pos", F.sum(F.col("header").cast("int")).over(upto).cast("int")).where("pos > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("line", "raw"))))
    head = lambda c: F.max(F.when(F.col("header"), c))
    return lines.groupBy("doc_id", "pos").agg(
        head(F.length(F.regexp_extract("s", HEADER, 1))).alias("level"),
        head(F.col("line") + 1).alias("line_num"),
        head(strip(F.regexp_extract("s", HEADER, 2))).alias("title"),
        strip(F.array_join(body["raw"], "\n")).alias("text"),
    )


def parents(found: DataFrame) -> DataFrame:
    """Sections with ``parent_pos``: the latest earlier section of a lower level, else null.

    Levels are six at most, so the latest position of each level so far gives it in one window.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col("level") == n, F.col("pos"))).over(before) for n in range(1, 6)]
    wide = found.select("*", *[c.alias(f"_l{n}") for n, c in enumerate(latest, 1)])
    lower = [F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 6)]
    return wide.withColumn("parent_pos", F.greatest(*lower)).drop(*[f"_l{n}" for n in range(1, 6)])


def nodes(files: DataFrame, add_node_ids: bool = True) -> DataFrame:
    """Section nodes with parents, ids in document order and line numbers as range.

    A file without headers gives one node with the whole content, titled by ``doc_name``.
    """
    found = parents(sections(files)).select(
        "doc_id", "pos", "parent_pos", "level", "title",
        F.col("line_num").alias("start_index"), F.col("line_num").alias("end_index"), F.nullif("text", F.lit("")).alias("text"),
    )
    bare = files.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id", F.lit(1).alias("pos"), F.lit(None).cast("int").alias("parent_pos"), F.lit(1).alias("level"),
        F.col("doc_name").alias("title"), F.lit(1).alias("start_index"), F.lit(1).alias("end_index"), F.col("content").alias("text"),
    )
    ids = pad_id(F.col("pos")) if add_node_ids else F.lit(None).cast("string")
    return found.unionByName(bare).withColumn("node_id", ids)


def thin(tree: DataFrame, min_tokens: int) -> DataFrame:
    """Small leaves merged into their previous sibling.

    A leaf under ``min_tokens`` that is not the first sibling joins the nearest earlier sibling that
    is kept: texts joined by a blank line (empty ones add nothing), the range extended. Ids keep gaps.
    """
    kids = tree.select("doc_id", F.col("parent_pos").alias("pos")).where("pos is not null").distinct().withColumn("has_kids", F.lit(True))
    rows = tree.join(kids, ["doc_id", "pos"], "left").withColumn("leaf", F.col("has_kids").isNull()).drop("has_kids")
    siblings = Window.partitionBy("doc_id", "parent_pos").orderBy("pos")
    small = F.coalesce(count_tokens(F.col("text")), F.lit(0)) < min_tokens
    rows = rows.withColumn("keep", ~(small & F.col("leaf") & (F.row_number().over(siblings) > 1)))
    rows = rows.withColumn("grp", F.sum(F.col("keep").cast("int")).over(siblings))
    member = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), "end_index")))
    merged = rows.groupBy("doc_id", "parent_pos", "grp").agg(
        F.min("pos").alias("pos"), F.min_by("level", "pos").alias("level"), F.min_by("title", "pos").alias("title"),
        F.min_by("node_id", "pos").alias("node_id"), F.min_by("start_index", "pos").alias("start_index"),
        F.max_by("end_index", "pos").alias("end_index"), member.alias("m"),
    )
    texts = F.filter(F.col("m.text"), lambda t: t != "")
    text = F.when(F.size("m") > 1, F.array_join(texts, "\n\n")).otherwise(F.nullif(F.element_at("m.text", 1), F.lit("")))
    return merged.select("doc_id", "pos", "parent_pos", "level", "title", "node_id", "start_index", "end_index", text.alias("text"))
