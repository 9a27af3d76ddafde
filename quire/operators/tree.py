"""Section trees as rows: parents, paths, ids, texts, outlines, JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quire.functions.text import pad_id, strip
from quire.runtime import cut


def parent_positions(items: DataFrame) -> DataFrame:
    """Items with ``parent_pos``: the latest earlier item whose structure is this one's without its last part.

    An as-of join without a join: every item stands in its parent's group once as a lookup and in its
    own once as a definition; one window takes the last definition so far, and the row travels along. An item without a parent
    part, or whose parent comes later or never, is a root.
    """
    key = F.when(
        F.col("structure").contains(".") & ~F.col("structure").isin("", "None"), F.regexp_extract("structure", r"(?s)\A(.*)\.[^.]*\z", 1)
    )
    row = F.struct(*items.columns)
    nothing = F.lit(None).cast(items.schema)
    sides = F.array(
        F.struct(F.col("structure").alias("k"), F.col("pos").alias("def"), F.lit(1).alias("side"), nothing.alias("row")),
        F.struct(F.nullif(key, F.lit("")).alias("k"), F.lit(None).cast("int").alias("def"), F.lit(0).alias("side"), row.alias("row")),
    )
    events = items.select("doc_id", "pos", F.explode(sides).alias("e")).where("e.side = 0 or e.k is not null").select("doc_id", "pos", "e.*")
    upto = Window.partitionBy("doc_id", "k").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.withColumn("parent_pos", F.when(F.col("k").isNotNull(), F.last("def", ignorenulls=True).over(upto)))
    return found.where("side = 0").select("row.*", "parent_pos")


def paths(items: DataFrame) -> DataFrame:
    """Items with ``path``, the positions from the root down, and ``depth``, for trees of any depth.

    One shuffle: the items of a document stream in order through one task, which keeps the paths of
    that document only. An item whose parent is no earlier item of its document is a root.
    """
    ordered = items.repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    place = {c: items.columns.index(c) for c in ("doc_id", "pos", "parent_pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_doc: object = None
        above: dict[int, list[int]] = {}
        for batch in batches:
            docs, own, parents = (batch.column(place[c]).to_pylist() for c in ("doc_id", "pos", "parent_pos"))
            out: list[list[int]] = []
            for doc, pos, parent in zip(docs, own, parents):
                if doc != open_doc:
                    open_doc, above = doc, {}
                path = [*above.get(parent, ()), pos]
                above[pos] = path
                out.append(path)
            depths = pa.array(map(len, out), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32())), depths], [*batch.schema.names, "path", "depth"])

    schema = StructType([*items.schema.fields, StructField("path", ArrayType(IntegerType())), StructField("depth", IntegerType())])
    return ordered.mapInArrow(run, schema)


def number(tree: DataFrame) -> DataFrame:
    """Nodes with ``node_id``, ``0001`` on, depth first: arrays order just so."""
    order = Window.partitionBy("doc_id").orderBy("path")
    return tree.withColumn("node_id", pad_id(F.row_number().over(order)))


def build(items: DataFrame, total_pages: Column, ids: bool = True) -> DataFrame:
    """Items with ranges, parents, paths and ids: the tree of each document."""
    from quire.operators.toc import boundaries

    tree = paths(parent_positions(boundaries(items, total_pages)))
    return number(tree) if ids else tree.withColumn("node_id", F.lit(None).cast("string"))


def add_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with the text of their pages, joined by blank lines, stripped, null when empty.

    The range becomes one row per page and joins on equality. All pages of a node are gathered into
    its one row, which is the size of the text it gets. Filter the nodes first: only their pages are
    read into the join.
    """
    spread = nodes.where("start_index <= end_index").select(
        "doc_id", F.col("pos"), F.explode(F.sequence("start_index", "end_index")).alias("page_number")
    )
    joined = spread.join(pages.select("doc_id", "page_number", F.col("text").alias("page")), ["doc_id", "page_number"])
    text = F.nullif(strip(F.array_join(F.array_sort(F.collect_list(F.struct("page_number", "page")))["page"], "\n\n")), F.lit(""))
    texts = joined.groupBy("doc_id", "pos").agg(text.alias("text"))
    return nodes.drop("text").join(texts, ["doc_id", "pos"], "left")


def resolve(searches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, doc_id, rank, node fields)`` of the ids a search named, in their order; unknown ids fall away."""
    listed = searches.select("query_id", "doc_id", F.posexplode("node_ids").alias("rank", "node_id"))
    known = nodes.where("node_id is not null")
    last = known.groupBy("doc_id", "node_id").agg(F.max("pos").alias("pos"))
    return listed.join(last, ["doc_id", "node_id"]).join(known.drop("node_id"), ["doc_id", "pos"]).withColumn("rank", F.col("rank") + 1)


def context_and_citations(resolved: DataFrame) -> DataFrame:
    """``(query_id, doc_id, context, citations)`` of resolved nodes with text, in search order."""
    row = F.struct("rank", "node_id", "title", F.col("start_index").alias("start_page"), F.col("end_index").alias("end_page"), "text")
    grouped = resolved.where("text is not null and text <> ''").groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    block = F.transform("r", lambda x: F.concat(F.lit("["), x["title"], F.lit("]\n"), x["text"]))
    cite = F.transform(
        "r", lambda x: F.struct(x["node_id"].alias("node_id"), x["title"].alias("title"), x["start_page"].alias("start_page"), x["end_page"].alias("end_page"))
    )
    return grouped.select("query_id", "doc_id", F.array_join(block, "\n\n---\n\n").alias("context"), cite.alias("citations"))


def outline(tree: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)``: two spaces a level, ``[id] title (pp. s-e)``."""
    order = Window.partitionBy("doc_id").orderBy("path")
    label = F.when(F.col("node_id").isNotNull(), F.concat(F.lit("["), "node_id", F.lit("] "))).otherwise("")
    span = F.format_string(" (pp. %d-%d)", "start_index", "end_index")
    line = F.concat(F.expr("repeat('  ', depth - 1)"), label, F.col("title"), span)
    return tree.select("doc_id", F.row_number().over(order).alias("line_no"), line.alias("line"))


def remove_text(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("text", F.lit(None).cast("string"))


def search_view(nodes: DataFrame) -> DataFrame:
    """What a search sees of a tree: ids, titles, summaries and the nesting, no ranges and no text."""
    return nodes.select("doc_id", "pos", "parent_pos", "path", "depth", "node_id", "title", "summary")


def shape(tree: DataFrame) -> DataFrame:
    """``(doc_id, nodes, depth)`` of every document's tree."""
    return tree.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


FIELDS = ("title", "start_index", "end_index", "node_id", "summary", "text")


def to_json(tree: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(doc_id, structure)``: the nested JSON of each document, null and empty fields left out.

    Built from the deepest level up; children are joined in order into their parent's object.
    """
    rows = cut(tree.select("doc_id", "pos", "parent_pos", "depth", F.to_json(F.struct(*fields)).alias("own")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("json", F.col("own"))
        else:
            comma = F.when(F.col("own") == "{}", F.lit("")).otherwise(",")
            whole = F.concat(F.expr("substring(own, 1, length(own) - 1)"), comma, F.lit('"nodes":['), "kids", F.lit("]}"))
            level = level.join(below, ["doc_id", "pos"], "left").withColumn("json", F.coalesce(whole, F.col("own")))
        kids = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "json")))["json"], ",")
        if depth > 1:
            below = level.groupBy("doc_id", F.col("parent_pos").alias("pos")).agg(kids.alias("kids"))
        else:
            return level.groupBy("doc_id").agg(F.concat(F.lit("["), kids, F.lit("]")).alias("structure"))
    return rows.select("doc_id", F.col("own").alias("structure"))


def from_json(documents: DataFrame) -> DataFrame:
    """Rows of the nested JSON ``(doc_id, structure)``: the inverse of ``to_json``, any depth."""
    columns = ["doc_id", "pos", "parent_pos", "path", "depth", "node_id", "title", "start_index", "end_index", "summary", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows: list[tuple] = []
            for doc, structure in zip(batch["doc_id"], batch["structure"]):
                count = 0
                stack = [(node, None, ()) for node in reversed(json.loads(structure or "[]"))]
                while stack:
                    node, parent, above = stack.pop()
                    count += 1
                    path = (*above, count)
                    fields = [node.get(f) for f in ("node_id", "title", "start_index", "end_index", "summary", "text")]
                    rows.append((doc, count, parent, list(path), len(path), *fields))
                    stack += [(kid, count, path) for kid in reversed(node.get("nodes") or [])]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({c: "Int32" for c in ("pos", "parent_pos", "depth", "start_index", "end_index")})

    schema = (
        "doc_id long, pos int, parent_pos int, path array<int>, depth int, node_id string, title string, "
        "start_index int, end_index int, summary string, text string"
    )
    return documents.select("doc_id", "structure").mapInPandas(run, schema)


def remove_fields(value: object, names: set[str]) -> object:
    """A JSON value without the named keys, at any depth."""
    if isinstance(value, dict):
        return {k: remove_fields(v, names) for k, v in value.items() if k not in names}
    return [remove_fields(v, names) for v in value] if isinstance(value, list) else value
