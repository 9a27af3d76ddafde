"""Pages grouped under a token budget with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import count_tokens, tag_page


def group_ranges(tokens: Column, max_tokens: int = 20_000, overlap: int = 1) -> Column:
    """``array<struct<st,en>>``: half-open ranges of page places, from the pages' token counts.

    Everything in one range if it fits. Otherwise the target is the mean of an even share and the
    budget, rounded up; a range closes before the page that would exceed it, unless it is empty, and
    the next one starts ``overlap`` pages earlier. A fold inside one expression: no shuffle.
    """
    total = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.size(tokens)
    parts = F.ceil(total / F.lit(max_tokens))
    target = F.ceil((total / parts + F.lit(max_tokens)) / 2)
    empty = F.array().cast("array<struct<st:int,en:int>>")
    state = F.struct(F.lit(0).alias("st"), F.lit(0).cast("long").alias("c"), empty.alias("done"))

    def step(acc: Column, i: Column) -> Column:
        token = F.get(tokens, i)
        full = (acc["c"] + token > target) & (acc["c"] > 0)
        start = F.greatest(F.lit(0), i - F.lit(overlap))
        start = F.when(start < acc["st"], acc["st"]).otherwise(start)
        again = F.aggregate(F.slice(tokens, start + 1, i - start), F.lit(0).cast("long"), lambda a, x: a + x)
        closed = F.array_append(acc["done"], F.struct(acc["st"].alias("st"), i.alias("en")))
        return F.struct(
            F.when(full, start).otherwise(acc["st"]).alias("st"),
            F.when(full, again + token).otherwise(acc["c"] + token).alias("c"),
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
        )

    places = F.sequence(F.lit(0), n - 1)
    folded = F.aggregate(places, state, step, lambda acc: F.array_append(acc["done"], F.struct(acc["st"].alias("st"), n.alias("en"))))
    whole = F.array(F.struct(F.lit(0).alias("st"), n.alias("en")))
    return F.when(n == 0, empty).when(total <= max_tokens, whole).otherwise(folded)


def group_pages(pages: DataFrame, max_tokens: int = 20_000, overlap: int = 1, doc: str = "doc_id") -> DataFrame:
    """``(doc, group_no, first_page, last_page, tokens, text)`` of ``pages(doc, page_number, text, token_count)``.

    ``text`` is the plain concatenation of the group's pages. A document is the unit of one row, as
    its groups are the input of one model call each.
    """
    listed = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_number", "token_count", "text"))).alias("p"))
    ranged = listed.select(doc, "p", F.posexplode(group_ranges(F.col("p.token_count"), max_tokens, overlap)).alias("g", "r"))
    part = F.slice("p", F.col("r.st") + 1, F.col("r.en") - F.col("r.st"))
    return ranged.select(doc, (F.col("g") + 1).alias("group_no"), part.alias("q")).select(
        doc, "group_no",
        F.element_at("q.page_number", 1).alias("first_page"), F.element_at("q.page_number", -1).alias("last_page"),
        F.aggregate("q.token_count", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"),
        F.array_join("q.text", "").alias("text"),
    )


def tag_pages(pages: DataFrame, start_index: int | None = None) -> DataFrame:
    """Pages with their text tagged and their tokens counted on the tagged text.

    Tags name the page's own number, or with ``start_index`` the number counted from there in page
    order, for a range of pages that was cut out of a document.
    """
    number = F.col("page_number")
    if start_index is not None:
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")) + (start_index - 1)
    tagged = tag_page(F.col("text"), number)
    return pages.withColumn("text", tagged).withColumn("token_count", count_tokens(F.col("text")))


def group_page_contents(pages: DataFrame, max_tokens: int = 20_000, overlap: int = 1, doc: str = "doc_id") -> DataFrame:
    """Tagged pages in groups: the input of the section-list stages."""
    return group_pages(tag_pages(pages), max_tokens, overlap, doc)
