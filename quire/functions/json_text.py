"""Repair and reading of model JSON, as columns."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fixed(text: Column) -> Column:
    """Literals of other notations and trailing commas put right."""
    for word, literal in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"\b{word}\b", literal)
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def repair_json(content: Column) -> Column:
    """The JSON text within a model's reply, or null.

    In this order: without a code fence and with literals and commas repaired; the same read with
    single quotes; else the widest ``{...}``, else the widest ``[...]``, repaired likewise.
    """
    bare = F.regexp_replace(F.regexp_replace(strip(content), r"\A```(?:json)?\s*", ""), r"\s*```\z", "")

    def valid(text: Column) -> Column:
        return F.when((F.length(text) > 0) & F.try_parse_json(text).isNotNull(), text)

    def read(text: Column) -> Column:
        single = ~text.contains('"') & text.contains("'")
        return F.coalesce(valid(text), F.when(single, let(F.translate(text, "'", '"'), valid)))

    def found(clean: Column) -> Column:
        widest = (F.regexp_extract(clean, p, 0) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]"))
        return F.coalesce(read(clean), *(let(part, read) for part in widest))

    return let(_fixed(strip(bare)), found)


def extract_json(content: str) -> object:
    """The same for one reply in Python, where the value itself is wanted; raises ``ValueError``."""
    text = re.sub(r"\s*```\Z", "", re.sub(r"\A```(?:json)?\s*", "", content.strip())).strip()

    def read(part: str) -> object:
        fixed = re.sub(r"\bNone\b", "null", re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", part)))
        fixed = re.sub(r",\s*([}\]])", r"\1", fixed)
        try:
            return json.loads(fixed)
        except ValueError:
            return ast.literal_eval(part)

    for part in (text, *(m[0] for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, text, re.DOTALL)))):
        try:
            return read(part)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    raise ValueError("no JSON value in the reply")


def safe_extract_json(content: str, default: object = None) -> object:
    """``extract_json`` with a default instead of an error."""
    try:
        return extract_json(content)
    except (ValueError, AttributeError, TypeError):
        return default


def parse_index(value: Column) -> Column:
    """The page number in a tag, or an integer text; else null. Whole text is scanned for the tag."""
    tagged = F.nullif(F.regexp_extract(value, r"physical_index_(\d+)", 1), F.lit(""))
    plain = F.when(value.rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim(value))
    return F.coalesce(tagged.try_cast("int"), plain.try_cast("int"))


def parse_json_index(value: Column) -> Column:
    """The same for a JSON value (``VARIANT``): whole numbers count, other floats do not."""
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, parse_index(text)).when(number == F.floor(number), number.cast("int"))


def is_yes(value: Column) -> Column:
    """Whether an answer field says yes; a missing one says no."""
    return strip(F.lower(F.coalesce(value, F.lit("no")))) == "yes"


def node_list(reply: Column) -> Column:
    """``struct(thinking, node_ids)`` of a search reply; empty for anything that is no object."""
    read = F.from_json(reply, "thinking string, node_list array<string>")
    ids = F.filter(read["node_list"], lambda x: x.isNotNull() & ~x.isin("", "0"))
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(read["thinking"], F.lit("")).alias("thinking"), F.coalesce(ids, none).alias("node_ids"))


ITEMS = "array<struct<structure:string,title:string,physical_index:string,page:string>>"


def toc_envelope(reply: Column) -> Column:
    """The items of a reply that is a list or an object with ``table_of_contents``; else an empty list."""
    wrapped = F.from_json(reply, f"table_of_contents {ITEMS}")["table_of_contents"]
    return F.coalesce(F.when(reply.rlike(r"\A\s*\["), F.from_json(reply, ITEMS)), wrapped, F.array().cast(ITEMS))
