"""Completers that need no network: rules over structured inputs, and recorded replies."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.completion.base import Ask, Completer
from quire.completion.folds import rule_ask
from quire.operators.search import NOTHING, first_sentence
from quire.operators.verify import squeezed

LISTED_LINE = r"\A\s*(\d+(?:\.\d+)*)?\.?\s*(\S.*?)[ .]{2,}\d+\s*\z"
TAGGED_PAGE = r"(?s)<physical_index_(\d+)>\n(.*?)\n<physical_index_\1>\n\n"
REPLAYED = 100_000


def _answer(field: str, yes: Column) -> Column:
    reply = F.struct(F.lit("rule").alias("thinking"), F.when(F.coalesce(yes, F.lit(False)), "yes").otherwise("no").alias(field))
    return F.to_json(reply)


def listed_entries(toc: Column, content: Column) -> Column:
    """JSON of the entries of a table of contents, each with the first page that holds its title and is no table itself.

    An entry without such a page in these pages is left out: a later group may show it.
    """
    lines = F.filter(F.split(toc, "\n"), lambda x: x.rlike(LISTED_LINE))
    numbers = F.regexp_extract_all(content, F.lit(TAGGED_PAGE), F.lit(1))
    texts = F.regexp_extract_all(content, F.lit(TAGGED_PAGE), F.lit(2))
    pages = F.zip_with(numbers, texts, lambda n, t: F.struct(n.alias("n"), squeezed(t).alias("t"), is_listing(t).alias("toc")))
    pages = F.filter(pages, lambda p: ~p["toc"])

    def entry(line: Column, at: Column) -> Column:
        number, title = F.regexp_extract(line, LISTED_LINE, 1), F.regexp_extract(line, LISTED_LINE, 2)
        name = squeezed(title)
        found = F.get(F.filter(pages, lambda p: (name != "") & F.contains(p["t"], name)), F.lit(0))["n"]
        return F.struct(
            F.coalesce(F.nullif(number, F.lit("")), (at + 1).cast("string")).alias("structure"), title.alias("title"),
            F.concat(F.lit("<physical_index_"), found, F.lit(">")).alias("physical_index"),
        )

    return F.to_json(F.filter(F.transform(lines, entry), lambda e: e["physical_index"].isNotNull()))


def is_listing(page: Column) -> Column:
    """Whether a page looks like a table of contents: three lines or more that end in a number."""
    return F.size(F.filter(F.split(page, "\n"), lambda x: x.rlike(r"\A.*\S[ .]{2,}\d+\s*\z"))) >= 3


def rules() -> dict[str, Column]:
    """The reply of each stage as an expression over the request's ``inputs``."""
    given = lambda name: F.try_element_at("inputs", F.lit(name))
    title, page = squeezed(given("title")), squeezed(given("page"))
    return {
        "toc_page": _answer("toc_detected", is_listing(given("page"))),
        "extract_toc": given("page"),
        "detect_page_index": _answer("page_index_given_in_toc", given("toc").rlike(r"(?m)\d+\s*$")),
        "index_toc": listed_entries(given("toc"), given("content")),
        "title_appears": _answer("answer", (title != "") & F.contains(page, title)),
        "title_at_start": _answer("start_begin", (title != "") & F.startswith(page, title)),
        "summary": first_sentence(given("text")),
        "describe": first_sentence(given("text")),
        "answer": F.when(F.coalesce(given("context"), F.lit("")) == "", F.lit(NOTHING)).otherwise(F.substring(given("context"), 1, 200)),
    }


class RuleCompleter(Completer):
    """Deterministic replies from ``inputs`` alone, inside Catalyst; unknown stages give an error row."""

    name = "rule"

    def __init__(self, extra: Mapping[str, Column] | None = None) -> None:
        self.rules = {**rules(), **(extra or {})}

    def ask(self) -> Ask:
        return rule_ask

    def complete(self, requests: DataFrame) -> DataFrame:
        text = F.coalesce(*[F.when(F.col("stage") == stage, reply) for stage, reply in self.rules.items()])
        known = F.col("stage").isin(*self.rules)
        return requests.dropDuplicates(["req_id"]).select(
            "req_id", text.alias("text"), F.lit("stop").alias("finish_reason"),
            F.when(known, "ok").otherwise("error").alias("status"), F.when(~known, F.concat(F.lit("no rule for "), "stage")).alias("error"),
        )


class ReplayCompleter(Completer):
    """Replies recorded as ``(req_id, text, finish_reason)``; a request that is not there is a ``miss``.

    Sequential stages look their replies up in a table that every worker holds: at most ``REPLAYED``
    recorded rows, more are an error; name the rows with ``sequential`` where the record is larger.
    """

    name = "replay"

    def __init__(self, recorded: DataFrame, sequential: DataFrame | None = None) -> None:
        self.recorded = recorded.groupBy("req_id").agg(F.min_by("text", F.struct("finish_reason", "text")).alias("text"), F.min("finish_reason").alias("finish_reason"))
        self.sequential = sequential if sequential is not None else self.recorded

    def ask(self) -> Ask:
        name = self.name
        rows = self.sequential.select("req_id", "text").limit(REPLAYED + 1).collect()
        if len(rows) > REPLAYED:
            raise ValueError(f"more than {REPLAYED} recorded replies of sequential stages")
        held = {r["req_id"]: r["text"] for r in rows}

        def look_up(stage: str, prompt: str, inputs: dict[str, str]) -> str:
            key = hashlib.sha256(f"{name}\x1f{prompt}".encode()).hexdigest()
            if key not in held:
                raise LookupError(f"no recorded reply for {stage}")
            return held[key]

        return look_up

    def complete(self, requests: DataFrame) -> DataFrame:
        known = self.recorded.select("req_id", "text", F.coalesce("finish_reason", F.lit("stop")).alias("finish_reason"), F.lit("ok").alias("found"))
        joined = requests.select("req_id").distinct().join(known, "req_id", "left")
        return joined.select("req_id", "text", "finish_reason", F.coalesce("found", F.lit("miss")).alias("status"), F.lit(None).cast("string").alias("error"))
