"""Section lists that grow group by group: each reply is asked with what came before it.

A fold is sequential within a document and runs on its groups, not its pages; documents run in
parallel. ``ask(stage, prompt, inputs)`` is any picklable callable: rules here, a backend elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd

from quire.completion import prompts
from quire.completion.base import Ask
from quire.functions.json_text import safe_extract_json

TAG = re.compile(r"<physical_index_(\d+)>\n(.*?)\n<physical_index_\1>\n\n", re.DOTALL)
NUMBERED = re.compile(r"^\s*(?:#+\s*)?(\d+(?:\.\d+)*)\.?[ \t]+(\S.{0,80})$")
LISTED = re.compile(r"^\s*(\d+(?:\.\d+)*)?\.?\s*(\S.*?)[ .]{2,}(\d+)\s*$")


LISTED_PAGE = 3


def tagged_pages(content: str) -> list[tuple[int, str]]:
    """Numbers and texts of the pages of a group."""
    return [(int(n), text) for n, text in TAG.findall(content)]


def is_listing(text: str) -> bool:
    """Whether a page is itself a table of contents: ``LISTED_PAGE`` lines or more end in a number."""
    return sum(LISTED.match(line) is not None for line in text.split("\n")) >= LISTED_PAGE


def rule_ask(stage: str, prompt: str, inputs: dict[str, str]) -> str:
    """Deterministic replies: numbered lines are sections, listed lines are entries of a table of contents.

    An entry's page is the first that holds its title and is no table of contents itself.
    """
    if stage in ("first_sections", "more_sections"):
        known = {i["title"] for i in json.loads(inputs.get("toc") or "[]")}
        found = []
        for number, text in tagged_pages(inputs["content"]):
            for line in text.split("\n"):
                if (m := NUMBERED.match(line)) and m[2].strip() not in known:
                    known.add(m[2].strip())
                    found.append({"structure": m[1], "title": m[2].strip(), "physical_index": f"<physical_index_{number}>"})
        return json.dumps(found)
    if stage == "transform_toc":
        rows = [m for line in inputs["toc"].split("\n") if (m := LISTED.match(line))]
        return json.dumps({"table_of_contents": [{"structure": m[1] or str(i), "title": m[2], "page": int(m[3])} for i, m in enumerate(rows, 1)]})
    if stage == "add_page_numbers":
        items = json.loads(inputs["toc"])
        for item in items:
            title = re.sub(r"\s+", "", str(item.get("title", ""))).lower()
            for number, text in tagged_pages(inputs["content"]):
                if item.get("physical_index") is None and title and not is_listing(text) and title in re.sub(r"\s+", "", text).lower():
                    item["physical_index"] = f"<physical_index_{number}>"
        return json.dumps(items)
    raise ValueError(f"no rule for {stage}")


def _rows(value: object) -> list[dict]:
    if isinstance(value, dict):
        value = value.get("table_of_contents", [])
    return [i for i in value if isinstance(i, dict)] if isinstance(value, list) else []


def fold_no_toc(groups: Iterable[str], ask: Ask) -> list[dict]:
    """Sections of the first group, then the further ones of each group; a bad later reply adds nothing."""
    items: list[dict] = []
    for number, content in enumerate(groups):
        so_far = json.dumps(items)
        if number == 0:
            reply = ask("first_sections", prompts.first_sections(content), {"content": content})
        else:
            try:
                reply = ask("more_sections", prompts.more_sections(so_far, content), {"toc": so_far, "content": content})
            except Exception:
                continue
        items += _rows(safe_extract_json(reply, []))
    return items


def fold_no_pages(toc: str, groups: Iterable[str], ask: Ask) -> list[dict]:
    """Entries of a table of contents without pages; every group's reply replaces the list, a bad one keeps it."""
    items = _rows(safe_extract_json(ask("transform_toc", prompts.transform_toc(toc), {"toc": toc}), {}))
    for content in groups:
        now = json.dumps(items)
        try:
            reply = ask("add_page_numbers", prompts.add_page_numbers(content, now), {"toc": now, "content": content})
        except Exception:
            continue
        items = _rows(safe_extract_json(reply, None)) or items
    return items


COLUMNS = ["doc_id", "pos", "structure", "title", "physical_index", "error"]
SCHEMA = "doc_id long, pos int, structure string, title string, physical_index string, error string"


def folded(mode: str, ask: Ask) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The fold of one document's groups ``(doc_id, group_no, text, toc)`` as a grouped map; an error is one row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("group_no")
        doc, texts = int(frame["doc_id"].iloc[0]), frame["text"].tolist()
        try:
            items = fold_no_toc(texts, ask) if mode == "no_toc" else fold_no_pages(frame["toc"].iloc[0] or "", texts, ask)
        except Exception as error:
            return pd.DataFrame([(doc, 0, None, None, None, f"{type(error).__name__}: {error}")], columns=COLUMNS)
        text = lambda v: None if v is None else str(v)
        rows = [(doc, n, text(i.get("structure", "")), text(i.get("title", "")), text(i.get("physical_index")), None) for n, i in enumerate(items, 1)]
        return pd.DataFrame(rows, columns=COLUMNS)

    return run
