"""Prompts by task. Each states the shape of the reply that the readers expect."""

from __future__ import annotations

import json

_JSON = "Reply with JSON only, no other text."
_TAGS = "Page borders are marked by <physical_index_N> tags; N is the page number."


def toc_page(content: str) -> str:
    return f'Does the page below hold a table of contents? Abstracts, lists of figures and of symbols do not count.\n{_JSON} {{"thinking": "...", "toc_detected": "yes" or "no"}}\n\nPage:\n{content}'


def toc_complete(content: str, toc: str) -> str:
    return f'Does this table of contents cover every main section of the document?\n{_JSON} {{"thinking": "...", "completed": "yes" or "no"}}\n\nDocument:\n{content}\n\nTable of contents:\n{toc}'


def toc_transform_complete(content: str, toc: str) -> str:
    return f'Does the cleaned table of contents hold every entry of the raw one?\n{_JSON} {{"thinking": "...", "completed": "yes" or "no"}}\n\nRaw:\n{content}\n\nCleaned:\n{toc}'


def extract_toc(content: str) -> str:
    return f"Copy the full table of contents out of the text below. Write ':' for leader dots. Reply with the table only.\n\nText:\n{content}"


def detect_page_index(toc: str) -> str:
    return f'Does this table of contents give page numbers?\n{_JSON} {{"thinking": "...", "page_index_given_in_toc": "yes" or "no"}}\n\nTable of contents:\n{toc}'


def transform_toc(toc: str) -> str:
    return f'Turn the table of contents into JSON. "structure" is the section number in dot notation, "page" the number given or null.\n{_JSON} {{"table_of_contents": [{{"structure": "1.2", "title": "...", "page": 3}}]}}\n\nTable of contents:\n{toc}'


def continue_reply() -> str:
    return "The reply was cut off. Go on exactly where it stopped, without repeating anything."


def index_toc(toc: str, content: str) -> str:
    return f'Give each entry of the table of contents the page it starts on, as far as these pages show it. {_TAGS}\n{_JSON} [{{"structure": "1.2", "title": "...", "physical_index": "<physical_index_3>"}}]\n\nTable of contents:\n{toc}\n\nPages:\n{content}'


def add_page_numbers(part: str, structure: str) -> str:
    return f'For each section tell whether it starts in these pages, and if so on which one. {_TAGS} Keep earlier answers.\n{_JSON} [{{"structure": "1.2", "title": "...", "start": "yes" or "no", "physical_index": "<physical_index_3>" or null}}]\n\nPages:\n{part}\n\nSections:\n{structure}'


def first_sections(part: str) -> str:
    return f'List the sections that start in these pages, with their own wording as title. {_TAGS}\n{_JSON} [{{"structure": "1.2", "title": "...", "physical_index": "<physical_index_3>"}}]\n\nPages:\n{part}'


def more_sections(toc: str, part: str) -> str:
    return f'Given the sections found so far, list only the further ones that start in these pages. {_TAGS}\n{_JSON} [{{"structure": "1.3", "title": "...", "physical_index": "<physical_index_4>"}}]\n\nPages:\n{part}\n\nSo far:\n{toc}'


def title_appears(title: str, page_text: str) -> str:
    return f'Does this section appear or start on the page? Compare loosely and ignore spacing.\n{_JSON} {{"thinking": "...", "answer": "yes" or "no"}}\n\nSection: {title}\n\nPage:\n{page_text}'


def title_at_start(title: str, page_text: str) -> str:
    return f'Does this section begin at the very top of the page, with nothing before it? Compare loosely and ignore spacing.\n{_JSON} {{"thinking": "...", "start_begin": "yes" or "no"}}\n\nSection: {title}\n\nPage:\n{page_text}'


def fix_entry(title: str, content: str) -> str:
    return f'On which of these pages does the section start? {_TAGS}\n{_JSON} {{"thinking": "...", "physical_index": "<physical_index_3>"}}\n\nSection: {title}\n\nPages:\n{content}'


def summarize(text: str) -> str:
    return f"Describe in a few sentences what this part of a document covers. Reply with the description only.\n\nText:\n{text}"


def as_json(value: object) -> str:
    """JSON text as it is given, any other value as JSON."""
    return value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False)


def describe(structure: object) -> str:
    return f"Describe in one sentence what sets this document apart from others. Reply with the sentence only.\n\nStructure:\n{as_json(structure)}"


def search(query: str, tree: object, preference: str | None = None) -> str:
    hint = f"\n\nAdvice from an expert: {preference}" if preference else ""
    return f'Which nodes of the tree are likely to hold the answer? Most relevant first.{hint}\n{_JSON} {{"thinking": "...", "node_list": ["0003", "0007"]}}\n\nQuestion: {query}\n\nTree:\n{as_json(tree)}'


def answer(query: str, context: str) -> str:
    return f"Answer the question from the context alone, and briefly.\n\nQuestion: {query}\n\nContext:\n{context}"
