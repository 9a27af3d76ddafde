"""Settings of the section-tree pipeline."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("toc_with_pages", "toc_no_pages", "no_toc")


@dataclass(frozen=True)
class Settings:
    """Knobs of tree building; values enter plans as literals.

    The names and defaults down to ``overlap_pages`` are fixed values: the public settings that a
    user of the described pipeline knows.
    """

    model: str = "llama-3.3-70b-versatile"
    toc_check_pages: int = 20
    max_pages_per_node: int = 10
    max_tokens_per_node: int = 20_000
    add_node_ids: bool = True
    add_summaries: bool = True
    add_doc_description: bool = False
    add_node_text: bool = False
    max_concurrent_llm_calls: int = 5
    overlap_pages: int = 1
    accuracy_gate: float = 0.6
    fix_rounds: int = 3
    fix_window: int = 5
