"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import spread

MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 8_000, 200, 4
# Penalty of a cut by kind: paragraph, line, sentence, word, anywhere.
PENALTIES = (0.0, 0.05, 0.1, 1.0, 8.0)
SENTENCE = re.compile(r"[.!?。！？]+[\"'»”’)\]]*\s+|[。！？]")
PARAGRAPH, LINE, WORD = re.compile(r"\n[ \t]*\n\s*"), re.compile(r"\n"), re.compile(r"\s+")
COMBINING = re.compile(r"[̀-ͯ‌‍︀-️]")


def tokens(text: Column) -> Column:
    """Tokens of a text: code points div 4, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def boundaries(text: str, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, in order, with their penalties.

    Paragraphs, lines and sentences everywhere; in stretches longer than ``gap`` without any, word
    ends; where even those lack, every ``gap``-th position that splits no combined character.
    """
    found: dict[int, float] = {}
    for kind, pattern in ((2, SENTENCE), (1, LINE), (0, PARAGRAPH)):
        for m in pattern.finditer(text):
            found[m.end()] = PENALTIES[kind]
    end = len(text)
    fixed = [0, *sorted(p for p in found if 0 < p < end), end]
    for a, b in zip(fixed, fixed[1:]):
        if b - a > gap:
            words = [m.end() for m in WORD.finditer(text, a, b) if a < m.end() < b]
            found.update((p, PENALTIES[3]) for p in words)
            inner = [a, *words, b]
            for c, d in zip(inner, inner[1:]):
                for p in range(c + gap, d, gap) if d - c > gap else ():
                    while p > c + 1 and COMBINING.match(text, p):
                        p -= 1
                    found.setdefault(p, PENALTIES[4])
    found.pop(0, None)
    found[end] = 0.0
    places = np.array(sorted(p for p in found if p <= end), dtype=np.int64)
    return places, np.array([found[p] for p in places.tolist()])


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``text``: dynamic programming over boundaries.

    Minimises the sum of cut penalties and squared relative deviations from an even size, subject
    to ``limit`` characters a piece including the ``overlap`` it repeats.
    """
    if limit <= overlap or limit < 2:
        raise ValueError("the limit must exceed the overlap")
    n = len(text)
    if n <= limit:
        return [n]
    room = limit - overlap
    pieces = 1 + -(-(n - limit) // room)
    target = (n - overlap) / pieces
    places, penalty = boundaries(text, max(1, room // 8))
    places = np.concatenate(([0], places))
    penalty = np.concatenate(([0.0], penalty))
    size = len(places)
    best, back = np.full(size, np.inf), np.zeros(size, dtype=np.int64)
    best[0] = 0.0
    for i in range(1, size):
        low = int(np.searchsorted(places, places[i] - room))
        spans = (places[i] - places[low:i]).astype(float)
        if low == 0:
            spans[0] -= overlap
        cost = best[low:i] + ((spans - target) / target) ** 2
        j = int(np.argmin(cost)) if i > low else -1
        value = cost[j] if j >= 0 else np.inf
        chosen = low + j
        if low > 0 and places[i] <= limit and (first := ((places[i] - overlap - target) / target) ** 2) < value:
            value, chosen = first, 0
        best[i], back[i] = value + penalty[i], chosen
    ends, at = [], size - 1
    while at > 0:
        ends.append(int(places[at]))
        at = int(back[at])
    return ends[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[str]:
    """The pieces of ``text``; each after the first starts with the last ``overlap`` characters of the one before."""
    ends = cut_points(text, limit, overlap)
    starts = [0, *(max(0, e - overlap) for e in ends[:-1])]
    return [text[a:b] for a, b in zip(starts, ends)]


def pieces(
    df: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS
) -> DataFrame:
    """``(key, piece_no, start, piece_tokens, piece)`` of every text above ``max_tokens``.

    Tokens are code points div 4, at least 1, counted from the text itself. Texts within the limit,
    null and empty ones and rows without a key give no row. ``start`` is the piece's offset. The
    size filter runs before Python, so only oversized texts are read there, one at a time and whole;
    copies of a key give equal pieces, which the caller counts once.
    """
    limit = max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    overlap = overlap_tokens * CHARS_PER_TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                ends = cut_points(value, limit, overlap)
                starts = [0, *(max(0, e - overlap) for e in ends[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(ends), batch.column(0).type),
                        pa.array(range(1, len(ends) + 1), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([max(1, (b - a) // CHARS_PER_TOKEN) for a, b in zip(starts, ends)], pa.int64()),
                        pa.array([value[a:b] for a, b in zip(starts, ends)], pa.string()),
                    ],
                    [key, "piece_no", "start", "piece_tokens", "piece"],
                )

    kind = df.schema[key].dataType.simpleString()
    large = df.where(F.col(key).isNotNull() & (tokens(F.col(text)) > max_tokens)).select(key, text)
    return spread(large).mapInArrow(run, f"`{key}` {kind}, piece_no int, start long, piece_tokens long, piece string")
