"""Text values that lost their end when they were stored or sent.

A value that stops without closing its last sentence is a suspect. Its unfinished sentence, names and
numbers masked, is sorted among the closed sentences of all values: of the sentences that begin with
it, the smallest is its neighbour in that order, so one pass over the sorted rows tells whether it is
a strict prefix of a longer sentence elsewhere. Hashed prefixes of fixed length judge the fragments
of which no longer copy exists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.normal_form import skeleton
from quire.runtime import cut, spread

# How stored texts mark that something was left out, and what a broken transfer leaves.
MARKS = re.compile(
    r"(?:\.{3,}|…|\[(?:\.{3}|…|cut|truncated|more|snip)\]|\((?:cut|truncated|cont(?:inued|'d)?\.?)\)?"
    r"|\\u?[0-9a-fA-F]{0,4}|\\[nrt]|&#?\w{0,7};?|</?\w*|[\"'],|�+)\s*$"
)
CLOSED = re.compile(r"[.!?。！？][\"'»”’)\]}*_]*$")
CITED = re.compile(r"(?:\[\d+(?:\s*[,–-]\s*\d+)*\]|\([^()]*\))$")
ABBREVIATED = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|cf|Fig|Figs|Sec|Eq|Eqs|Tab|No|pp|vs|ca|bzw|z\.\s?B|vgl|siehe S|p\. ?ej|véase p|approx|al)\.$")
ENDS = re.compile(r"(?<=[.!?。！？])[\"'»”’)\]]*\s+")
NAMED = re.compile(r"\w*\d\w*|\w+[A-Z]\w*")
NEAR = 3
MARK_CHARS = 64
CACHED_WORDS, HELD_SENTENCES = 200_000, 200_000
LISTED = r"^(?:[-*+•·‣–—]|[(]?[0-9]{1,3}[.)]) "
PLACEHOLDER = re.compile(
    r"[\s\W_]*|\W*(?:n/?a|none|null|nil|nan|undefined|tbd|tba|todo|empty|missing|no summary|no content|unknown|placeholder|lorem ipsum)\W*", re.I
)


# Control, format and unassigned characters other than line breaks and tabs.
INVISIBLE = regex.compile(r"[\p{Cc}\p{Cf}\p{Cn}\p{Co}--[\n\t]]", regex.V1)


@lru_cache(maxsize=16)
def visible(text: str) -> str:
    """A text without invisible characters, its outer spaces removed."""
    return (text if text.isascii() and text.isprintable() else INVISIBLE.sub("", text)).strip()


def is_empty(text: str) -> bool:
    """No content: nothing, invisible characters or a placeholder."""
    return PLACEHOLDER.fullmatch(visible(text)) is not None


def repeats(title: str, text: str) -> bool:
    """Whether a text says nothing but its title, with a word or two around it."""
    name, value = (" ".join(re.findall(r"\w+", skeleton(visible(t)).casefold())) for t in (title, text))
    return bool(name) and len(value.replace(name, "").split()) <= 2


class Ending(NamedTuple):
    open: bool  # the last sentence is not closed
    marked: bool  # a mark of omission or a broken character stands at the end
    tail: str  # the unfinished sentence
    after: bool  # closed sentences come before it


def last_mark(value: str) -> re.Match[str] | None:
    """The mark of omission that ends a value; long runs of signs count from ``MARK_CHARS`` before the end."""
    return MARKS.search(value, max(0, len(value) - MARK_CHARS))


def ending(text: str) -> Ending:
    """How a value ends."""
    value = visible(text)
    marked = last_mark(value) is not None
    bare = value
    while marked and (m := last_mark(bare)) and m.start() > 0:
        bare = bare[: m.start()].rstrip()
    loose = bare.rfind("(") > bare.rfind(")")
    broken = loose and len(bare) - bare.rfind("(") < 40 or bare.endswith("[")
    if broken and ABBREVIATED.search(bare) or loose and re.search(r"\((?:\w+\s?\d*|see \w+\.?)$", bare):
        bare, marked = bare[: bare.rfind("(")].rstrip(), True
    short = ABBREVIATED.search(bare)
    if short:
        bare, marked = bare[: short.start()].rstrip(), True
    marked = marked or bare.endswith("[") or bare.rfind("“") > bare.rfind("”")
    closed = not short and not loose and (CLOSED.search(bare) or CITED.search(bare)) is not None
    if closed and marked:
        closed = not re.search(r"\.{3,}|…|�", value[len(bare) :]) and bool(CLOSED.search(bare))
    if closed:
        return Ending(False, False, "", True)
    parts = ENDS.split(bare)
    tail = parts[-1]
    return Ending(True, marked, tail, len(parts) > 1)


_FORMS: dict[str, tuple[str, str]] = {}


def _forms(word: str) -> tuple[str, str]:
    """A word's masked form at the start of a sentence and within it."""
    core = word.strip("([{\"'“”„«».,;:!?)]}")
    sign = "#" + (word[-1] if word[-1] in ",;:" else "")
    first = sign if NAMED.fullmatch(core.replace("-", "")) else word.lower()
    found = first, sign if core[:1].isupper() else first
    if len(_FORMS) >= CACHED_WORDS:
        _FORMS.clear()
    _FORMS[word] = found
    return found


def masked(sentence: str) -> list[str]:
    """The words of a sentence, names and numbers replaced by one sign."""
    words = skeleton(sentence).split()
    held = _FORMS.get
    out = [(held(w) or _forms(w))[1] for w in words]
    if words:
        out[0] = _forms(words[0])[0]
    return out


def near_of(words: list[str]) -> str | None:
    """The fixed-length prefix of a sentence: its first ``NEAR`` words; null where there are no more than these."""
    return " ".join(words[:NEAR]) if len(words) > NEAR else None


PARSED = "key {kind}, marked boolean, after boolean, words int, sentence string, near string, closed long, open long"


def parsed(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """Suspects and sentences of all values, read once.

    A row with a ``key`` is a suspect: its masked unfinished ``sentence`` of so many ``words``, whether
    it is ``marked`` and comes ``after`` closed sentences. A row without is a masked sentence and how
    often it was met ``closed`` and ``open``, added up per task. A value that only repeats its title
    is complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

        def sentences() -> list[tuple]:
            rows = [(None, None, None, None, s, near_of(s.split(" ", NEAR)), *n) for s, n in counts.items() if s]
            counts.clear()
            return rows

        for batch in batches:
            types = [batch.column(0).type, pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            rows = []
            titles = batch.column(2).to_pylist() if title else [None] * batch.num_rows
            for k, value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), titles):
                end = ending(value)
                *before, last = ENDS.split(visible(value))
                for sentence in before:
                    counts.setdefault(" ".join(masked(sentence)), [0, 0])[0] += 1
                counts.setdefault(" ".join(masked(last)), [0, 0])[end.open] += 1
                if k is None or not end.open or is_empty(value) or name and repeats(name, value):
                    continue
                words = masked(end.tail)
                if words or end.marked:
                    rows.append((k, end.marked, end.after, len(words), " ".join(words), near_of(words), None, None))
            yield out(rows + sentences() if len(counts) >= HELD_SENTENCES else rows)
        if counts:
            yield out(sentences())

    kind = df.schema[key].dataType.simpleString()
    schema = PARSED.format(kind=kind)
    names = [part.split()[0] for part in schema.split(", ")]
    read = [F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(title).alias("title")] if title else [])]
    return spread(df.where(F.col(text).isNotNull()).select(*read)).mapInArrow(run, schema)


def continued(rows: DataFrame) -> DataFrame:
    """The suspects among ``parsed`` rows with ``goes_on``: a longer closed sentence begins with theirs.

    Rows are sorted downwards by sentence over ranges of any number, so no opening, however common,
    falls to one task whole. All sentences that begin with a fragment stand directly before it; the
    last closed one met is the smallest of them, and one comparison decides. A fragment before the
    first closed sentence of its range waits for the last one of the ranges before: one sentence a
    range goes through the driver.
    """
    kind = rows.schema["key"].dataType.simpleString()
    used = rows.where("key is not null or closed > 0").select("key", "marked", "after", "words", "sentence", "near")
    ordered = used.repartitionByRange(F.desc("sentence")).sortWithinPartitions(F.desc("sentence"))
    schema = f"key {kind}, marked boolean, after boolean, words int, sentence string, near string, goes_on boolean, place int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, larger, kinds = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            kept, marks, kinds = [], [], [c.type for c in batch.columns]
            for i, (key, sentence) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())):
                if key is None:
                    if sentence != last:
                        last, larger = sentence, last
                else:
                    kept.append(i)
                    near = larger if last == sentence else last
                    marks.append(None if near is None else extends(near, sentence))
            part = batch.take(pa.array(kept, pa.int64()))
            places = pa.array([place] * len(kept), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.bool_()), places], names)
        if kinds:
            end = [pa.nulls(1, kind) for kind in kinds]
            end[4] = pa.array([last], pa.string())
            yield pa.RecordBatch.from_arrays([*end, pa.array([None], pa.bool_()), pa.array([place], pa.int32())], names)

    names = [part.split()[0] for part in schema.split(", ")]
    found = cut(ordered.mapInArrow(run, schema))
    before, last = [], None
    for end in sorted(found.where("key is null").select("place", "sentence").collect(), key=lambda r: r["place"]):
        before.append((end["place"], last))
        last = end["sentence"] or last
    ranges = F.broadcast(rows.sparkSession.createDataFrame(before, "place int, before string"))
    columns = ["key", "marked", "after", "words", "sentence", "near"]
    waiting = found.where("key is not null and goes_on is null").join(ranges, "place")
    late = (F.col("sentence") != "") & F.startswith("before", "sentence") & (F.length("before") > F.length("sentence"))
    waiting = waiting.select(*columns, F.coalesce(late, F.lit(False)).alias("goes_on"))
    return found.where("goes_on is not null").select(*columns, "goes_on").unionByName(waiting)


def extends(longer: str, fragment: str) -> bool:
    return bool(fragment) and len(longer) > len(fragment) and longer.startswith(fragment)


def judged(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """``(key, reason)`` of all suspects; ``reason`` is null where nothing tells that the end is missing.

    ``prefix``: a longer closed sentence elsewhere goes on from the fragment, which is no list item
    and has two words or more besides masked names, or follows closed sentences or carries a mark.
    ``opening``: of the sentences elsewhere with the same first ``NEAR`` words most are closed.
    ``mark``: it ends in a mark of omission or a broken character. ``after``: it follows closed
    sentences.
    """
    rows = cut(parsed(df, key, text, title))
    asked = continued(rows)
    alike = rows.where("key is null and near is not null").groupBy("near").agg((F.sum("closed") > F.sum("open")).alias("closes"))
    telling = ~F.col("sentence").rlike(LISTED) & F.expr("size(filter(split(sentence, ' '), w -> w not like '#%')) > 1")
    reason = (
        F.when(F.col("goes_on") & (telling | F.col("after") | F.col("marked")), "prefix")
        .when(F.col("closes"), "opening").when(F.col("marked"), "mark").when(F.col("after"), "after")
    )
    return asked.join(alike, "near", "left").select("key", reason.alias("reason"))


def truncated(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """``key`` of the values that were cut off, each once.

    Cut: the open last sentence is the strict prefix of a longer closed one elsewhere, however many
    copies are open too; where no longer copy exists, it begins as mostly closed sentences do by
    ``NEAR`` words, or carries a mark of omission, or follows closed sentences. A list, a heading-like
    phrase or a value that repeats its title is complete without a full stop. Null, empty, invisible
    and placeholder values lost nothing; a value cut exactly behind a full stop cannot be told from a
    complete one. Values of any length are read whole.
    """
    return judged(df, key, text, title).where("reason is not null").select(F.col("key").alias(key)).distinct()


def shares(df: DataFrame, found: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(source, values, truncated, share)``: how often each source truncates, null sources included."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(source).alias("source"))
    marks = found.select(F.col(key).alias("k"), F.lit(1).alias("was_cut"))
    out = rows.join(marks, "k", "left").groupBy("source")
    counted = out.agg(F.count(F.lit(1)).alias("values"), F.count("was_cut").alias("truncated"))
    return counted.withColumn("share", F.col("truncated") / F.col("values"))
