"""Evaluation texts that leaked into a corpus.

Both sides are read as words without case, punctuation, markup and escapes. Windows of a document get
a 64-bit SimHash of their words' character trigrams. Windows have an item's size and half of it,
rounded down to a power of two, for copies of the whole, and ``WINDOW`` words for parts with changes.
The items' fingerprints are indexed by four 16-bit blocks: two fingerprints within Hamming distance 3
agree in one block, so every such pair is found. A document and an item that share a fingerprint are
compared exactly: the weighted similarity of their shingles decides which go on to the last check,
the aligned stretches that make a case.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from math import log
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.normal_form import skeleton
from quire.runtime import cut, spread

WINDOW, RADIUS, BLOCKS = 6, 3, 4
HALF, STRETCHES, MAX_GAP, MIN_STRETCH, SHORT = 0.5, 2, 6, 4, 6
MIN_SIMILARITY = 0.25
ITEMS_PER_BLOCK, CHARS_PER_BLOCK = 20_000, 20_000_000
CACHED_WORDS, CHUNK_WORDS, MAX_SHORT = 300_000, 50_000, 256

ESCAPES = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrt])|([\"'/\\]))")
BROKEN = re.compile(r"(?<=[^\W\d_])[-\xad]\s*\n\s*(?=[^\W\d_])")
TAGS = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
LEADING = re.compile(r"^[ \t]*[>#|]+", re.MULTILINE)
SIGNS = re.compile(r"[*_`~]+")
WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text, in lower case and without markup, escapes and broken lines."""
    if "\\" in text:
        text = ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[2] else m[3], text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text and ("-" in text or "\xad" in text):
        text = BROKEN.sub("", text)
    if "<" in text:
        text = TAGS.sub("", text)
    if ">" in text or "#" in text or "|" in text:
        text = LEADING.sub("", text)
    if "*" in text or "_" in text or "`" in text or "~" in text:
        text = SIGNS.sub("", text)
    return WORDS.findall(skeleton(text).lower())


def base_window(words: int) -> int:
    """Words of an item's smallest windows: a quarter of it, as one of two stretches that make a case holds, ``WINDOW`` at most; a short item whole."""
    return words if words < SHORT else max(2, min(WINDOW, words // 4))


def window_sizes(words: int) -> list[int]:
    """Sizes of an item's windows: its own and half of it, rounded down to powers of two, and the smallest."""
    whole = 1 << (words.bit_length() - 1)
    return sorted({base_window(words), *(size for size in (whole, whole // 2) if size > 2 * WINDOW)})


def least_stretch(words: int) -> int:
    return words if words < SHORT else max(2, min(MIN_STRETCH, words // 4))


class Hasher:
    """SimHashes of word windows; the vectors of words already seen are kept, up to ``CACHED_WORDS``."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 64), dtype=np.int16)

    def _vector(self, word: str) -> np.ndarray:
        padded = f" {word} "
        grams = [xxhash.xxh64_intdigest(padded[i : i + 3]) for i in range(max(1, len(padded) - 2))]
        bits = np.unpackbits(np.array(grams, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1)
        return (2 * bits.astype(np.int16) - 1).sum(axis=0, dtype=np.int32).clip(-127, 127).astype(np.int16)

    def _row(self, word: str) -> int:
        row = self.rows.get(word)
        if row is None:
            row = self.rows[word] = len(self.rows)
            if row == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[row] = self._vector(word)
        return row

    def windows(self, texts: list[list[str]], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(size, text, place, fingerprint)`` of all windows of each size within the texts, a chunk of words at a time."""
        if len(self.rows) > CACHED_WORDS:
            self.__init__()
        rows = np.array([row for of in texts for row in map(self._row, of)], dtype=np.int64)
        lengths = np.array([len(of) for of in texts], dtype=np.int64)
        owner, first = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
        sizes = sorted(size for size in set(sizes) if size <= lengths.max(initial=0))
        if not sizes:
            return
        for start in range(0, len(rows), CHUNK_WORDS):
            part = rows[start : start + CHUNK_WORDS + sizes[-1] - 1]
            for size, sums in _window_sums(self.table[part], sizes):
                count = min(CHUNK_WORDS, len(sums))
                whole = owner[start : start + count] == owner[start + size - 1 : start + size - 1 + count]
                at = start + np.flatnonzero(whole)
                prints = np.packbits(sums[:count] > 0, axis=1).view(np.uint64).ravel()
                yield size, owner[at], at - first[owner[at]], prints[whole]


def _window_sums(rows: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(size, sums)`` of every run of ``size`` rows: by doubling, a size that is no power of two from those that make it up."""
    doubles = {1: rows}
    for size in sizes:
        if size > len(rows):
            return
        width = 1
        while 2 * width <= size:
            if 2 * width not in doubles:
                half = doubles[width] if 2 * width <= MAX_SHORT else doubles[width].astype(np.int32)
                doubles[2 * width] = half[:-width] + half[width:]
            width *= 2
        sums, done = doubles[width], width
        while done < size:
            width = 1 << ((size - done).bit_length() - 1)
            more = doubles[width][done:]
            sums = sums[: len(more)] + more[: len(sums)]
            done += width
        yield size, sums[: len(rows) - size + 1]
        for width in [w for w in doubles if w > 1 and 4 * w <= size]:
            del doubles[width]


class Blocks:
    """Fingerprints of one size in four blocks of 16 bits each."""

    def __init__(self, owner: np.ndarray, place: np.ndarray, prints: np.ndarray) -> None:
        self.owner, self.place, self.prints = owner, place, prints
        self.order, self.starts = [], []
        for block in range(BLOCKS):
            values = (prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            order = np.argsort(values, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(values[order], np.arange(65_537)))

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in prints, item, item place)`` of all windows within ``RADIUS``."""
        at, found = [], []
        for block in range(BLOCKS):
            values = ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            first = self.starts[block][values]
            counts = self.starts[block][values + 1] - first
            asked = np.flatnonzero(counts)
            if not len(asked):
                continue
            counts = counts[asked]
            places = np.repeat(asked, counts)
            offsets = np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = self.order[block][np.repeat(first[asked], counts) + offsets]
            near = np.bitwise_count(self.prints[rows] ^ prints[places]) <= RADIUS
            at.append(places[near])
            found.append(rows[near])
        if not at:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        rows = np.concatenate(found)
        return np.concatenate(at), self.owner[rows], self.place[rows]


class Index:
    """The items' words, fingerprints by window size, and weighted shingles."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hasher = Hasher()
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        own = [set(window_sizes(len(ws))) if ws else set() for ws in self.words]
        made: dict[int, list[tuple]] = {}
        for size, owner, place, prints in hasher.windows(self.words, set().union(*own)):
            mine = np.array([size in sizes for sizes in own])[owner]
            made.setdefault(size, []).append((owner[mine], place[mine], prints[mine]))
        self.blocks = {size: Blocks(*(np.concatenate(c) for c in zip(*parts))) for size, parts in made.items()}
        seen: dict[str, set[int]] = {}
        for item, ws in enumerate(self.words):
            for w in ws:
                seen.setdefault(w, set()).add(item)
        weight = {w: log(1 + len(items) / len(s)) for w, s in seen.items()}
        self.shingles = [{pair: weight[pair[0]] + weight[pair[1]] for pair in shingles(ws)} for ws in self.words]
        self.totals = [sum(held.values()) for held in self.shingles]

    def similarity(self, item: int, there: set[tuple[str, str]]) -> float:
        """Weighted share of an item's shingles that a document holds; 1 for an item of one word, which has none."""
        held = self.shingles[item]
        return sum(held[pair] for pair in held.keys() & there) / self.totals[item] if held else 1.0


def shingles(of: list[str]) -> set[tuple[str, str]]:
    """Pairs of neighbouring words."""
    return set(zip(of, of[1:]))


def alike(a: str, b: str) -> bool:
    """Whether two words differ by a few characters at most."""
    return a == b or (abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7)


class Stretch(NamedTuple):
    held: int  # words of the item that it holds
    first: int  # its place in the item
    last: int
    start: int  # its place in the document
    end: int


def stretches(item: list[str], document: list[str]) -> list[Stretch]:
    """The stretches of an item that the document holds in order, of ``MIN_STRETCH`` words or more.

    A stretch goes on over up to ``MAX_GAP`` changed words; of these the ones that differ by single
    characters or by spacing count as held. In items of under four times as many words both numbers
    are a quarter of the item.
    """
    return _stretches(item, document, min(MAX_GAP, max(1, len(item) // 4)), least_stretch(len(item)))


def _stretches(item: list[str], document: list[str], most_gap: int, least: int) -> list[Stretch]:
    blocks = [b for b in SequenceMatcher(None, item, document, autojunk=False).get_matching_blocks() if b.size]
    out: list[Stretch] = []
    for block in blocks:
        last, end = block.a + block.size, block.b + block.size
        held = block.size
        if out:
            before = out[-1]
            gap_a, gap_b = item[before.last : block.a], document[before.end : block.b]
            if len(gap_a) <= most_gap and len(gap_b) <= most_gap:
                if len(gap_a) == len(gap_b):
                    held += sum(map(alike, gap_a, gap_b))
                elif gap_a and gap_b and alike("".join(gap_a), "".join(gap_b)):
                    held += len(gap_a)
                out[-1] = Stretch(before.held + held, before.first, last, before.start, end)
                continue
        out.append(Stretch(held, block.a, last, block.b, end))
    return [s for s in out if s.held >= least]


def most(found: list[Stretch], count: int = STRETCHES) -> int:
    """Words held by the ``count`` longest of some stretches."""
    return sum(sorted((s.held for s in found), reverse=True)[:count])


def coverage(item: list[str], document: list[str]) -> float:
    """Share of the item's words that the document holds in order, in at most ``STRETCHES`` stretches."""
    return most(stretches(item, document)) / len(item) if item else 0.0


def share(item: list[str], document: list[str], spans: list[list[int]]) -> float:
    """The largest coverage of an item by a document, its stretches at any distance from each other.

    The whole document is aligned, and each span by itself. Of two stretches that make half an item
    one holds a quarter: for each such stretch the other is looked for in all of the document before
    and behind it, whether it has a fingerprint or not.
    """
    best, firsts = 0, set()
    gap, least = min(MAX_GAP, max(1, len(item) // 4)), least_stretch(len(item))
    for a, b in [[0, len(document)], *(s for s in spans if s != [0, len(document)])]:
        found = stretches(item, document[a:b])
        best = max(best, most(found))
        firsts.update(s._replace(start=s.start + a, end=s.end + a) for s in found if s.held >= HALF / STRETCHES * len(item))
    for one in firsts:
        before = _stretches(item[: one.first], document[: one.start], gap, least) if one.first >= least else []
        behind = _stretches(item[one.last :], document[one.end :], gap, least) if len(item) - one.last >= least else []
        best = max(best, one.held + most(before + behind, STRETCHES - 1))
    return best / len(item)


def leaked(index: Index, hasher: Hasher, texts: list[str]) -> list[list[tuple[int, float]]]:
    """For each text ``(item, share)`` of the items that it holds by at least half, a short item whole."""
    read = [words(text) for text in texts]
    found: list[tuple[np.ndarray, ...]] = []
    for size, owner, place, prints in hasher.windows(read, index.blocks):
        at, item, item_place = index.blocks[size].hits(prints)
        if len(at):
            found.append((owner[at], item, place[at] - item_place))
    out: list[list[tuple[int, float]]] = [[] for _ in texts]
    if not found:
        return out
    doc, item, diagonal = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    last, there = -1, set()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(doc)]):
        one, ws = int(item[a]), read[doc[a]]
        if doc[a] != last:
            last, there = int(doc[a]), shingles(ws)
        if index.similarity(one, there) < MIN_SIMILARITY:
            continue
        mine = index.words[one]
        slack = len(mine) + MAX_GAP
        spans: list[list[int]] = []
        for start in np.unique(diagonal[a:b]).tolist():
            low, high = max(0, start - slack), min(len(ws), start + 2 * slack)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(high, spans[-1][1])
            else:
                spans.append([low, high])
        best = share(mine, ws, spans)
        if best >= (HALF if len(mine) >= SHORT else 1.0):
            out[last].append((one, best))
    return out


_INDEXES: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, str]]) -> Index:
    """The index of a block of items, made once per worker process; one block is held at a time."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items)
    return _INDEXES[name]


def item_blocks(queries: DataFrame) -> int:
    """Into how many blocks ``queries(item, text)`` are dealt, so that each keeps within its bounds."""
    blocks = 1
    while True:
        place = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
        sizes = queries.groupBy(place).agg(F.count_distinct("item").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
        if all(r["n"] == 1 or r["n"] <= ITEMS_PER_BLOCK and r["chars"] <= CHARS_PER_BLOCK for r in sizes):
            return blocks
        blocks *= 2


def found(documents: DataFrame, items: DataFrame, doc_key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """``(doc_key, item_key, share)``: documents that hold at least half of an item, once per pair.

    The items are the stated query set: they are read in blocks of at most ``ITEMS_PER_BLOCK`` rows
    and ``CHARS_PER_BLOCK`` characters, each held by every task of one pass over all documents and
    whole texts, so any number of items is searched. A stretch that holds no window of ``WINDOW``
    words within the radius, such as one changed at every fourth word, is not found. Items of fewer
    than ``SHORT`` words must be held whole. Null, blank and wordless texts hold nothing; rows without a key give no row;
    repeated rows come out once; other columns are not read.
    """
    spark = documents.sparkSession
    queries = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text")
    )
    read = documents.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull())
    rows = spread(read.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("text")))
    queries = cut(queries.distinct())
    blocks = item_blocks(queries)
    schema = f"`{doc_key}` long, `{item_key}` long, share double"
    results: DataFrame | None = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        name = uuid4().hex
        shared = spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in mine if words(r["text"])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index, hasher = _index(name, shared.value), Hasher()
            for batch in batches:
                held = leaked(index, hasher, batch.column(1).to_pylist())
                rows = [(doc, index.ids[item], part) for doc, parts in zip(batch.column(0).to_pylist(), held) for item, part in parts]
                columns = zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [doc_key, item_key, "share"])

        part = rows.mapInArrow(run, schema)
        results = part if results is None else results.union(part)
    assert results is not None
    return results.groupBy(doc_key, item_key).agg(F.max("share").alias("share"))
