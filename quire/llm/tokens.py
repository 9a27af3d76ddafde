"""Byte-pair encoding of a whole corpus with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that is in the vocabulary waits in the
bucket of its merge rank; a three-level bitmap over the ranks yields the lowest non-empty bucket by
find-first-set, so a pre-token of n bytes takes O(n log n) whatever its length. Entries whose pair
was merged away are skipped when they come up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-tokenisation pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_PRETOKENS = 200_000
CACHED_BYTES = 64


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank, leftmost position first."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        high = (top & -top).bit_length() - 1
        middle = self.mid[high]
        word = high << 6 | (middle & -middle).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[high] &= ~(1 << (word & 63))
                if not self.mid[high]:
                    self.top &= ~(1 << high)
        return rank, position


class Encoder:
    """A byte-level vocabulary ``{bytes: rank}``; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache: dict[str, list[int]] = {}

    def rank_of(self, left: int, right: int) -> int:
        """The rank of two tokens side by side, or -1."""
        pair = (left, right)
        rank = self.pairs.get(pair)
        if rank is None:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.pairs) < 1_000_000:
                self.pairs[pair] = rank
        return rank

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        ids = [self.single[b] for b in data]
        n = len(ids)
        queue, rank_of = RankQueue(self.size), self.rank_of
        for i in range(n - 1):
            if (rank := rank_of(ids[i], ids[i + 1])) >= 0:
                queue.push(rank, i)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (entry := queue.pop()) is not None:
            rank, at = entry
            left = ids[at]
            if left < 0 or (right_at := following[at]) >= n or rank_of(left, ids[right_at]) != rank:
                continue
            ids[at], ids[right_at] = rank, -1
            after = following[at] = following[right_at]
            if after < n:
                before[after] = at
                if (new := rank_of(rank, ids[after])) >= 0:
                    queue.push(new, at)
            if (previous := before[at]) >= 0 and (new := rank_of(ids[previous], rank)) >= 0:
                queue.push(new, previous)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special tokens' strings are ordinary text."""
        out: list[int] = []
        cache = self.cache
        for token in self.find(text):
            ids = cache.get(token)
            if ids is None:
                data = token.encode("utf-8", "replace")
                ids = self.merge(data)
                if len(data) <= CACHED_BYTES and len(cache) < CACHED_PRETOKENS:
                    cache[token] = ids
            out += ids
        return out


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """The encoder of a ``.tiktoken`` file, once per process."""
    if path not in _LOADED:
        lines = Path(path).read_bytes().splitlines()
        _LOADED[path] = Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)})
    return _LOADED[path]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``(key, ids)``, one row per key: the token ids of ``text``.

    Null and empty texts both give an empty list; texts of any length are encoded whole. A key
    delivered several times comes out once, of different texts the largest; rows without a key give no row. Columns other than the
    two named are not read. ``vocabulary`` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        for batch in batches:
            ids = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
