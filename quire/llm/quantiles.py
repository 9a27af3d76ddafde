"""Percentiles of very large numeric columns: relative-error quantile sketches.

A stack of relative compactors (Cormode, Karnin, Liberty, Thaler, Vesely 2021). Level h holds values
of weight 2^h. A full level sorts itself, keeps its upper part - how much of it follows the number
of compactions so far - and passes every other value of the lower part up. The rank error at
quantile q is therefore proportional to 1 - q: small where the tail is.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import cut

SECTION, SECTIONS, MIN_SECTION = 32, 3, 4
QUANTILES = (0.5, 0.9, 0.95, 0.99)


class Sketch:
    """A mergeable quantile sketch of finite numbers; exact until its first level is full."""

    def __init__(self, section: int = SECTION) -> None:
        self.section, self.n = section, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.shape: list[list[float]] = [[float(section), SECTIONS, 0]]  # section size, sections, compactions

    def capacity(self, level: int) -> int:
        size, sections, _ = self.shape[level]
        return 2 * int(sections) * self._even(size)

    @staticmethod
    def _even(size: float) -> int:
        return max(MIN_SECTION, 2 * round(size / 2))

    def add(self, values: np.ndarray) -> None:
        """Add values in steps of half a level, as if one by one."""
        self.n += len(values)
        at = 0
        while at < len(values):
            step = max(1, self.capacity(0) - len(self.levels[0]))
            self.levels[0] = np.concatenate((self.levels[0], values[at : at + step]))
            at += step
            self._compress()

    def merge(self, other: Sketch) -> None:
        """Add another sketch's values at their weights."""
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self._grow()
        for h, values in enumerate(other.levels):
            self.levels[h] = np.concatenate((self.levels[h], values))
            mine, theirs = self.shape[h], other.shape[h]
            if theirs[1] > mine[1]:
                mine[0], mine[1] = theirs[0], theirs[1]
            mine[2] = int(mine[2]) | int(theirs[2])
        self._compress()

    def _grow(self) -> None:
        self.levels.append(np.empty(0))
        self.shape.append([float(self.section), SECTIONS, 0])

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= self.capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        size, sections, state = self.shape[h]
        state = int(state)
        ones = (~state & (state + 1)).bit_length() - 1
        open_sections = min(ones + 1, int(sections))
        keep = int(sections) * self._even(size) + (int(sections) - open_sections) * self._even(size)
        values = np.sort(self.levels[h])
        low = len(values) - keep
        low -= low % 2
        if h + 1 == len(self.levels):
            self._grow()
        start = (state * 0x9E3779B97F4A7C15 + self.n * 0xBF58476D1CE4E5B9 >> 31) & 1
        self.levels[h + 1] = np.concatenate((self.levels[h + 1], values[start:low:2]))
        self.levels[h] = values[low:]
        state += 1
        if state >= 1 << (int(sections) - 1) and size / math.sqrt(2) >= MIN_SECTION:
            size, sections = size / math.sqrt(2), sections * 2
        self.shape[h] = [size, sections, state]

    def quantiles(self, points: Iterable[float]) -> list[float | None]:
        """For each q the smallest kept value whose rank reaches q n; null when empty."""
        if not self.n:
            return [None for _ in points]
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        return [float(values[min(int(np.searchsorted(ranks, max(1, math.ceil(q * self.n)))), len(values) - 1)]) for q in points]

    def bound(self, q: float) -> float:
        """Three standard deviations of the rank error at ``q`` as a share of n; 0 while exact."""
        return 0.0 if len(self.levels) == 1 else 3 * math.sqrt(0.0512 / SECTIONS) / self.section * (1 - q)

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqi", self.section, self.n, len(self.levels))
        rows = [struct.pack("<dqqi", s[0], int(s[1]), int(s[2]), len(v)) for s, v in zip(self.shape, self.levels)]
        return head + b"".join(rows) + np.concatenate(self.levels).astype("<f8").tobytes()

    @staticmethod
    def is_exact(data: bytes) -> bool:
        """Whether serialised values were never compacted, so that ``values_of`` are all of them."""
        return int.from_bytes(data[12:16], "little") == 1

    @staticmethod
    def values_of(data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<f8", offset=44)

    @staticmethod
    def exact_bytes(values: np.ndarray) -> bytes:
        """The serialised sketch of fewer values than a level holds, without making it."""
        return struct.pack("<iqidqqi", SECTION, len(values), 1, float(SECTION), SECTIONS, 0, len(values)) + values.astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        section, n, count = struct.unpack_from("<iqi", data)
        sketch, at, lengths = cls(section), 16, []
        sketch.n, sketch.levels, sketch.shape = n, [], []
        for _ in range(count):
            size, sections, state, length = struct.unpack_from("<dqqi", data, at)
            sketch.shape.append([size, sections, state])
            lengths.append(length)
            at += 28
        values = np.frombuffer(data, "<f8", offset=at)
        for length in lengths:
            sketch.levels.append(values[:length].copy())
            values = values[length:]
        return sketch


def usable(value: Column) -> Column:
    """Whether a time counts: present, a finite number and not negative."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))


def measured(df: DataFrame, source: str, key: str, value: str, at: str) -> DataFrame:
    """``(source, model, page_count, day, value)`` of the rows that count, each key once.

    Rows without a key count each for themselves; of rows that differ under one key the largest counts.
    """
    rows = df.select(
        F.col(key).alias("_key"), "model", F.col("page_count").cast("int").alias("page_count"),
        F.to_date(at).alias("day"), F.col(value).cast("double").alias("value"),
    ).where(usable(F.col("value")))
    named = ["model", "page_count", "day", "value"]
    keyed = rows.where("_key is not null").groupBy("_key").agg(F.max(F.struct(*named)).alias("r")).select(*(f"r.{c}" for c in named))
    once = keyed.union(rows.where("_key is null").select(*named))
    return once.select(F.lit(source).alias("source"), *named)


KEYS = ["source", "model", "page_count", "day"]


FULL = 2 * SECTIONS * SECTION


class Pool:
    """Values and sketches of one group: plain values while these are few, a sketch from then on."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.sketch: Sketch | None = None

    def add(self, values: np.ndarray) -> None:
        if self.sketch is not None:
            self.sketch.add(values)
            return
        self.parts.append(values)
        self.n += len(values)
        if self.n >= FULL:
            self.sketch = Sketch()
            self.sketch.add(np.concatenate(self.parts))
            self.parts = []

    def merge(self, data: bytes) -> None:
        if Sketch.is_exact(data):
            self.add(Sketch.values_of(data))
        elif self.sketch is None:
            self.sketch, parts = Sketch.from_bytes(data), self.parts
            self.parts = []
            for values in parts:
                self.sketch.add(values)
        else:
            self.sketch.merge(Sketch.from_bytes(data))

    def close(self) -> tuple[int, bytes]:
        if self.sketch is not None:
            return self.sketch.n, self.sketch.to_bytes()
        return self.n, Sketch.exact_bytes(np.concatenate(self.parts))


KINDS = {"source": "string", "model": "string", "page_count": "int", "day": "date", "level": "string"}


def _sketched(ordered: DataFrame, by: list[str], values: str) -> DataFrame:
    """``(by, n, sketch)``, one row per run of equal ``by`` in each task's sorted rows of numbers or sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        pool = Pool()
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            columns = [batch.column(i) for i in range(len(by))]
            fresh = np.zeros(size, dtype=bool)
            fresh[0] = True
            for column in columns:
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                fresh[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(fresh)
            ends = [*starts[1:].tolist(), size]
            keys = list(zip(*(column.take(pa.array(starts)).to_pylist() for column in columns)))
            data = batch.column(len(by)).to_numpy(zero_copy_only=False)
            done: list[tuple] = []
            for now, a, b in zip(keys, starts.tolist(), ends):
                if now != key:
                    if key is not None:
                        done.append((*key, *pool.close()))
                    key, pool = now, Pool()
                if values == "value":
                    pool.add(data[a:b])
                else:
                    for one in data[a:b]:
                        pool.merge(one)
            yield out(done)
        if key is not None:
            yield out([(*key, *pool.close())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * (len(by) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*by, "n", "sketch"])

    types = [{"string": pa.string(), "int": pa.int32(), "date": pa.date32()}[KINDS[c]] for c in by] + [pa.int64(), pa.binary()]
    schema = ", ".join(f"{c} {KINDS[c]}" for c in by) + ", n long, sketch binary"
    return ordered.select(*by, values).mapInArrow(run, schema)


def daily_sketches(values: DataFrame) -> DataFrame:
    """One sketch per ``source, model, page_count, day``; nulls in these are groups like others.

    Every task sorts and sketches the rows it holds, so a group that holds a third of all rows leaves
    each task as a few kilobytes; the partial sketches are then merged.
    """
    return merged(_sketched(values.sortWithinPartitions(*KEYS), KEYS, "value"), KEYS)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged by the columns ``by``, the other keys null.

    Rows of one group lie side by side after the sort and are merged one after the other; a task
    holds one sketch at a time, however many a group has.
    """
    return _sketched(sketches.select(*by, "sketch").repartition(*by).sortWithinPartitions(*by), by, "sketch")


def percentiles(daily: DataFrame, points: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``(source, level, model, page_count, n, p, value, rank_error)`` over all days.

    For each source and for both together (``all``), per model (``level`` model) and per model and
    page count (``level`` model_pages). ``rank_error`` is three standard deviations of the error of
    the value's rank, as a share of ``n``; 0 where the sketch is exact. Raw values are sketched once:
    the daily sketches and those per page count are written before they are used twice.
    """
    sources = F.explode(F.array(F.col("source"), F.lit("all"))).alias("source")
    per_pages = cut(daily).select(sources, F.lit("model_pages").alias("level"), "model", "page_count", "sketch")
    by = ["source", "level", "model", "page_count"]
    pages = cut(merged(per_pages, by))
    per_model = pages.select("source", F.lit("model").alias("level"), "model", F.lit(None).cast("int").alias("page_count"), "sketch")
    every = pages.select(*by, "n", "sketch").union(merged(per_model, by).select(*by, "n", "sketch"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            pages_of = batch["page_count"].astype(object).where(batch["page_count"].notna(), None)
            for source, level, model, count, n, data in zip(batch.source, batch.level, batch.model, pages_of, batch.n, batch.sketch):
                sketch = Sketch.from_bytes(data)
                for p, value in zip(points, sketch.quantiles(points)):
                    rows.append((source, level, model, count, n, p, value, sketch.bound(p)))
            yield pd.DataFrame(rows, columns=["source", "level", "model", "page_count", "n", "p", "value", "rank_error"])

    return every.mapInPandas(run, "source string, level string, model string, page_count int, n long, p double, value double, rank_error double")
