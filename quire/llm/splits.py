"""Splits that keep related records together.

Records that share a paper, or whose papers are linked through an author, form one group; groups
are balanced over many equal bins by largest differencing and whole bins go to the splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.graph import components, star_edges
from quire.runtime import cut

PAPER = r"(?<![0-9])([0-9]{4}\.[0-9]{4,5})(?![0-9])"
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
BINS = 200
UNITS_PER_BUCKET = 50_000


def paper_number(arxiv_id: Column) -> Column:
    """``YYMM.NNNNN`` within any way of writing a paper id; null where there is none."""
    return F.nullif(F.regexp_extract(arxiv_id, PAPER, 1), F.lit(""))


def groups(training: DataFrame, authors: DataFrame) -> DataFrame:
    """``(pair_id, paper, group_key)``, one row per ``pair_id``, and per paper where that is null.

    ``group_key`` is the smallest paper number of the papers linked, directly or through others, by
    an ``author_id`` or by a ``pair_id`` that was delivered with several papers, of which ``paper`` is
    the largest; both are null where no ``arxiv_id`` of the pair names a paper. Null authors and
    unusable papers link nothing. Further columns of the inputs are not read; empty inputs give no
    rows, or groups of one paper each.
    """
    named = training.select("pair_id", paper_number(F.col("arxiv_id")).alias("paper")).distinct()
    written = authors.select(F.col("author_id").alias("author"), paper_number(F.col("arxiv_id")).alias("paper"))
    alone = F.when(F.col("pair_id").isNull(), F.col("paper"))
    rows = named.groupBy("pair_id", alone.alias("alone")).agg(F.max("paper").alias("paper"), F.min("paper").alias("least"))
    several = rows.where("pair_id is not null and paper <> least").select("pair_id")
    twice = star_edges(named.join(several, "pair_id", "left_semi"), "pair_id", "paper")
    labels = cut(components(star_edges(written, "author", "paper").union(twice)))
    smallest = labels.groupBy("component").agg(F.min("vertex").alias("group_key"))
    keys = labels.join(smallest, "component").select(F.col("vertex").alias("paper"), "group_key")
    return rows.join(keys, "paper", "left").select("pair_id", "paper", F.coalesce("group_key", "paper").alias("group_key"))


def shared_groups(grouped: DataFrame) -> DataFrame:
    """``(pair_id, group_key)`` of the groups that hold at least two different ``pair_id``."""
    rows = grouped.where("group_key is not null and pair_id is not null").select("pair_id", "group_key").distinct()
    sizes = rows.groupBy("group_key").agg(F.min("pair_id").alias("lo"), F.max("pair_id").alias("hi"))
    return rows.join(sizes.where("lo <> hi").select("group_key"), "group_key", "left_semi").select("pair_id", "group_key")


def differencing(classes: Sequence[tuple[int, int]], bins: int) -> tuple[np.ndarray, dict[int, tuple[int, list[int]]]]:
    """Largest differencing of ``(weight, copies)`` into ``bins`` bins.

    Returns the bins' loads and, for each weight, how many copies every bin gets and the bins of
    the remaining copies. ``bins`` equal weights make a vector without any difference, so only the
    remainder of each class enters the heap, as one vector: its equal weights are combined with each
    other first, each in a bin of its own. The two vectors with the largest
    differences are combined, largest loads onto smallest, until one is left. A distinct weight costs
    one vector of ``bins`` numbers and two orders of as many small integers.
    """
    loads = np.zeros(bins)
    plan: dict[int, tuple[int, list[int]]] = {}
    heap: list[tuple[float, int, np.ndarray]] = []
    leaves: list[tuple[int, int]] = []
    for weight, copies in sorted(classes, reverse=True):
        each, rest = divmod(copies, bins)
        plan[weight] = (each, [])
        loads += each * weight
        if rest:
            vector = np.zeros(bins)
            vector[:rest] = weight
            heap.append((-float(weight), len(leaves), vector))
            leaves.append((weight, rest))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        merged = a[down] + b[up]
        heapq.heappush(heap, (-float(merged.max() - merged.min()), len(leaves) + len(merges), merged))
        merges.append((left, right, down.astype(np.int32), up.astype(np.int32)))
    if heap:
        loads += heap[0][2]
        waiting = [(heap[0][1], np.arange(bins))]
        while waiting:
            node, places = waiting.pop()
            if node < len(leaves):
                weight, rest = leaves[node]
                plan[weight][1].extend(places[:rest].tolist())
                continue
            left, right, down, up = merges[node - len(leaves)]
            for child, order in ((left, down), (right, up)):
                own = np.empty(bins, dtype=np.int64)
                own[order] = places
                waiting.append((child, own))
    return loads, plan


def allocate(loads: np.ndarray, splits: Sequence[tuple[str, float]]) -> list[str]:
    """The split of every bin: heaviest first, each to the split that lacks most of its target."""
    total = float(loads.sum())
    lack = {name: share * total for name, share in splits}
    share = dict(splits)
    chosen = [""] * len(loads)
    for place in np.argsort(-loads, kind="stable"):
        name = max(lack, key=lambda n: (lack[n], share[n]))
        chosen[place] = name
        lack[name] -= float(loads[place])
    return chosen


def assign(grouped: DataFrame, splits: Sequence[tuple[str, float]] = SPLITS, bins: int = BINS) -> DataFrame:
    """``(pair_id, group_key, split)`` for every row of ``grouped(pair_id, paper, group_key)``.

    A row that names no paper is a group of its own (rows without a ``pair_id`` form one more).
    The driver sees one row per distinct group size, of which there are at most the square root of
    twice the rows, and holds about 3 KB for each (45,000 sizes and 140 MB at 10^9 rows); groups are numbered within their size by counted buckets, so no size, however
    common, is ordered in one task.
    """
    unit = F.coalesce(F.concat(F.lit("p:"), "group_key"), F.concat(F.lit("r:"), F.col("pair_id").cast("string")), F.lit("r:"))
    rows = grouped.select("pair_id", "group_key", unit.alias("unit"))
    units = cut(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("weight")))
    classes = [(r["weight"], r["n"]) for r in units.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    loads, plan = differencing(classes, bins)
    names = allocate(loads, splits) if len(loads) else []
    buckets = max(1, -(-sum(n for _, n in classes) // UNITS_PER_BUCKET))
    placed = units.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    counts = placed.groupBy("weight", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("weight").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("weight", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("weight", "bucket").orderBy("unit")
    numbered = placed.withColumn("rn", F.row_number().over(inside) - 1).join(offsets, ["weight", "bucket"])
    spark = grouped.sparkSession
    table = spark.createDataFrame([(w, e, r) for w, (e, r) in plan.items()], "weight long, each long, rest array<int>")
    slot = F.col("offset") + F.col("rn")
    even = F.col("each") * bins
    place = F.when(slot < even, F.pmod(slot, F.lit(bins))).otherwise(F.get("rest", (slot - even).cast("int")))
    split = F.element_at(F.array(*map(F.lit, names)), (place + 1).cast("int"))
    chosen = numbered.join(table, "weight").select("unit", split.alias("split"))
    return rows.join(chosen, "unit").select("pair_id", "group_key", "split")
