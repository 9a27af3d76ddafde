import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quantiles, splits
from quire.llm.queries import ORACLE, QUERIES
from tests.compare import rows_of, rows_of_sql

TRAINING = "pair_id long, arxiv_id string, group_key string, split string"
AUTHORS = "arxiv_id string, author_id long, unit string"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, data):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(ORACLE[name], data)


def test_paper_numbers_in_any_writing(spark):
    written = ["arXiv: 2401.00017v2", "ARXIV:2401.00017V1", "pdf/2401.00017", " 2401.00017v1 ", "2401.00017v1\n", "2401.00017v3.pdf", "arXiv:2401.00017v1 [cs.IR]", "draft.pdf", "", None, "n/a", "arXiv:"]
    df = spark.createDataFrame([(w,) for w in written], "a string")
    got = [r.p for r in df.select(splits.paper_number(F.col("a")).alias("p")).collect()]
    assert got == ["2401.00017"] * 7 + [None] * 5


def test_groups_are_linked_through_papers_and_authors(spark):
    rows = [(1, "2401.00001v1", "x", "y"), (2, "arXiv:2401.00001", "x", "y"), (3, "2401.00002", "x", "y"), (4, "2401.00003", "x", "y"), (5, "2401.00009", "x", "y"), (6, None, "x", "y"), (7, "n/a", "x", "y"), (1, "2401.00001v1", "x", "y"), (None, "2401.00009", "x", "y")]
    authors = [("2401.00001", 7, "u"), ("2401.00002", 7, "u"), ("2401.00002", 8, "u"), ("2401.00003", 8, "u"), ("2401.00003", None, "u"), ("2401.00009", None, "u"), ("2401.00001", 7, "u")]
    grouped = splits.groups(spark.createDataFrame(rows, TRAINING), spark.createDataFrame(authors, AUTHORS))
    found = {(r.pair_id, r.group_key) for r in splits.shared_groups(grouped).collect()}
    assert found == {(n, "2401.00001") for n in (1, 2, 3, 4)}
    assigned = splits.assign(grouped).collect()
    assert len(assigned) == 8 and len({r.split for r in assigned if r.group_key == "2401.00001"}) == 1
    assert all(r.split in ("train", "validation", "test") for r in assigned)


def test_splits_of_nothing(spark):
    grouped = splits.groups(spark.createDataFrame([], TRAINING), spark.createDataFrame([], AUTHORS))
    assert splits.shared_groups(grouped).count() == 0 and splits.assign(grouped).count() == 0


def test_a_third_in_one_group_keeps_the_proportions(spark):
    rows = [(i, "2401.00001" if i % 3 == 0 else f"2402.{i:05d}", "", "") for i in range(3000)]
    grouped = splits.groups(spark.createDataFrame(rows, TRAINING), spark.createDataFrame([], AUTHORS))
    counts = {r.split: r["count"] for r in splits.assign(grouped).groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and abs(counts["train"] - 2400) < 30 and abs(counts["test"] - 300) < 30


def test_differencing_places_everything_once():
    rng = random.Random(2)
    classes = [(w, rng.randint(1, 400)) for w in rng.sample(range(1, 60), 20)]
    loads, plan = splits.differencing(classes, 50)
    assert loads.sum() == sum(w * n for w, n in classes)
    assert all(each * 50 + len(rest) == n for (w, n), (each, rest) in ((c, plan[c[0]]) for c in classes))
    assert loads.max() - loads.min() <= 60
    assert splits.differencing([], 5)[0].sum() == 0


def test_classes_of_equal_weights_balance_like_single_weights():
    import heapq

    def singly(weights, bins):
        heap = [(-float(w), n, np.array([w] + [0] * (bins - 1), dtype=float)) for n, w in enumerate(sorted(weights, reverse=True))]
        heapq.heapify(heap)
        while len(heap) > 1:
            (_, n, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            merged = np.sort(a)[::-1] + np.sort(b)
            heapq.heappush(heap, (-float(merged.max() - merged.min()), n, merged))
        return np.sort(heap[0][2])

    rng = random.Random(4)
    for bins in (3, 7):
        classes = [(w, rng.randint(1, bins - 1)) for w in rng.sample(range(1, 500), 9)]
        loads, plan = splits.differencing(classes, bins)
        single = singly([w for w, n in classes for _ in range(n)], bins)
        assert loads.max() - loads.min() <= 3 * (single[-1] - single[0]) + 1
        assert loads.sum() == single.sum()
        placed = np.zeros(bins)
        for w, (each, rest) in plan.items():
            placed += each * w
            for place in rest:
                placed[place] += w
        assert np.array_equal(placed, loads)


def test_a_pair_with_two_papers_links_them(spark):
    rows = [(1, "2401.00001", "", ""), (1, "2401.00005", "", ""), (2, "2401.00005", "", ""), (3, "2401.00001v2", "", ""), (3, "n/a", "", ""), (4, "2401.00009", "", "")]
    grouped = splits.groups(spark.createDataFrame(rows, TRAINING), spark.createDataFrame([], AUTHORS))
    assert {(r.pair_id, r.group_key) for r in splits.shared_groups(grouped).collect()} == {(n, "2401.00001") for n in (1, 2, 3)}
    assert len(splits.assign(grouped).collect()) == 4


def test_many_sizes_stay_small():
    import tracemalloc

    tracemalloc.start()
    loads, _ = splits.differencing([(w, 199) for w in range(1, 1001)], 200)
    assert tracemalloc.get_traced_memory()[1] < 20e6 and loads.max() - loads.min() <= 1000
    tracemalloc.stop()


@pytest.mark.parametrize("kind", ["ties", "lognormal", "sorted", "falling"])
def test_sketch_ranks_are_within_the_bound(kind):
    rng = np.random.default_rng(1)
    values = {"ties": rng.integers(0, 50, 60_000).astype(float), "lognormal": rng.lognormal(size=60_000), "sorted": np.arange(60_000.0), "falling": np.arange(60_000.0)[::-1]}[kind]
    whole = quantiles.Sketch()
    parts = [quantiles.Sketch() for _ in range(40)]
    for i, part in enumerate(parts):
        part.add(values[i::40])
        whole.merge(quantiles.Sketch.from_bytes(part.to_bytes()))
    ordered = np.sort(values)
    for q, value in zip(quantiles.QUANTILES, whole.quantiles(quantiles.QUANTILES)):
        low, high = np.searchsorted(ordered, value, "left") / len(values), np.searchsorted(ordered, value, "right") / len(values)
        assert low - whole.bound(q) - 1e-4 <= q <= high + whole.bound(q) + 1e-4
    assert whole.n == len(values) == sum(len(v) << h for h, v in enumerate(whole.levels))


def test_small_sketches_are_exact_and_empty_ones_null():
    sketch = quantiles.Sketch()
    assert sketch.quantiles([0.5]) == [None]
    sketch.add(np.array([3.0, 1.0, 2.0, 2.0]))
    assert sketch.quantiles([0.5, 0.99]) == [2.0, 3.0] and sketch.bound(0.5) == 0.0
    assert quantiles.Sketch.from_bytes(sketch.to_bytes()).quantiles([0.01]) == [1.0]


def test_percentiles_count_usable_values_once(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "m", 3, 1.0, "2026-01-01"), (1, "m", 3, 1.0, "2026-01-01"), (2, "m", 3, 5.0, "2026-01-02"), (3, "m", None, nan, "2026-01-01"), (4, "m", 3, inf, "2026-01-01"), (5, "m", 3, -1.0, "2026-01-01"), (6, "m", 3, None, None), (7, None, None, 2.0, None), (8, "m", 4, 9.0, "2026-01-03")]
    df = spark.createDataFrame(rows, "id long, model string, page_count int, t double, at string")
    daily = quantiles.daily_sketches(quantiles.measured(df, "s", "id", "t", "at"))
    assert daily.agg(F.sum("n")).first()[0] == 4
    got = {(r.source, r.level, r.model, r.page_count, r.p): (r.value, r.n) for r in quantiles.percentiles(daily).collect()}
    assert got["s", "model", "m", None, 0.5] == (5.0, 3) and got["all", "model_pages", "m", 3, 0.9] == (5.0, 2)
    assert got["s", "model_pages", None, None, 0.5] == (2.0, 1)
    assert quantiles.percentiles(quantiles.daily_sketches(quantiles.measured(df.limit(0), "s", "id", "t", "at"))).count() == 0


def test_percentiles_of_the_tables_are_within_the_stated_error(spark, data):
    from quire.runtime import table

    rows = QUERIES["p4_quantiles"](spark, data).where("source = 'batch_runs' and level = 'model'").collect()
    runs = table(spark, data, "batch_runs").dropDuplicates(["run_id"]).where(quantiles.usable(F.col("generation_time_seconds"))).select("model", "generation_time_seconds").collect()
    by_model = {}
    for r in runs:
        by_model.setdefault(r.model, []).append(r.generation_time_seconds)
    assert {r.model: r.n for r in rows} == {m: len(v) for m, v in by_model.items()}
    for r in rows:
        ordered = np.sort(by_model[r.model])
        low, high = np.searchsorted(ordered, r.value, "left") / r.n, np.searchsorted(ordered, r.value, "right") / r.n
        assert low - r.rank_error - 1 / r.n <= r.p <= high + r.rank_error + 1 / r.n
