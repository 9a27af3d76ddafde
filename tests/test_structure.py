import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from quire.graph import components, star_edges
from quire.operators import chunk, markdown, toc, tree, verify


def grouped(tokens, most, overlap):
    """Greedy grouping as one would write it by hand."""
    total = sum(tokens)
    if not tokens:
        return []
    if total <= most:
        return [(0, len(tokens))]
    target = ceil((total / ceil(total / most) + most) / 2)
    out, start, size = [], 0, 0
    for i, t in enumerate(tokens):
        if size and size + t > target:
            out.append((start, i))
            start = max(start, i - overlap)
            size = sum(tokens[start:i])
        size += t
    return [*out, (start, len(tokens))]


def test_groups_equal_the_plain_loop(spark):
    rng = random.Random(3)
    cases = [([rng.choice([0, 5, 50, 900]) for _ in range(rng.randint(1, 30))],) for _ in range(150)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, t array<int>")
    for most, overlap in ((1000, 1), (300, 0), (2000, 2)):
        got = df.select("i", chunk.group_ranges(F.col("t"), most, overlap).alias("g")).orderBy("i").collect()
        assert [[tuple(x) for x in r.g] for r in got] == [grouped(c[0], most, overlap) for c in cases]


def test_every_page_is_in_a_group(spark):
    pages = spark.createDataFrame([(1, n, f"p{n}", 3000) for n in range(1, 11)], "doc_id long, page_number int, text string, token_count int")
    rows = chunk.group_pages(pages, 5000, 1).orderBy("group_no").collect()
    assert {n for r in rows for n in range(r.first_page, r.last_page + 1)} == set(range(1, 11))
    assert rows[0].text.startswith("p1")


def stacked(sections):
    """Parents by a stack."""
    stack, out = [], {}
    for pos, level in sections:
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[pos] = stack[-1][0] if stack else None
        stack.append((pos, level))
    return out


def test_markdown_parents_equal_a_stack(spark):
    rng = random.Random(5)
    docs = [(d, [rng.randint(1, 6) for _ in range(rng.randint(1, 20))]) for d in range(60)]
    files = [(d, "\n".join("#" * n + f" h{i}" for i, n in enumerate(levels))) for d, levels in docs]
    found = markdown.parents(markdown.sections(spark.createDataFrame(files, "doc_id long, content string"))).collect()
    want = {(d, p): parent for d, levels in docs for p, parent in stacked(list(enumerate(levels, 1))).items()}
    assert {(r.doc_id, r.pos): r.parent_pos for r in found} == want


def test_markdown_fences_text_and_bare_files(spark):
    content = "lost\n# A\nfirst\n```\n# not one\n```\n  ## B  \n\nsecond\n"
    files = spark.createDataFrame([(1, "a", content), (2, "b", "no headers"), (3, "c", None), (4, "d", "")], "doc_id long, doc_name string, content string")
    rows = {(r.doc_id, r.pos): r for r in markdown.nodes(files).collect()}
    assert rows[1, 1].text == "first\n```\n# not one\n```" and rows[1, 1].start_index == 2
    assert rows[1, 2].title == "B" and rows[1, 2].parent_pos == 1 and rows[1, 2].text == "second"
    assert rows[2, 1].title == "b" and rows[2, 1].text == "no headers" and rows[2, 1].node_id == "0001"


def test_small_leaves_join_their_previous_sibling(spark):
    content = "# A\nlong " + "x" * 80 + "\n## B\ntiny\n## C\n\n## D\n" + "y" * 80 + "\n## E\nsmall"
    rows = markdown.thin(markdown.nodes(spark.createDataFrame([(1, "n", content)], "doc_id long, doc_name string, content string")), 10).orderBy("pos").collect()
    assert [r.title for r in rows] == ["A", "B", "D"]
    assert rows[1].text == "tiny" and rows[2].text.endswith("\n\nsmall") and rows[2].node_id == "0004"


ITEMS = "doc_id long, pos int, structure string, title string, physical_index int"


def test_parents_are_the_latest_earlier_definition(spark):
    rows = [(1, 1, "1", "a", 1), (1, 2, "1.1", "b", 1), (1, 3, "1", "again", 2), (1, 4, "1.2", "c", 2), (1, 5, "2.1", "orphan", 3), (1, 6, "2", "late", 3), (1, 7, "", "e", 4), (1, 8, "None", "n", 4), (1, 9, None, "z", 4), (2, 1, "1.1", "other", 1)]
    got = tree.parent_positions(spark.createDataFrame(rows, ITEMS)).collect()
    assert {(r.doc_id, r.pos): r.parent_pos for r in got} == {(1, 1): None, (1, 2): 1, (1, 3): None, (1, 4): 3, (1, 5): None, (1, 6): None, (1, 7): None, (1, 8): None, (1, 9): None, (2, 1): None}


def test_trees_are_numbered_depth_first_and_survive_json(spark):
    rows = [(1, p, s, t, i) for p, (s, t, i) in enumerate([("1", "a", 1), ("1.1", "b", 2), ("1.1.1", "c", 3), ("2", "d", 4), ("1.2", "late", 5)], 1)]
    items = spark.createDataFrame(rows, ITEMS).withColumn("appear_start", F.lit("yes"))
    built = tree.build(items, F.lit(9)).withColumn("summary", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))
    ids = {r.title: (r.node_id, r.depth, r.start_index, r.end_index) for r in built.collect()}
    assert ids == {"a": ("0001", 1, 1, 1), "b": ("0002", 2, 2, 2), "c": ("0003", 3, 3, 3), "late": ("0004", 2, 5, 9), "d": ("0005", 1, 4, 4)}
    nested = tree.to_json(built).collect()[0].structure
    assert '"nodes":[{"title":"b"' in nested and "summary" not in nested
    again = tree.from_json(spark.createDataFrame([(1, nested), (2, "[]"), (3, None)], "doc_id long, structure string")).collect()
    assert {r.title: (r.node_id, r.depth, r.start_index, r.end_index) for r in again} == ids
    assert [r.line for r in tree.outline(built).orderBy("line_no").collect()][1] == "  [0002] b (pp. 2-2)"


def test_trees_of_any_depth_keep_all_nodes(spark):
    rows = [(d, p, ".".join(["1"] * p), f"t{p}", p) for d in (1, 2) for p in range(1, 151)] + [(3, 1, "1", "only", 1)]
    built = tree.number(tree.paths(tree.parent_positions(spark.createDataFrame(rows, ITEMS)))).collect()
    assert len(built) == 301 and all(r.depth == r.pos and r.path == list(range(1, r.pos + 1)) and r.node_id == f"{r.pos:04d}" for r in built)
    assert tree.paths(tree.parent_positions(spark.createDataFrame([], ITEMS))).count() == 0


def test_boundaries_preface_and_ranges(spark):
    rows = [(1, 1, "1", "a", 1, "yes"), (1, 2, "2", "b", 5, "no"), (1, 3, "3", "c", 5, "yes"), (1, 4, "4", "d", None, "yes"), (2, 1, "1", "x", 5, "yes")]
    items = spark.createDataFrame(rows, ITEMS + ", appear_start string")
    got = {(r.doc_id, r.title): r.end_index for r in toc.boundaries(items, F.lit(10)).collect()}
    assert got == {(1, "a"): 5, (1, "b"): 5, (1, "c"): 10, (2, "x"): 10}
    assert {(r.doc_id, r.title) for r in toc.add_preface(items).collect()} >= {(2, "Preface")}
    assert toc.in_range(items, F.lit(4)).count() == 1


def test_batches_update_the_last_title_and_append_new_ones(spark):
    rows = [(1, 0, 1, "1", "A", None), (1, 0, 2, "2", "A", 2), (1, 1, 1, "x", "A", 7), (1, 1, 2, "3", "B", 3), (1, 1, 3, "3", "B", 4), (1, 1, 4, "9", "C", None), (1, 2, 1, "y", "B", 8)]
    got = toc.merge_batches(spark.createDataFrame(rows, "doc_id long, batch int, pos int, structure string, title string, physical_index int")).orderBy("pos").collect()
    assert [(r.title, r.physical_index) for r in got] == [("A", None), ("A", 7), ("B", 3), ("B", 8)]


def test_text_search_and_citations(spark):
    nodes = spark.createDataFrame([(1, 1, "0001", "A", 1, 2), (1, 2, "0002", "B", 9, 9), (1, 3, None, "C", 1, 1)], "doc_id long, pos int, node_id string, title string, start_index int, end_index int")
    pages = spark.createDataFrame([(1, 1, "one", 1), (1, 2, "two ", 1)], "doc_id long, page_number int, text string, token_count int")
    texts = tree.add_text(nodes, pages)
    assert {r.pos: r.text for r in texts.collect()} == {1: "one\n\ntwo", 2: None, 3: "one"}
    searches = spark.createDataFrame([(7, 1, ["9999", "0002", "0001", "0001"])], "query_id long, doc_id long, node_ids array<string>")
    found = tree.resolve(searches, texts)
    assert [r.title for r in found.orderBy("rank").collect()] == ["B", "A", "A"]
    row = tree.context_and_citations(found).collect()[0]
    assert row.context == "[A]\none\n\ntwo\n\n---\n\n[A]\none\n\ntwo" and row.citations[0].start_page == 1


def test_routes_at_the_gate(spark):
    scored = spark.createDataFrame([(1, 1.0), (2, 0.61), (3, 0.6), (4, 0.0)], "doc_id long, accuracy double")
    assert [r.route for r in verify.route(scored).orderBy("doc_id").collect()] == ["keep", "fix", "fallback", "fallback"]


def test_fixing_takes_the_nearest_page(spark):
    items = spark.createDataFrame([(1, 1, "Intro", 4, False), (1, 2, "None here", 4, False), (1, 3, "Ok", 2, True)], "doc_id long, pos int, title string, physical_index int, ok boolean")
    pages = spark.createDataFrame([(1, n, "the in tro" if n in (2, 5) else "other", 1) for n in range(1, 9)], "doc_id long, page_number int, text string, token_count int")
    assert {r.pos: (r.physical_index, r.ok) for r in verify.fixed(items, pages).collect()} == {1: (5, True), 2: (4, False), 3: (2, True)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 6000 + i) for i in range(200)] + [(1, None), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            parent[find(a)] = find(b)
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.vertex for r in got} == set(parent)
    assert len({(find(r.vertex), r.component) for r in got}) == len({find(x) for x in parent}) == len({r.component for r in got})


def test_components_of_nothing_and_of_hubs(spark):
    empty = spark.createDataFrame([], "u long, v long")
    assert components(empty).collect() == []
    members = spark.createDataFrame([("h", 3), ("h", 1), ("h", 2), (None, 4), ("g", None)], "hub string, member long")
    assert {(r.u, r.v) for r in star_edges(members, "hub", "member").collect()} == {(3, 1), (2, 1)}
