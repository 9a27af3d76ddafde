"""All core queries over the project's tables, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import json_text, text
from quire.operators import chunk, markdown, search, toc, tree, verify
from quire.completion import prompts
from quire.completion.base import req_id
from quire.completion.offline import ReplayCompleter
from quire.config import Settings
from quire.plans import training
from quire.plans.build import FAILED, TreeBuilder, prompt_column
from quire.sources import pages as page_source
from quire.sources import records
from quire.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# White space as the engine strips it, for the SQL side.
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\p{Z}]"
STRIP = lambda c: rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
SQUEEZE = lambda c: rf"regexp_replace(lower({c}), '{WS}+', '', 'g')"
TOKENS = lambda c: f"CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, length({c}) // 4) END"


def _pages_sql(name: str, relation: str, key: str, column: str) -> str:
    return f"""{name} AS (
        SELECT doc_id, CAST(i + 1 AS INT) AS page_number, array_to_string(list_slice(lines, i * 4 + 1, i * 4 + 4), chr(10)) AS text
        FROM (SELECT {key} AS doc_id, string_split({column}, chr(10)) AS lines FROM {relation} WHERE {column} IS NOT NULL) d,
             unnest(range(CAST(ceil(len(lines) / 4.0) AS BIGINT))) AS u(i))"""


DOC_PAGES = _pages_sql("doc_pages", "documents", "doc_id", "text")
PAIR_PAGES = _pages_sql("pair_pages", "(SELECT DISTINCT pair_id, document_text FROM training)", "pair_id", "document_text")
ITEMS = """items AS (
        SELECT pair_id AS doc_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY pos, node_key) AS INT) AS pos,
               structure, title, start_index AS physical_index, end_index, summary
        FROM (SELECT DISTINCT node_key, pair_id, pos, structure, title, start_index, end_index, summary FROM training_nodes)),
    totals AS (SELECT pair_id AS doc_id, max(page_count) AS total FROM training GROUP BY 1),
    valid AS (SELECT i.*, total, CASE WHEN i.pos % 3 = 0 THEN 'no' ELSE 'yes' END AS appear_start
              FROM items i JOIN totals USING (doc_id) WHERE physical_index BETWEEN 1 AND total)"""
RANGES = """ranges AS (
        SELECT doc_id, pos, structure, title, summary, physical_index AS start_index,
               greatest(physical_index, CASE WHEN nxt IS NULL THEN total WHEN nxt_start = 'yes' THEN nxt - 1 ELSE nxt END) AS end_index
        FROM (SELECT *, lead(physical_index) OVER w AS nxt, lead(appear_start) OVER w AS nxt_start
              FROM valid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)))"""
PARENTS = r"""keyed AS (
        SELECT *, CASE WHEN structure LIKE '%.%' THEN nullif(regexp_extract(structure, '(?s)^(.*)\.[^.]*$', 1), '') END AS parent_key FROM ranges),
    tree AS (
        SELECT c.doc_id, c.pos, any_value(c.title) AS title, any_value(c.summary) AS summary, any_value(c.start_index) AS start_index,
               any_value(c.end_index) AS end_index, max(p.pos) AS parent_pos
        FROM keyed c LEFT JOIN keyed p ON p.doc_id = c.doc_id AND p.structure = c.parent_key AND p.pos < c.pos GROUP BY 1, 2)"""
PATHS = """paths AS (
        SELECT doc_id, pos, parent_pos, title, summary, start_index, end_index, [pos] AS path FROM tree WHERE parent_pos IS NULL
        UNION ALL
        SELECT t.doc_id, t.pos, t.parent_pos, t.title, t.summary, t.start_index, t.end_index, list_append(p.path, t.pos)
        FROM tree t JOIN paths p ON p.doc_id = t.doc_id AND p.pos = t.parent_pos),
    numbered AS (SELECT *, CAST(len(path) AS INT) AS depth,
                        printf('%04d', row_number() OVER (PARTITION BY doc_id ORDER BY path)) AS node_id FROM paths)"""
TREE = f"WITH RECURSIVE {ITEMS}, {RANGES}, {PARENTS}, {PATHS}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Relations the queries start from.


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    return page_source.from_lines(documents(spark, d))


def pair_pages(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "training").groupBy("pair_id").agg(F.max("document_text").alias("document_text"))
    return page_source.from_lines(once, "pair_id", "document_text")


def items(spark: SparkSession, d: str) -> DataFrame:
    """The section lists of the training trees, each section once."""
    order = Window.partitionBy("pair_id").orderBy("pos", "node_key")
    once = table(spark, d, "training_nodes").drop("ingested_at").dropDuplicates(["node_key"])
    return once.select(
        F.col("pair_id").alias("doc_id"), F.row_number().over(order).alias("pos"), "structure", "title",
        F.col("start_index").alias("physical_index"), "end_index", "summary",
    )


def valid_items(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "training").groupBy(F.col("pair_id").alias("doc_id")).agg(F.max("page_count").alias("total"))
    rows = toc.in_range(items(spark, d).drop("end_index").join(totals, "doc_id"), F.col("total"))
    return rows.withColumn("appear_start", F.when(F.col("pos") % 3 == 0, "no").otherwise("yes"))


def trees(spark: SparkSession, d: str) -> DataFrame:
    built = tree.build(valid_items(spark, d), F.col("total"))
    return built.select("doc_id", "pos", "parent_pos", "path", "depth", "node_id", "title", "summary", "start_index", "end_index")


HEADED = r"^[0-9]+([.][0-9]+)*$"
UNFIT = r"[ .]{2}|[.]$|[\n\r]"
BODY = "This page belongs to paper "


def paper_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections of the training trees that can stand as a numbered heading, with their page in ``paper_pages``."""
    title = text.strip(F.col("title"))
    rows = valid_items(spark, d).withColumn("title", title)
    fit = F.col("structure").rlike(HEADED) & ~F.col("title").rlike(UNFIT) & F.length("title").between(1, 80)
    return rows.where(fit).select("doc_id", "pos", "structure", "title", (F.col("physical_index") + F.sign(F.col("doc_id") % 3).cast("int")).alias("page_number"))


def paper_pages(spark: SparkSession, d: str) -> DataFrame:
    """Papers as pages with their headings, in three kinds by number.

    Every third has numbered headings and no table of contents; the next begins with a table of
    contents of its unnumbered headings; the next with one whose entries stand nowhere else.
    """
    kind = F.col("doc_id") % 3
    sections = paper_sections(spark, d)
    heading = F.when(kind == 1, F.col("title")).otherwise(F.concat_ws(" ", "structure", "title"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "pos", c.alias("line")))), lambda x: x["line"]), "\n")
    lines = sections.groupBy("doc_id", "page_number").agg(listed(heading).alias("lines"))
    entry = F.concat_ws(" ", "structure", "title", F.lit("...."), F.col("page_number").cast("string"))
    tables = sections.where(kind == 1).groupBy("doc_id").agg(listed(entry).alias("entries"))
    totals = table(spark, d, "training").groupBy(F.col("pair_id").alias("doc_id")).agg(F.max("page_count").alias("total")).where("doc_id is not null and total >= 1")
    last = F.col("total") + F.sign(kind).cast("int")
    pages = totals.select("doc_id", F.explode(F.sequence(F.lit(1), last)).alias("page_number"))
    body = F.concat(F.lit(BODY), F.col("doc_id").cast("string"), F.lit("."))
    front = F.when(kind == 1, F.coalesce("entries", F.lit(""))).otherwise("Chapter 1 .... 2\nChapter 2 .... 3\nChapter 3 .... 4")
    first = (F.col("page_number") == 1) & (kind > 0)
    page = F.when(first, F.concat(F.lit("Contents\n"), front)).otherwise(F.concat_ws("\n", "lines", body))
    joined = pages.join(lines, ["doc_id", "page_number"], "left").join(tables, "doc_id", "left")
    return joined.select("doc_id", "page_number", page.alias("text")).withColumn("token_count", text.count_tokens(F.col("text")))


PAPERS = rf"""sect AS (
        SELECT doc_id, pos, structure, title, physical_index + CAST(doc_id % 3 > 0 AS INT) AS page_number
        FROM (SELECT doc_id, pos, structure, {STRIP('title')} AS title, physical_index FROM valid)
        WHERE regexp_matches(structure, '{HEADED}') AND NOT regexp_matches(title, '{UNFIT}') AND length(title) BETWEEN 1 AND 80),
    kinds AS (SELECT pair_id AS doc_id, CAST(max(page_count) + CAST(pair_id % 3 > 0 AS INT) AS INT) AS last FROM training
              WHERE pair_id IS NOT NULL GROUP BY pair_id HAVING max(page_count) >= 1),
    papers AS (
        SELECT k.doc_id, CAST(n AS INT) AS page_number, CASE WHEN n = 1 AND k.doc_id % 3 > 0 THEN 'Contents' || chr(10) || CASE WHEN k.doc_id % 3 = 1
                   THEN coalesce((SELECT string_agg(structure || ' ' || title || ' .... ' || page_number, chr(10) ORDER BY page_number, pos) FROM sect s WHERE s.doc_id = k.doc_id), '')
                   ELSE 'Chapter 1 .... 2' || chr(10) || 'Chapter 2 .... 3' || chr(10) || 'Chapter 3 .... 4' END
               ELSE coalesce((SELECT string_agg(CASE WHEN s.doc_id % 3 = 1 THEN title ELSE structure || ' ' || title END, chr(10) ORDER BY pos)
                              FROM sect s WHERE s.doc_id = k.doc_id AND s.page_number = n) || chr(10), '') || '{BODY}' || k.doc_id || '.' END AS text
        FROM kinds k, unnest(range(1, k.last + 1)) AS u(n))"""
# What the rules make of them: headings by number, or entries of a table of contents on the first page that holds them.
BUILT = rf"""entries AS (
        SELECT s.doc_id, s.page_number AS shown, s.pos, structure, title, min(p.page_number) AS page_number
        FROM sect s JOIN papers p ON p.doc_id = s.doc_id AND p.page_number > 1 AND contains({SQUEEZE('p.text')}, {SQUEEZE('s.title')})
        WHERE s.doc_id % 3 = 1 AND s.doc_id IN (SELECT doc_id FROM sect GROUP BY doc_id HAVING count(*) >= 3) GROUP BY ALL),
    headed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY page_number, pos) AS nth FROM sect WHERE doc_id % 3 <> 1),
    found AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY shown, pos) AS INT) AS pos, structure, title, page_number AS physical_index FROM entries
              UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pos) AS INT), structure, title, page_number FROM headed WHERE nth = 1),
    started AS (SELECT f.*, CASE WHEN starts_with({SQUEEZE('p.text')}, {SQUEEZE('f.title')}) THEN 'yes' ELSE 'no' END AS appear_start
                FROM found f JOIN papers p ON p.doc_id = f.doc_id AND p.page_number = f.physical_index),
    prefaced AS (SELECT * FROM started UNION ALL SELECT doc_id, 0, '0', 'Preface', 1, 'yes' FROM started WHERE pos = 1 AND physical_index > 1),
    ranges AS (
        SELECT doc_id, pos, structure, title, NULL AS summary, physical_index AS start_index,
               greatest(physical_index, CASE WHEN nxt IS NULL THEN last WHEN nxt_start = 'yes' THEN nxt - 1 ELSE nxt END) AS end_index
        FROM (SELECT *, lead(physical_index) OVER w AS nxt, lead(appear_start) OVER w AS nxt_start FROM prefaced WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        JOIN kinds USING (doc_id))"""


def geo_items(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as sections ``r``, ``r.n``, ``r.n.s`` of one document."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    one = r.select(F.struct((F.col("r_regionkey") + 1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("k"), F.col("r_name").alias("title"))
    two = n.select(F.struct((F.col("n_regionkey") + 1).cast("long").alias("a"), (F.col("n_nationkey") + 1).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("k"), F.col("n_name").alias("title"))
    both = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    three = both.select(F.struct((F.col("n_regionkey") + 1).cast("long").alias("a"), (F.col("n_nationkey") + 1).cast("long").alias("b"), (F.col("s_suppkey") + 1).alias("c")).alias("k"), F.col("s_name").alias("title"))
    name = F.concat_ws(".", F.col("k.a").cast("string"), F.when(F.col("k.b") > 0, F.col("k.b").cast("string")), F.when(F.col("k.c") > 0, F.col("k.c").cast("string")))
    rows = one.union(two).union(three).withColumn("doc_id", F.lit(1).cast("long"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).alias("pos"), name.alias("structure"), "title")


# Scalar text.


@query(f"SELECT doc_id, CAST({TOKENS('text')} AS INT) AS tokens, CAST(length(text) // 4 AS INT) AS generic, CAST(greatest(1, length(text) // 4) AS INT) AS hosted FROM documents WHERE text IS NOT NULL")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).where("text is not null").select(
        "doc_id", text.count_tokens(t).alias("tokens"), text.provider_tokens(t, "base").alias("generic"), text.provider_tokens(t, "groq").alias("hosted")
    )


@query(f"WITH {DOC_PAGES} SELECT doc_id, page_number, '<physical_index_' || page_number || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_number || '>' || chr(10) || chr(10) AS tagged FROM doc_pages")
def tag_pages(spark: SparkSession, d: str) -> DataFrame:
    return doc_pages(spark, d).select("doc_id", "page_number", text.tag_page(F.col("text"), F.col("page_number")).alias("tagged"))


@query(f"""WITH {DOC_PAGES} SELECT doc_id, page_number, '<physical_index_' || n || '>' || chr(10) || text || chr(10) || '<physical_index_' || n || '>' || chr(10) || chr(10) AS tagged
    FROM (SELECT *, 10 + row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS n FROM doc_pages WHERE page_number > 1)""")
def tag_pages_range(spark: SparkSession, d: str) -> DataFrame:
    """The pages behind each document's first, tagged from 11 on."""
    tagged = chunk.tag_pages(doc_pages(spark, d).where("page_number > 1"), 11)
    return tagged.select("doc_id", "page_number", F.col("text").alias("tagged"))


@query(f"""WITH {DOC_PAGES} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_number)) AS text_md5, count(*) AS page_count,
    CAST(sum({TOKENS('text')}) AS BIGINT) AS total_tokens FROM doc_pages GROUP BY doc_id""")
def document_text(spark: SparkSession, d: str) -> DataFrame:
    whole = page_source.document_texts(doc_pages(spark, d))
    return whole.select("doc_id", F.md5("document_text").alias("text_md5"), "page_count", "total_tokens")


@query("SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substring(text, 1, 47) || '...' END AS short, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 400) || chr(10) || '[truncated]' END AS for_training FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", text.truncate_text(t, 50).alias("short"), text.truncate_for_training(t, 100).alias("for_training"))


@query(rf"SELECT doc_id, {STRIP(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS normal FROM documents")
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", text.normalize_whitespace(F.col("text")).alias("normal"))


@query("""SELECT provider, outcome, CAST(count(*) AS BIGINT) AS runs,
    CASE WHEN sum(c) = 0 THEN 'free' ELSE printf('$%.4f', sum(c)) END AS cost
    FROM (SELECT provider, outcome, (coalesce(page_count, 0) * 800.0 * CASE lower(provider) WHEN 'groq' THEN 0.05 WHEN 'openai' THEN 0.15 WHEN 'anthropic' THEN 0.25 ELSE 0 END
          + coalesce(node_count, 0) * 80.0 * CASE lower(provider) WHEN 'groq' THEN 0.10 WHEN 'openai' THEN 0.60 WHEN 'anthropic' THEN 1.25 ELSE 0 END) / 1e6 AS c
          FROM (SELECT DISTINCT run_id, provider, outcome, page_count, node_count FROM batch_runs)) GROUP BY 1, 2""")
def estimated_cost(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "batch_runs").select("run_id", "provider", "outcome", "page_count", "node_count").dropDuplicates(["run_id"])
    sums = runs.groupBy("provider", "outcome").agg(F.count(F.lit(1)).alias("runs"), F.sum("page_count").alias("p"), F.sum("node_count").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return sums.select("provider", "outcome", "runs", text.estimated_cost(F.lower("provider"), zero("p") * 800, zero("n") * 80).alias("cost"))


# Model JSON.


def noisy_replies(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as model replies: plain, fenced, trailing comma, other literals, in prose, garbage, single quotes."""
    kinds = [
        F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.replace("props", F.lit("}"), F.lit(",}")),
        F.lit('{"k": None}'), F.concat(F.lit("Here it is: "), "props", F.lit(" as asked.")), F.lit("no braces here"), F.translate("props", '"', "'"),
    ]
    content = F.coalesce(*[F.when(F.col("event_id") % 7 == n, k) for n, k in enumerate(kinds)])
    return table(spark, d, "events").select("event_id", content.alias("content"))


@query("""SELECT event_id, event_id % 7 <> 5 AS valid,
    CASE WHEN event_id % 7 IN (3, 5) THEN NULL ELSE CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) END AS k FROM events""")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    fixed = json_text.repair_json(F.col("content"))
    return noisy_replies(spark, d).select("event_id", fixed.isNotNull().alias("valid"), F.from_json(fixed, "k long")["k"].alias("k"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN n WHEN 7 THEN n WHEN 8 THEN -n END AS physical_index
    FROM (SELECT event_id, CAST(event_id % 50 AS INT) AS n FROM events)""")
def parse_index(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 50).cast("string")
    put = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    kinds = [put("<physical_index_", n, ">"), put("physical_index_", n), n, put("  ", n, " "), F.lit(None).cast("string"), F.lit("junk"), put(n, ".0"), put("starts at <physical_index_", n, "> or so"), put("-", n)]
    value = F.coalesce(*[F.when(F.col("event_id") % 9 == i, k) for i, k in enumerate(kinds)])
    return table(spark, d, "events").select("event_id", json_text.parse_index(value).alias("physical_index"))


@query(f"WITH {ITEMS} SELECT doc_id, pos, coalesce(structure, 'None') AS structure, coalesce(title, 'None') AS title, physical_index FROM items WHERE physical_index IS NOT NULL")
def normalize_items(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.concat(F.lit("<physical_index_"), F.col("physical_index").cast("string"), F.lit(">"))
    return toc.normalize_items(items(spark, d).withColumn("physical_index", F.when(F.col("pos") % 2 == 0, tagged).otherwise(F.col("physical_index").cast("string"))))


def _kinds(kinds: list[Column]) -> Column:
    """One of some texts for each event, in turn."""
    return F.coalesce(*[F.when(F.col("event_id") % len(kinds) == n, k) for n, k in enumerate(kinds)])


@query("SELECT event_id, event_id % 7 IN (0, 1, 2, 3) AS yes FROM events")
def yes_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a reply in the ways that models write them."""
    events = table(spark, d, "events")
    kinds = [F.lit('{"answer": "yes"}'), F.lit('```json\n{"answer": "YES"}\n```'), F.lit('{"answer": " Yes\\n",}'), F.lit("so: {'answer': 'yes'}"), F.lit('{"answer": "no"}'), F.lit("{}"), F.lit("none")]
    return events.select("event_id", json_text.is_yes(F.get_json_object(json_text.repair_json(_kinds(kinds)), "$.answer")).alias("yes"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 't' ELSE '' END AS thinking,
    CASE event_id % 5 WHEN 0 THEN printf('%04d,%04d', event_id, event_id + 1) WHEN 1 THEN CAST(event_id + 1 AS VARCHAR) ELSE '' END AS node_ids FROM events""")
def node_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ids of search replies: texts, numbers and empty ones, a list instead of an object, garbage."""
    events = table(spark, d, "events")
    n = F.col("event_id")
    two = F.format_string('{"thinking": "t", "node_list": ["%04d", null, "", "%04d"]}', n, n + 1)
    one = F.format_string('```json\n{"node_list": [%d],}\n```', n + 1)
    kinds = [two, one, F.lit('["0001"]'), F.lit("no reply"), F.lit('{"node_list": []}')]
    read = json_text.node_list(json_text.repair_json(_kinds(kinds)))
    return events.select("event_id", read["thinking"].alias("thinking"), F.array_join(read["node_ids"], ",").alias("node_ids"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'T' || event_id || ',U' ELSE '' END AS titles FROM events")
def toc_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Titles of replies that are a list, an object around one, an object without, or garbage."""
    events = table(spark, d, "events")
    items = F.format_string('[{"structure": "1", "title": "T%d"}, {"title": "U", "page": 3},]', F.col("event_id"))
    kinds = [items, F.concat(F.lit('{"table_of_contents": '), items, F.lit("}")), F.lit('{"other": 1}'), F.lit("none")]
    read = json_text.toc_envelope(json_text.repair_json(_kinds(kinds)))
    return events.select("event_id", F.array_join(F.transform(read, lambda i: i["title"]), ",").alias("titles"))


@query("SELECT run_id, arxiv_id || '.v1' AS name FROM batch_runs WHERE arxiv_id IS NOT NULL AND NOT contains(arxiv_id, '/') GROUP BY ALL")
def document_names(spark: SparkSession, d: str) -> DataFrame:
    """Names out of paths, without folders and the last extension."""
    runs = table(spark, d, "batch_runs").where("arxiv_id is not null and not contains(arxiv_id, '/')").select("run_id", "arxiv_id").distinct()
    path = F.concat(F.lit("file:/papers/2026/"), "arxiv_id", F.lit(".v1.PDF"))
    return runs.select("run_id", page_source.document_name(path).alias("name"))


# Pages and chunks.


@query(rf"WITH {DOC_PAGES} SELECT doc_id, count(*) AS pages, sum(CASE WHEN length({STRIP('text')}) < 10 THEN 1 ELSE 0 END) / count(*) >= 0.8 AS mostly_empty FROM doc_pages GROUP BY doc_id")
def mostly_empty_gate(spark: SparkSession, d: str) -> DataFrame:
    return verify.mostly_empty(doc_pages(spark, d))


@query(f"""WITH RECURSIVE {DOC_PAGES},
    docs AS (SELECT doc_id, list(tok ORDER BY page_number) AS toks, count(*) AS n, sum(tok) AS total, ceil((sum(tok) / ceil(sum(tok) / 300.0) + 300) / 2.0) AS target
             FROM (SELECT doc_id, page_number, {TOKENS('text')} AS tok FROM doc_pages) GROUP BY doc_id),
    walk(doc_id, i, st, c, from_i, to_i) AS (
        SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM docs WHERE total > 300
        UNION ALL
        SELECT w.doc_id, i + 1, CASE WHEN f THEN greatest(st, i - 1) ELSE st END,
               CASE WHEN f THEN toks[i] + toks[i + 1] ELSE c + toks[i + 1] END, CASE WHEN f THEN st END, CASE WHEN f THEN i END
        FROM (SELECT w.*, d.toks, d.n, c + d.toks[i + 1] > d.target AND c > 0 AS f FROM walk w JOIN docs d USING (doc_id) WHERE i < d.n) w),
    spans AS (SELECT doc_id, from_i AS st, to_i AS en FROM walk WHERE from_i IS NOT NULL
              UNION ALL SELECT w.doc_id, w.st, d.n FROM walk w JOIN docs d USING (doc_id) WHERE w.i = d.n
              UNION ALL SELECT doc_id, 0, n FROM docs WHERE total <= 300)
    SELECT s.doc_id, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY en, st) AS INT) AS group_no, CAST(st + 1 AS INT) AS first_page, CAST(en AS INT) AS last_page,
           CAST((SELECT sum({TOKENS('p.text')}) FROM doc_pages p WHERE p.doc_id = s.doc_id AND p.page_number BETWEEN st + 1 AND en) AS BIGINT) AS tokens,
           (SELECT md5(string_agg(p.text, '' ORDER BY page_number)) FROM doc_pages p WHERE p.doc_id = s.doc_id AND p.page_number BETWEEN st + 1 AND en) AS text_md5
    FROM spans s""")
def group_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunk.group_pages(doc_pages(spark, d), 300, 1).withColumn("text_md5", F.md5("text")).drop("text")


@query(f"""WITH {DOC_PAGES}, tagged AS (SELECT doc_id, page_number, '<physical_index_' || page_number || '>' || chr(10) || text || chr(10) || '<physical_index_' || page_number || '>' || chr(10) || chr(10) AS text FROM doc_pages)
    SELECT doc_id, CAST(1 AS INT) AS group_no, CAST(min(page_number) AS INT) AS first_page, CAST(max(page_number) AS INT) AS last_page,
           CAST(sum({TOKENS('text')}) AS BIGINT) AS tokens, md5(string_agg(text, '' ORDER BY page_number)) AS text_md5 FROM tagged GROUP BY doc_id""")
def tagged_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tagged pages in the groups that the section-list stages read, each document within one budget."""
    return chunk.group_page_contents(doc_pages(spark, d), 1_000_000, 1).withColumn("text_md5", F.md5("text")).drop("text")


# Section lists.


@query(f"WITH {ITEMS} SELECT doc_id, pos, structure, title, physical_index, total FROM valid")
def validate_indices(spark: SparkSession, d: str) -> DataFrame:
    return valid_items(spark, d).select("doc_id", "pos", "structure", "title", "physical_index", "total")


@query(f"WITH {ITEMS}, {RANGES} SELECT doc_id, pos, title, start_index, end_index FROM ranges")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    return toc.boundaries(valid_items(spark, d), F.col("total")).select("doc_id", "pos", "title", "start_index", "end_index")


@query(f"""WITH {ITEMS}, firsts AS (SELECT doc_id, arg_min(physical_index, pos) AS f, min(pos) AS p FROM valid GROUP BY doc_id)
    SELECT doc_id, pos, structure, title, physical_index, appear_start FROM valid
    UNION ALL SELECT doc_id, CAST(p - 1 AS INT), '0', 'Preface', 1, 'yes' FROM firsts WHERE f > 1""")
def preface(spark: SparkSession, d: str) -> DataFrame:
    return toc.add_preface(valid_items(spark, d))


@query(f"""WITH {ITEMS}, b AS (SELECT doc_id, CAST(pos // 5 AS INT) AS batch, pos, structure, title, CASE WHEN pos % 7 = 0 THEN NULL ELSE physical_index END AS physical_index FROM items),
    f AS (SELECT *, min(batch) OVER (PARTITION BY doc_id) AS fb FROM b),
    k AS (SELECT *, min(batch) OVER (PARTITION BY doc_id, title) AS born FROM f WHERE batch = fb OR physical_index IS NOT NULL),
    u AS (SELECT doc_id, title, arg_max(physical_index, batch * 100000 + pos) AS late FROM k WHERE batch > born GROUP BY ALL),
    l AS (SELECT doc_id, title, max(pos) AS last_pos FROM k WHERE batch = born GROUP BY ALL)
    SELECT k.doc_id, CAST(row_number() OVER (PARTITION BY k.doc_id ORDER BY k.batch, k.pos) AS INT) AS pos, k.structure, k.title,
           CASE WHEN k.pos = l.last_pos AND u.doc_id IS NOT NULL THEN u.late ELSE k.physical_index END AS physical_index
    FROM k JOIN l ON k.doc_id = l.doc_id AND k.title IS NOT DISTINCT FROM l.title
    LEFT JOIN u ON k.doc_id = u.doc_id AND k.title IS NOT DISTINCT FROM u.title WHERE k.batch = k.born""")
def merge_toc(spark: SparkSession, d: str) -> DataFrame:
    batches = items(spark, d).select(
        "doc_id", F.expr("cast(pos div 5 as int)").alias("batch"), "pos", "structure", "title", F.when(F.col("pos") % 7 != 0, F.col("physical_index")).alias("physical_index")
    )
    return toc.merge_batches(batches)


@query(f"""WITH {ITEMS} SELECT doc_id, pos, '{{' || concat_ws(',', '"structure":' || CAST(to_json(structure) AS VARCHAR), '"title":' || CAST(to_json(title) AS VARCHAR),
    '"physical_index":' || physical_index, '"appear_start":"' || appear_start || '"') || '}}' AS json FROM valid""")
def toc_item_json(spark: SparkSession, d: str) -> DataFrame:
    return toc.item_json(valid_items(spark, d)).select("doc_id", "pos", "json")


# Trees.


@query(f"WITH {ITEMS}, {RANGES}, {PARENTS} SELECT doc_id, pos, parent_pos FROM tree")
def parent_asof(spark: SparkSession, d: str) -> DataFrame:
    return tree.parent_positions(valid_items(spark, d)).select("doc_id", "pos", "parent_pos")


@query(f"{TREE} SELECT doc_id, pos, node_id, depth FROM numbered")
def node_ids_preorder(spark: SparkSession, d: str) -> DataFrame:
    return trees(spark, d).select("doc_id", "pos", "node_id", "depth")


@query(f"""{TREE} SELECT doc_id, CAST(node_id AS INT) AS line_no,
    repeat('  ', depth - 1) || '[' || node_id || '] ' || title || ' (pp. ' || start_index || '-' || end_index || ')' AS line FROM numbered""")
def outline(spark: SparkSession, d: str) -> DataFrame:
    return tree.outline(trees(spark, d))


@query(f"{TREE} SELECT doc_id, count(*) AS nodes, max(depth) AS depth FROM numbered GROUP BY doc_id")
def count_depth(spark: SparkSession, d: str) -> DataFrame:
    return tree.shape(trees(spark, d))


@query("""WITH RECURSIVE k AS (
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, r_name AS title FROM region
        UNION ALL SELECT n_regionkey + 1, n_nationkey + 1, 0, n_name FROM nation
        UNION ALL SELECT n_regionkey + 1, n_nationkey + 1, s_suppkey + 1, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    o AS (SELECT *, CAST(row_number() OVER (ORDER BY a, b, c) AS INT) AS pos FROM k)
    SELECT CAST(1 AS BIGINT) AS doc_id, pos, printf('%04d', pos) AS node_id, CASE WHEN c > 0 THEN 3 WHEN b > 0 THEN 2 ELSE 1 END AS depth,
           CASE WHEN c > 0 THEN (SELECT p.pos FROM o p WHERE p.a = o.a AND p.b = o.b AND p.c = 0)
                WHEN b > 0 THEN (SELECT p.pos FROM o p WHERE p.a = o.a AND p.b = 0) END AS parent_pos, title FROM o""")
def geo_tree(spark: SparkSession, d: str) -> DataFrame:
    built = tree.number(tree.paths(tree.parent_positions(geo_items(spark, d))))
    return built.select("doc_id", "pos", "node_id", "depth", "parent_pos", "title")


@query(f"{TREE} SELECT doc_id, node_id, title, summary, depth FROM numbered")
def search_view(spark: SparkSession, d: str) -> DataFrame:
    return tree.search_view(trees(spark, d)).select("doc_id", "node_id", "title", "summary", "depth")


@query(f"{TREE} SELECT doc_id, CAST(node_id AS INT) AS pos, depth, node_id, title, start_index, end_index FROM numbered")
def tree_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Trees written as nested JSON and read again."""
    nested = tree.to_json(trees(spark, d).withColumn("text", F.lit(None).cast("string")))
    return tree.from_json(nested).select("doc_id", "pos", "depth", "node_id", "title", "start_index", "end_index")


@query(rf"""{TREE}, {PAIR_PAGES} SELECT n.doc_id, n.node_id, md5(nullif({STRIP("string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_number)")}, '')) AS text_md5
    FROM numbered n LEFT JOIN pair_pages p ON p.doc_id = n.doc_id AND p.page_number BETWEEN n.start_index AND n.end_index GROUP BY 1, 2""")
def node_text(spark: SparkSession, d: str) -> DataFrame:
    return tree.add_text(trees(spark, d), pair_pages(spark, d)).select("doc_id", "node_id", F.md5("text").alias("text_md5"))


@query(f"""{TREE}, {PAIR_PAGES} SELECT n.doc_id, n.node_id, CAST(sum({TOKENS('p.text')}) AS BIGINT) AS tokens
    FROM numbered n JOIN pair_pages p ON p.doc_id = n.doc_id AND p.page_number BETWEEN n.start_index AND n.end_index
    WHERE n.end_index - n.start_index + 1 > 3 AND NOT EXISTS (SELECT 1 FROM numbered k WHERE k.doc_id = n.doc_id AND k.parent_pos = n.pos)
    GROUP BY 1, 2 HAVING sum({TOKENS('p.text')}) >= 200""")
def large_nodes(spark: SparkSession, d: str) -> DataFrame:
    return verify.large_nodes(trees(spark, d), pair_pages(spark, d), 3, 200).select("doc_id", "node_id", "tokens")


# Verification.

TOC = f"""{DOC_PAGES}, page_toc AS (SELECT doc_id, page_number AS pos, substring(text, 1, 20) AS title,
        CAST(CASE WHEN page_number % 13 = 0 THEN NULL WHEN page_number % 11 = 0 THEN 999 WHEN (doc_id + page_number) % 3 = 0 THEN page_number + 1 ELSE page_number END AS INT) AS physical_index
        FROM doc_pages),
    judged AS (SELECT t.*, coalesce({SQUEEZE('t.title')} <> '' AND contains({SQUEEZE('p.text')}, {SQUEEZE('t.title')}), false) AS ok,
                      coalesce({SQUEEZE('t.title')} <> '' AND starts_with({SQUEEZE('p.text')}, {SQUEEZE('t.title')}), false) AS at_start
               FROM page_toc t LEFT JOIN doc_pages p ON p.doc_id = t.doc_id AND p.page_number = t.physical_index)"""


def page_toc(spark: SparkSession, d: str) -> DataFrame:
    """A list with one item a page, titled by its first characters; some indices are wrong, far out or missing."""
    n = F.col("page_number")
    index = F.when(n % 13 == 0, None).when(n % 11 == 0, 999).when((F.col("doc_id") + n) % 3 == 0, n + 1).otherwise(n)
    return doc_pages(spark, d).select("doc_id", n.alias("pos"), F.substring("text", 1, 20).alias("title"), index.cast("int").alias("physical_index"))


@query(f"WITH {TOC} SELECT doc_id, count(*) AS items, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS correct, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM judged GROUP BY doc_id")
def verify_accuracy(spark: SparkSession, d: str) -> DataFrame:
    scored = verify.accuracy(verify.appears(page_toc(spark, d), doc_pages(spark, d)))
    return scored.withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {TOC} SELECT doc_id, pos, CASE WHEN at_start THEN 'yes' ELSE 'no' END AS appear_start FROM judged")
def appear_start(spark: SparkSession, d: str) -> DataFrame:
    return verify.appear_start(page_toc(spark, d), doc_pages(spark, d)).select("doc_id", "pos", "appear_start")


@query(f"""WITH {TOC}, near AS (SELECT j.doc_id, j.pos, p.page_number, row_number() OVER (PARTITION BY j.doc_id, j.pos ORDER BY abs(p.page_number - j.physical_index), p.page_number) AS rn
        FROM judged j JOIN doc_pages p ON p.doc_id = j.doc_id AND p.page_number BETWEEN j.physical_index - 5 AND j.physical_index + 5
        WHERE NOT j.ok AND {SQUEEZE('j.title')} <> '' AND contains({SQUEEZE('p.text')}, {SQUEEZE('j.title')}))
    SELECT j.doc_id, j.pos, coalesce(n.page_number, j.physical_index) AS physical_index, j.ok OR n.page_number IS NOT NULL AS ok
    FROM judged j LEFT JOIN near n ON n.doc_id = j.doc_id AND n.pos = j.pos AND n.rn = 1""")
def fix_window(spark: SparkSession, d: str) -> DataFrame:
    pages = doc_pages(spark, d)
    return verify.fixed(verify.appears(page_toc(spark, d), pages), pages).select("doc_id", "pos", "physical_index", "ok")


@query(f"""WITH {TOC}, s AS (SELECT doc_id, sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*) AS a FROM judged GROUP BY doc_id)
    SELECT doc_id, CASE WHEN a = 1 THEN 'keep' WHEN a > 0.6 THEN 'fix' ELSE 'fallback' END AS route FROM s""")
def mode_route(spark: SparkSession, d: str) -> DataFrame:
    return verify.route(verify.accuracy(verify.appears(page_toc(spark, d), doc_pages(spark, d)))).select("doc_id", "route")


@query(rf"""WITH {ITEMS}, {PAPERS} SELECT doc_id, page_number FROM papers WHERE page_number <= 20
    AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^.*\S[ .]{{2,}}\d+\s*$'))) >= 3""")
def toc_page_filter(spark: SparkSession, d: str) -> DataFrame:
    return verify.toc_pages(paper_pages(spark, d)).select("doc_id", "page_number")


# Markdown.

MD = rf"""raw AS (SELECT doc_id, CAST(i AS INT) AS line, lines[i + 1] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL) d,
               unnest(range(len(lines))) AS u(i)),
    l1 AS (SELECT *, {STRIP('raw')} AS s FROM raw),
    l2 AS (SELECT *, starts_with(s, '```') AS fence, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS inside FROM l1),
    l3 AS (SELECT *, NOT fence AND NOT inside AND regexp_matches(s, '^#{{1,6}}\s+.+$') AS header FROM l2),
    l4 AS (SELECT *, CAST(sum(CASE WHEN header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS INT) AS pos FROM l3),
    md AS (SELECT doc_id, pos, max(CASE WHEN header THEN length(regexp_extract(s, '^(#+)', 1)) END) AS level, max(CASE WHEN header THEN line + 1 END) AS line_num,
                  max(CASE WHEN header THEN {STRIP("regexp_extract(s, '^#+(.*)$', 1)")} END) AS title,
                  {STRIP("coalesce(string_agg(CASE WHEN NOT header THEN raw END, chr(10) ORDER BY line), '')")} AS text
           FROM l4 WHERE pos > 0 GROUP BY doc_id, pos),
    mdt AS (SELECT m.*, (SELECT max(p.pos) FROM md p WHERE p.doc_id = m.doc_id AND p.pos < m.pos AND p.level < m.level) AS parent_pos FROM md m)"""


def markdown_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("document "), F.col("doc_id").cast("string"))
    return documents(spark, d).where("text is not null").select("doc_id", name.alias("doc_name"), F.col("text").alias("content"))


@query(f"WITH {MD} SELECT doc_id, pos, CAST(level AS INT) AS level, line_num, title, text FROM md")
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    return markdown.sections(markdown_files(spark, d))


@query(f"WITH {MD} SELECT doc_id, pos, parent_pos FROM mdt")
def md_parent(spark: SparkSession, d: str) -> DataFrame:
    return markdown.parents(markdown.sections(markdown_files(spark, d))).select("doc_id", "pos", "parent_pos")


@query(f"""WITH {MD} SELECT doc_id, pos, parent_pos, title, line_num AS start_index, printf('%04d', pos) AS node_id, nullif(text, '') AS text FROM mdt
    UNION ALL SELECT doc_id, 1, NULL, 'document ' || doc_id, 1, '0001', text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM md)""")
def md_nodes(spark: SparkSession, d: str) -> DataFrame:
    return markdown.nodes(markdown_files(spark, d)).select("doc_id", "pos", "parent_pos", "title", "start_index", "node_id", "text")


@query(f"""WITH {MD}, k AS (SELECT *, NOT (({TOKENS('text')}) < 40 AND NOT EXISTS (SELECT 1 FROM mdt c WHERE c.doc_id = mdt.doc_id AND c.parent_pos = mdt.pos)
            AND row_number() OVER (PARTITION BY doc_id, parent_pos ORDER BY pos) > 1) AS keep FROM mdt),
    g AS (SELECT *, sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, parent_pos ORDER BY pos) AS grp FROM k),
    bare AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM md))
    SELECT doc_id, min(pos) AS pos, arg_min(title, pos) AS title, arg_max(line_num, pos) AS end_index,
           CASE WHEN count(*) > 1 THEN coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY pos), '') ELSE nullif(any_value(text), '') END AS text
    FROM g GROUP BY doc_id, parent_pos, grp
    UNION ALL SELECT doc_id, 1, 'document ' || doc_id, 1, nullif(text, '') FROM bare""")
def md_thin(spark: SparkSession, d: str) -> DataFrame:
    return markdown.thin(markdown.nodes(markdown_files(spark, d)), 40).select("doc_id", "pos", "title", "end_index", "text")


# Search and answers.

ASKED = rf"""questions AS (SELECT CAST(doc_id * 1000 + pos AS BIGINT) AS query_id, doc_id, title AS question FROM numbered WHERE title IS NOT NULL),
    asked AS (SELECT DISTINCT query_id, doc_id, unnest(regexp_split_to_array(lower(question), '[^\p{{L}}\p{{N}}]+')) AS term FROM questions),
    held AS (SELECT DISTINCT doc_id, node_id, unnest(regexp_split_to_array(lower(concat_ws(' ', title, summary)), '[^\p{{L}}\p{{N}}]+')) AS term FROM numbered),
    scored AS (SELECT query_id, a.doc_id, node_id, count(*) AS score FROM asked a JOIN held h ON h.doc_id = a.doc_id AND h.term = a.term WHERE length(a.term) >= 3 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, node_id) AS rank FROM scored)"""


def questions(nodes: DataFrame) -> DataFrame:
    key = (F.col("doc_id") * 1000 + F.col("pos")).alias("query_id")
    return nodes.where("title is not null").select(key, "doc_id", F.col("title").alias("question"))


@query(f"""{TREE}, {ASKED} SELECT q.query_id, q.doc_id, coalesce(string_agg(r.node_id, ',' ORDER BY r.rank), '') AS node_ids
    FROM questions q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.doc_id = q.doc_id AND r.rank <= 5 GROUP BY 1, 2""")
def search_rule(spark: SparkSession, d: str) -> DataFrame:
    nodes = trees(spark, d)
    found = search.search(questions(nodes), nodes)
    return found.select("query_id", "doc_id", F.array_join("node_ids", ",").alias("node_ids"))


@query(rf"""{TREE}, {ASKED}, {PAIR_PAGES},
    hits AS (SELECT r.query_id, r.doc_id, r.rank, n.title, n.start_index, n.end_index, {STRIP("string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_number)")} AS text
             FROM ranked r JOIN numbered n ON n.doc_id = r.doc_id AND n.node_id = r.node_id
             JOIN pair_pages p ON p.doc_id = n.doc_id AND p.page_number BETWEEN n.start_index AND n.end_index WHERE r.rank <= 5 GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT q.query_id, q.doc_id, coalesce(substring(c.context, 1, 200), '{search.NOTHING}') AS answer, md5(coalesce(c.context, '')) AS context_md5, CAST(coalesce(c.n, 0) AS INT) AS citations
    FROM questions q LEFT JOIN (SELECT query_id, doc_id, string_agg('[' || title || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n
                                FROM hits WHERE text <> '' AND title IS NOT NULL GROUP BY 1, 2) c ON c.query_id = q.query_id AND c.doc_id = q.doc_id""")
def rag_rule(spark: SparkSession, d: str) -> DataFrame:
    nodes = trees(spark, d)
    asked = questions(nodes)
    replies = TreeBuilder().answer(asked, nodes, pair_pages(spark, d))
    return replies.select("query_id", "doc_id", "answer", F.md5("context").alias("context_md5"), F.size("citations").alias("citations"))


# Batches and examples.


@query("SELECT DISTINCT pair_id, arxiv_id FROM training WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM error_records WHERE arxiv_id IS NOT NULL) AND arxiv_id NOT IN (SELECT arxiv_id FROM batch_runs WHERE outcome = 'ok' AND arxiv_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training").where("arxiv_id is not null").select("pair_id", "arxiv_id").distinct()
    return records.pending(rows, table(spark, d, "batch_runs").where("outcome = 'ok'"), table(spark, d, "error_records"), "arxiv_id").select("pair_id", "arxiv_id")


@query("""SELECT arxiv_id FROM (SELECT DISTINCT arxiv_id FROM training WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM error_records WHERE arxiv_id IS NOT NULL))
    ORDER BY arxiv_id LIMIT 25""")
def pending_first(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 papers by id that have not failed: what a limited run takes next."""
    papers = table(spark, d, "training").where("arxiv_id is not null").select("arxiv_id").distinct()
    return records.pending(papers, papers.limit(0), table(spark, d, "error_records"), "arxiv_id", 25)


@query("""SELECT count(*) FILTER (WHERE outcome <> 'error') AS processed, count(*) FILTER (WHERE outcome = 'error') AS errors, CAST(7 AS BIGINT) AS skipped, count(*) + 7 AS total
    FROM (SELECT DISTINCT run_id, outcome FROM batch_runs WHERE outcome IS NOT NULL)""")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a job over the logged runs, seven skipped."""
    runs = table(spark, d, "batch_runs").where("outcome is not null").select("run_id", "outcome").distinct()
    return records.progress(runs.withColumn("error", F.when(F.col("outcome") == "error", "failed")), 7)


@query("""SELECT model, count(*) FILTER (outcome = 'ok') AS processed, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'skipped') AS skipped,
    count(*) AS total, sum(page_count) AS pages, sum(node_count) AS nodes FROM (SELECT DISTINCT run_id, model, outcome, page_count, node_count FROM batch_runs) GROUP BY model""")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "batch_runs").select("run_id", "model", "outcome", "page_count", "node_count").dropDuplicates(["run_id"])
    of = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return runs.groupBy("model").agg(
        of("ok").alias("processed"), of("error").alias("errors"), of("skipped").alias("skipped"), F.count(F.lit(1)).alias("total"),
        F.sum("page_count").alias("pages"), F.sum("node_count").alias("nodes"),
    )


@query("""SELECT provider, model, count(*) AS documents, round(avg(generation_time_seconds), 4) AS seconds, sum(node_count) AS nodes,
    round(sum(generation_time_seconds) / nullif(sum(page_count), 0), 4) AS seconds_a_page
    FROM (SELECT DISTINCT run_id, provider, model, generation_time_seconds, page_count, node_count FROM batch_runs
          WHERE outcome = 'ok' AND isfinite(generation_time_seconds) AND generation_time_seconds >= 0) GROUP BY ALL""")
def provider_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents, mean seconds, sections and seconds a page of every provider and model."""
    seconds = F.col("generation_time_seconds")
    good = table(spark, d, "batch_runs").where((F.col("outcome") == "ok") & (seconds >= 0) & (seconds < float("inf")) & ~F.isnan(seconds))
    runs = good.select("run_id", "provider", "model", "generation_time_seconds", "page_count", "node_count").dropDuplicates(["run_id"])
    return runs.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg(seconds), 4).alias("seconds"), F.sum("node_count").alias("nodes"),
        F.round(F.try_divide(F.sum(seconds), F.sum("page_count")), 4).alias("seconds_a_page"),
    )


@query(rf"""SELECT {STRIP("lower(coalesce(error, ''))")} AS message, count(*) AS records, count(DISTINCT arxiv_id) AS papers
    FROM (SELECT DISTINCT error_id, arxiv_id, error FROM error_records) GROUP BY 1""")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "error_records").dropDuplicates(["error_id"])
    message = text.strip(F.lower(F.coalesce("error", F.lit("")))).alias("message")
    return rows.groupBy(message).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("arxiv_id").alias("papers"))


def _structures_sql(fields: tuple[str, ...]) -> str:
    """Nested JSON of the numbered nodes in SQL: what opens and closes between a node and the one before follows from their depths."""
    named = ", ".join(f"""'"{f}":' || CAST(to_json({f}) AS VARCHAR)""" for f in fields)
    return f"""chained AS (SELECT doc_id, node_id, depth, concat_ws(',', {named}) AS own, lag(depth) OVER w AS above, lead(depth) OVER w AS below FROM numbered
                         WINDOW w AS (PARTITION BY doc_id ORDER BY path)),
    structures AS (SELECT doc_id, '[' || string_agg(CASE WHEN above IS NULL THEN '' WHEN depth > above THEN ',"nodes":[' ELSE repeat(']}}', above - depth) || ',' END
                                                    || '{{' || own || CASE WHEN below > depth THEN '' ELSE '}}' END
                                                    || CASE WHEN below IS NULL THEN repeat(']}}', depth - 1) ELSE '' END, '' ORDER BY node_id) || ']' AS structure
                   FROM chained GROUP BY doc_id)"""


TEMPLATES_SQL = "(VALUES " + ", ".join(f"({n}, '{q}')" for n, q in enumerate(training.QUESTIONS)) + ") AS q(template, q)"


@query(f"""{TREE}, {_structures_sql(("title", "node_id", "summary"))} SELECT doc_id, node_id, template, '{training.SEARCH_ROLE}' AS role,
    md5(replace(q, '{{}}', title) || chr(10) || chr(10) || 'Tree:' || chr(10) || structure) AS asked_md5,
    '{{"thinking":"The section fits.","node_list":["' || node_id || '"]}}' AS reply
    FROM numbered JOIN structures USING (doc_id), {TEMPLATES_SQL} WHERE coalesce(summary, '') <> ''""")
def treesearch_examples(spark: SparkSession, d: str) -> DataFrame:
    nodes = trees(spark, d)
    structures = tree.to_json(nodes, ("title", "node_id", "summary"))
    made = training.search_examples(nodes, structures)
    said = lambda n: F.get("messages", F.lit(n))["content"]
    return made.select("doc_id", "node_id", "template", said(0).alias("role"), F.md5(said(1)).alias("asked_md5"), said(2).alias("reply"))


@query(f"""{TREE}, h AS (SELECT doc_id, node_id, md5(doc_id || ':' || node_id) AS h FROM numbered),
    b AS (SELECT max(h) AS border FROM (SELECT h FROM h ORDER BY h LIMIT (SELECT greatest(1, count(*) // 10) FROM h)))
    SELECT doc_id, node_id, CASE WHEN h <= border THEN 'eval' ELSE 'train' END AS split FROM h, b""")
def train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    nodes = trees(spark, d).select("doc_id", "node_id")
    return training.split(nodes, F.concat(F.col("doc_id").cast("string"), F.lit(":"), "node_id"))


@query(f"""{TREE}, {_structures_sql(("title", "start_index", "end_index", "node_id", "summary"))}
    SELECT doc_id AS pair_id, '{training.BUILD_ROLE}' AS role,
           md5(CASE WHEN length(document_text) <= 32000 THEN document_text ELSE substring(document_text, 1, 32000) || chr(10) || '[truncated]' END) AS text_md5,
           md5('{{"doc_name":' || coalesce(CAST(to_json(doc_name) AS VARCHAR), 'null') || ',"structure":' || structure || '}}') AS tree_md5
    FROM (SELECT pair_id AS doc_id, max(document_text) AS document_text, max(doc_name) AS doc_name FROM training GROUP BY 1) JOIN structures USING (doc_id)
    WHERE document_text IS NOT NULL""")
def treegen_examples(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "training").groupBy(F.col("pair_id").alias("doc_id")).agg(F.max("doc_name").alias("doc_name"), F.max("document_text").alias("document_text"))
    structures = tree.to_json(trees(spark, d), ("title", "start_index", "end_index", "node_id", "summary"))
    made = training.build_examples(once.where("document_text is not null").join(structures, "doc_id"))
    said = lambda n: F.get("messages", F.lit(n))["content"]
    return made.select(F.col("doc_id").alias("pair_id"), said(0).alias("role"), F.md5(said(1)).alias("text_md5"), F.md5(said(2)).alias("tree_md5"))


# The stages of the pipeline one by one, over the papers.


@query(rf"""WITH {ITEMS}, {PAPERS}, seen AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^.*\S[ .]{{2,}}\d+\s*$')) AS listed
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM papers WHERE page_number = 1) GROUP BY doc_id)
    SELECT k.doc_id, CASE WHEN listed >= 3 THEN 'toc_with_pages' ELSE 'no_toc' END AS mode, CASE WHEN listed >= 3 THEN 'yes' ELSE 'no' END AS page_index_given,
           CASE WHEN listed >= 3 THEN md5((SELECT text FROM papers p WHERE p.doc_id = k.doc_id AND page_number = 1)) END AS toc_md5
    FROM kinds k LEFT JOIN seen USING (doc_id)""")
def detect_toc(spark: SparkSession, d: str) -> DataFrame:
    """Which papers hold a table of contents, its text, and whether it gives pages."""
    found = TreeBuilder().detect_toc(paper_pages(spark, d))
    return found.select("doc_id", "mode", "page_index_given", F.md5("toc_content").alias("toc_md5"))


def _listed(spark: SparkSession, d: str, mode: str, kind: int) -> DataFrame:
    pages = paper_pages(spark, d)
    pages = pages.where(F.col("doc_id") % 3 == kind)
    builder = TreeBuilder()
    docs = builder.detect_toc(pages).where("toc_content is not null" if kind else "toc_content is null")
    return builder.sections(mode, docs, pages)[0].select("doc_id", "pos", "structure", "title", "physical_index")


@query(rf"WITH {ITEMS}, {PAPERS}, {BUILT} SELECT doc_id, pos, structure, title, physical_index FROM found WHERE doc_id % 3 = 1")
def index_toc(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a table of contents with the page that holds them, from one question a group of pages."""
    return _listed(spark, d, "toc_with_pages", 1)


@query(rf"WITH {ITEMS}, {PAPERS}, {BUILT} SELECT doc_id, pos, structure, title, physical_index FROM found WHERE doc_id % 3 = 1")
def fold_toc(spark: SparkSession, d: str) -> DataFrame:
    """The same entries from the sequential fold for tables whose page numbers are not used."""
    return _listed(spark, d, "toc_no_pages", 1)


@query(rf"WITH {ITEMS}, {PAPERS}, {BUILT} SELECT doc_id, pos, structure, title, physical_index FROM found WHERE doc_id % 3 = 0")
def fold_headings(spark: SparkSession, d: str) -> DataFrame:
    """Sections from the sequential fold over the pages of papers without a table of contents."""
    return _listed(spark, d, "no_toc", 0)


@query(rf"""WITH RECURSIVE {ITEMS}, {PAPERS}, {BUILT} SELECT p.doc_id, p.pos, p.title, p.physical_index, p.appear_start FROM prefaced p""")
def started_sections(spark: SparkSession, d: str) -> DataFrame:
    """The verified lists of all papers with a preface where one is missing, and which sections begin their page."""
    builder, pages = TreeBuilder(), paper_pages(spark, d)
    items, _ = builder.section_lists(pages)
    started = builder.checked(items, pages, "title_at_start", prompts.title_at_start, "start_begin")
    started = started.withColumn("appear_start", F.when(F.col("ok"), "yes").otherwise("no"))
    return toc.add_preface(started).select("doc_id", "pos", "title", "physical_index", "appear_start")


@query("""WITH k AS (SELECT n_regionkey + 1 AS doc_id, n_nationkey AS n, CAST(-1 AS BIGINT) AS s, n_name AS title FROM nation
        UNION ALL SELECT n_regionkey + 1, n_nationkey, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, s) AS INT) AS page FROM k),
    tops AS (SELECT doc_id, n, min(page) AS lo, max(page) AS hi FROM p GROUP BY doc_id, n),
    nodes AS (SELECT p.doc_id, title, page AS start_index, CASE WHEN s < 0 THEN hi ELSE page END AS end_index, CASE WHEN s < 0 THEN 1 ELSE 2 END AS depth
              FROM p JOIN tops t ON t.doc_id = p.doc_id AND t.n = p.n WHERE s < 0 OR hi - lo + 1 > 2)
    SELECT CAST(doc_id AS BIGINT) AS doc_id, printf('%04d', row_number() OVER (PARTITION BY doc_id ORDER BY start_index)) AS node_id, title, start_index, end_index, depth FROM nodes""")
def subdivide(spark: SparkSession, d: str) -> DataFrame:
    """Regions as documents with nations as sections, of which the large ones get their suppliers' pages as children."""
    nations, suppliers = table(spark, d, "nation"), table(spark, d, "supplier")
    doc = (F.col("n_regionkey") + 1).cast("long").alias("doc_id")
    none = F.lit(None).cast("long").alias("s")
    one = nations.select(doc, F.col("n_nationkey").alias("n"), none, F.col("n_name").alias("title"))
    two = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(doc, F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("s"), F.col("s_name").alias("title"))
    order = Window.partitionBy("doc_id").orderBy("n", F.col("s").asc_nulls_first())
    structure = F.concat_ws(".", (F.col("n") + 1).cast("string"), (F.col("s") + 1).cast("string")).alias("structure")
    placed = one.union(two).select("*", F.row_number().over(order).alias("page_number"), structure)
    page = F.concat("title", F.lit("\n"), "structure", F.lit(" "), "title", F.lit("\nWhat follows belongs to it."))
    pages = placed.select("doc_id", "page_number", page.alias("text")).withColumn("token_count", text.count_tokens(F.col("text")))
    tops = placed.where("s is null").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("pos"), "structure", "title", F.col("page_number").alias("physical_index"))
    nodes = TreeBuilder(Settings(max_pages_per_node=2, max_tokens_per_node=1)).assemble(tops, pages)
    return tree.number(nodes).select("doc_id", "node_id", "title", "start_index", "end_index", "depth")


def _replayed(rows: DataFrame, prompt: Column, reply: Column) -> TreeBuilder:
    """A builder whose model answers just the prompts of ``rows``; any other prompt is a miss."""
    recorded = rows.select(req_id("replay", prompt).alias("req_id"), reply.alias("text"), F.lit("stop").alias("finish_reason"))
    return TreeBuilder(completer=ReplayCompleter(recorded, recorded.limit(0)))


@query(f"""{TREE} SELECT CAST(q.doc_id * 1000 + q.pos AS BIGINT) AS query_id, q.doc_id, 'by title' AS thinking, min(q.node_id) OVER (PARTITION BY q.doc_id, q.title) || ',9999,0001' AS node_ids,
    2 AS known FROM numbered q WHERE q.title IS NOT NULL""")
def recorded_search(spark: SparkSession, d: str) -> DataFrame:
    """Searches answered by a recorded model that saw the question and the whole tree; unknown ids fall away when resolved."""
    nodes = trees(spark, d)
    structures = tree.to_json(nodes, ("title", "node_id", "summary"))
    asked = questions(nodes)
    first = nodes.groupBy("doc_id", F.col("title").alias("question")).agg(F.min("node_id").alias("node_id"))
    rows = asked.join(structures, "doc_id").join(first, ["doc_id", "question"])
    reply = F.format_string('```json\n{"thinking": "by title", "node_list": ["%s", "9999", "0001"]}\n```', "node_id")
    builder = _replayed(rows, prompt_column(prompts.search, F.col("question"), F.col("structure")), reply)
    found = cut(builder.search(asked, nodes))
    known = tree.resolve(found, nodes).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("known"))
    return found.join(known, "query_id").select("query_id", "doc_id", "thinking", F.array_join("node_ids", ",").alias("node_ids"), "known")


@query(f"{TREE} SELECT doc_id, 'Document ' || doc_id || ' in short.' AS doc_description FROM numbered GROUP BY doc_id")
def recorded_description(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions by a recorded model that saw the tree with its ranges, without text."""
    nodes = trees(spark, d)
    structures = tree.to_json(nodes, ("title", "start_index", "end_index", "node_id", "summary"))
    reply = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" in short."))
    return _replayed(structures, prompt_column(prompts.describe, F.col("structure")), reply).describe(nodes)


FAILED_SQL = FAILED.replace("'", "''")


@query(rf"""WITH RECURSIVE {ITEMS}, {PAPERS}, {BUILT}, {PARENTS}, {PATHS},
    texts AS (SELECT n.doc_id, n.pos, {STRIP("string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_number)")} AS text
              FROM numbered n JOIN papers p ON p.doc_id = n.doc_id AND p.page_number BETWEEN n.start_index AND n.end_index GROUP BY 1, 2),
    said AS (SELECT *, regexp_extract(text, '(?s)^\s*(.*?[.!?])(\s|$)', 1) AS first FROM texts)
    SELECT n.doc_id, n.node_id, n.depth, n.title, n.start_index, n.end_index,
           CASE WHEN first <> '' AND length(first) <= 200 THEN first ELSE substring(text, 1, 200) END AS summary FROM numbered n JOIN said USING (doc_id, pos)
    UNION ALL SELECT doc_id, NULL, NULL, '{FAILED_SQL}', NULL, NULL, NULL FROM kinds WHERE doc_id NOT IN (SELECT doc_id FROM numbered)""")
def build_trees(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over papers of all three kinds: lists, verification, fallbacks, trees, texts, summaries, failures."""
    nodes, failures = TreeBuilder().build(paper_pages(spark, d))
    columns = ["doc_id", "node_id", "depth", "title", "start_index", "end_index", "summary"]
    failed = failures.select("doc_id", F.col("error").alias("title"))
    return nodes.select(*columns).unionByName(failed, allowMissingColumns=True)
