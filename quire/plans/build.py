"""From pages to section trees, and from questions to answers with citations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.completion import folds, prompts
from quire.completion.base import Completer, req_id
from quire.completion.offline import RuleCompleter
from quire.config import MODES, Settings
from quire.functions.json_text import is_yes, node_list, parse_index, repair_json
from quire.functions.text import strip, tag_page
from quire.operators import chunk, toc, tree, verify
from quire.operators.search import NOTHING, search
from quire.runtime import cut

FAILED = "All three processing modes failed to give a section list that fits the pages."


def prompt_column(build, *columns: Column) -> Column:
    """A prompt of a fixed wording around texts, as a concatenation: ``build`` is called once with marks.

    The texts stand in the prompt in the order and as they are given; a wording that loses, repeats or
    swaps a mark is an error.
    """
    marks = [f"[[quire text {i}]]" for i in range(len(columns))]
    text = build(*marks)
    parts: list[Column] = []
    for mark, column in zip(marks, columns):
        if text.count(mark) != 1:
            raise ValueError(f"the prompt does not hold text {mark} once and in order")
        before, _, text = text.partition(mark)
        parts += [F.lit(before), F.coalesce(column.cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(text))


@dataclass
class TreeBuilder:
    """The pipeline over any number of documents at once.

    Documents stand in different modes side by side; each pass handles those of one mode and hands
    the failed on. Completions are materialised before they are used, so none is asked twice. One
    completer serves every stage: sequential folds ask through ``completer.ask()`` unless ``ask`` is
    given. ``requested`` counts the requests of each stage since the builder was made.
    """

    settings: Settings = field(default_factory=Settings)
    completer: Completer = field(default_factory=RuleCompleter)
    ask: folds.Ask | None = None
    requested: dict[str, int] = field(default_factory=dict)
    count_requests: bool = False

    def __post_init__(self) -> None:
        self.completer = self.completer.capped(self.settings.max_concurrent_llm_calls)
        if self.ask is None:
            self.ask = self.completer.ask()

    def _complete(self, rows: DataFrame, stage: str, prompt: Column, keys: list[str], **inputs: Column) -> DataFrame:
        """``keys`` and ``reply`` of one stage."""
        given = F.create_map(*[x for k, v in inputs.items() for x in (F.lit(k), v.cast("string"))])
        requests = rows.select(*keys, prompt.alias("prompt"), given.alias("inputs")).withColumn("req_id", req_id(self.completer.name, F.col("prompt")))
        requests = cut(requests.withColumn("stage", F.lit(stage)).withColumn("key", F.lit(None).cast("string")))
        if self.count_requests:
            self.requested[stage] = self.requested.get(stage, 0) + requests.select("req_id").distinct().count()
        done = cut(self.completer.complete(requests.select("req_id", F.lit(None).cast("long").alias("doc_id"), "stage", "key", "prompt", "inputs")))
        return requests.select(*keys, "req_id").join(done.select("req_id", F.col("text").alias("reply"), "status", "error"), "req_id").drop("req_id")

    def _field(self, reply: Column, name: str) -> Column:
        return F.get_json_object(repair_json(reply), f"$.{name}")

    def detect_toc(self, pages: DataFrame) -> DataFrame:
        """``(doc_id, toc_content, toc_page_list, page_index_given, mode)``: one question a page, then two a document."""
        first = pages.where(F.col("page_number") <= self.settings.toc_check_pages)
        asked = self._complete(first, "toc_page", prompt_column(prompts.toc_page, F.col("text")), ["doc_id", "page_number"], page=F.col("text"))
        hit = asked.where(is_yes(self._field(F.col("reply"), "toc_detected"))).select("doc_id", "page_number")
        listed = hit.join(pages, ["doc_id", "page_number"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
        raw = listed.select("doc_id", F.col("p.page_number").alias("toc_page_list"), F.array_join("p.text", "\n").alias("raw"))
        got = self._complete(raw, "extract_toc", prompt_column(prompts.extract_toc, F.col("raw")), ["doc_id"], page=F.col("raw"))
        probe = raw.join(got.select("doc_id", "reply"), "doc_id", "left").withColumn("toc_content", F.coalesce("reply", "raw")).drop("reply")
        given = self._complete(probe, "detect_page_index", prompt_column(prompts.detect_page_index, F.col("toc_content")), ["doc_id"], toc=F.col("toc_content"))
        yes = is_yes(self._field(F.col("reply"), "page_index_given_in_toc"))
        found = probe.join(given.select("doc_id", yes.alias("yes")), "doc_id", "left")
        docs = pages.select("doc_id").distinct().join(found, "doc_id", "left")
        mode = F.when(F.col("toc_content").isNull(), MODES[2]).when(F.coalesce("yes", F.lit(False)), MODES[0]).otherwise(MODES[1])
        given_text = F.when(F.coalesce("yes", F.lit(False)), "yes").otherwise("no")
        return cut(docs.select("doc_id", "toc_content", "toc_page_list", given_text.alias("page_index_given"), mode.alias("mode")))

    def _groups(self, pages: DataFrame) -> DataFrame:
        return chunk.group_page_contents(pages, self.settings.max_tokens_per_node, self.settings.overlap_pages)

    def sections(self, mode: str, docs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Normalised items ``(doc_id, pos, structure, title, physical_index)`` of the documents, in one mode.

        The second table ``(doc_id, error)`` holds the calls that failed, one row per document.
        """
        groups = self._groups(pages.join(docs.select("doc_id"), "doc_id", "left_semi")).join(docs.select("doc_id", F.col("toc_content").alias("toc")), "doc_id")
        if mode == MODES[0]:
            prompt = prompt_column(prompts.index_toc, F.col("toc"), F.col("text"))
            replies = cut(self._complete(groups, "index_toc", prompt, ["doc_id", "group_no"], toc=F.col("toc"), content=F.col("text")))
            items = F.from_json(repair_json(F.col("reply")), "array<struct<structure:string,title:string,physical_index:string>>")
            rows = replies.select("doc_id", F.col("group_no").alias("batch"), F.posexplode(items).alias("pos", "i"))
            named = rows.select("doc_id", "batch", "pos", "i.structure", "i.title", parse_index(F.col("i.physical_index")).alias("physical_index"))
            failed = replies.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "group_no").alias("error"))
            return toc.normalize_items(toc.merge_batches(named)), failed
        run = folds.folded("no_toc" if mode == MODES[2] else "toc_no_pages", self.ask)
        found = cut(groups.select("doc_id", "group_no", "text", "toc").groupBy("doc_id").applyInPandas(run, folds.SCHEMA))
        return toc.normalize_items(found.where("error is null")), found.where("error is not null").select("doc_id", "error")

    def checked(self, items: DataFrame, pages: DataFrame, stage: str, build, answer: str) -> DataFrame:
        """Items with ``ok`` as one question each tells; without such a page the answer is no."""
        placed = verify.on_page(items, pages)
        asked = self._complete(
            placed.where("page is not null"), stage, prompt_column(build, F.col("title"), F.col("page")), ["doc_id", "pos"],
            title=F.col("title"), page=F.col("page"),
        )
        yes = asked.select("doc_id", "pos", is_yes(self._field(F.col("reply"), answer)).alias("ok"))
        return items.join(yes, ["doc_id", "pos"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))

    def corrected(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """Items with wrong indices moved to where the section starts, as far as the pages around tell.

        A model is asked once a wrong item, with the tagged pages of its window; what it moves is
        verified again. The rule completer looks for the nearest page that holds the title.
        """
        window = self.settings.fix_window
        if isinstance(self.completer, RuleCompleter):
            return verify.fixed(items, pages, window)
        near = verify.fix_candidates(items, pages, window).withColumn("text", tag_page(F.col("text"), F.col("page_number")))
        listed = near.groupBy("doc_id", "pos").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
        asked = listed.withColumn("content", F.array_join("p.text", ""))
        prompt = prompt_column(prompts.fix_entry, F.col("title"), F.col("content"))
        replies = self._complete(asked, "fix_entry", prompt, ["doc_id", "pos"], title=F.col("title"), content=F.col("content"))
        moved = replies.select("doc_id", "pos", parse_index(self._field(F.col("reply"), "physical_index")).alias("better"))
        joined = cut(items.join(moved, ["doc_id", "pos"], "left"))
        stayed = joined.where("ok or better is null").drop("better")
        changed = joined.where("not ok and better is not null").withColumn("physical_index", F.col("better")).drop("better", "ok")
        return stayed.unionByName(self.checked(changed, pages, "title_appears", prompts.title_appears, "answer"))

    def section_lists(self, pages: DataFrame, probe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """``(items, failures)``: verified lists, and the documents for which every mode failed.

        At most one pass a mode: a list of which at most ``accuracy_gate`` holds sends the document to
        the next mode, a better one is corrected in up to ``fix_rounds`` rounds. A failure names the
        errors of the calls that led to it, mode by mode.
        """
        docs = self.detect_toc(pages) if probe is None else probe
        totals = cut(pages.groupBy("doc_id").agg(F.max("page_number").alias("total")))
        done: DataFrame | None = None
        errors: DataFrame | None = None
        waiting = docs
        for number, mode in enumerate(MODES):
            now = cut(waiting.where(F.col("mode") == mode))
            rest = waiting.where(F.col("mode") != mode)
            listed, broken = self.sections(mode, now, pages)
            broken = broken.select("doc_id", F.lit(number).alias("n"), F.concat(F.lit(f"{mode}: "), "error").alias("error"))
            errors = broken if errors is None else errors.unionByName(broken)
            items = toc.in_range(listed.join(totals, "doc_id"), F.col("total")).drop("total")
            judged = cut(self.checked(cut(items), pages, "title_appears", prompts.title_appears, "answer"))
            routed = cut(verify.route(verify.accuracy(judged), self.settings.accuracy_gate))
            good = judged.join(routed.where("route <> 'fallback'").select("doc_id"), "doc_id", "left_semi")
            for _ in range(self.settings.fix_rounds):
                if good.where("not ok").isEmpty():
                    break
                good = cut(self.corrected(good, pages))
            good = good.select("doc_id", "pos", "structure", "title", "physical_index")
            done = good if done is None else done.unionByName(good)
            failed = now.join(routed.where("route <> 'fallback'").select("doc_id"), "doc_id", "left_anti")
            following = MODES[number + 1] if number + 1 < len(MODES) else "failed"
            waiting = cut(rest.unionByName(failed.withColumn("mode", F.lit(following))))
        assert done is not None and errors is not None
        told = errors.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "error")))["error"], "; ").alias("error"))
        failed = waiting.select("doc_id").join(told, "doc_id", "left")
        return cut(done), cut(failed.select("doc_id", F.concat_ws(" ", F.lit(FAILED), "error").alias("error")))

    def assemble(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """The numbered tree of verified items: starts, preface, ranges, parents, subdivision."""
        totals = pages.groupBy("doc_id").agg(F.max("page_number").alias("total"))
        started = self.checked(items, pages, "title_at_start", prompts.title_at_start, "start_begin")
        started = started.withColumn("appear_start", F.when(F.col("ok"), "yes").otherwise("no")).drop("ok")
        ranged = toc.boundaries(toc.add_preface(started).join(totals, "doc_id"), F.col("total")).drop("total")
        nodes = tree.paths(tree.parent_positions(ranged)).select(
            "doc_id", "pos", "parent_pos", "path", "depth", "structure", "title", "start_index", "end_index"
        )
        return self.subdivide(cut(nodes), pages)

    def subdivide(self, nodes: DataFrame, pages: DataFrame) -> DataFrame:
        """Leaves over the page and token limits get children from their own pages, until nothing shrinks.

        Only leaves are expanded, children keep within the leaf's old range, and a leaf whose children
        would not be smaller stays as it is, so every round works on smaller ranges and the loop ends. A
        first child that repeats its leaf's title is the leaf itself and is left out. A leaf whose call
        fails stays whole.
        """
        s = self.settings
        frontier = nodes
        while True:
            large = cut(verify.large_nodes(frontier, pages, s.max_pages_per_node, s.max_tokens_per_node))
            if large.isEmpty():
                break
            inner = large.select((F.xxhash64("doc_id", "pos")).alias("node_key"), "doc_id", "pos", "title", "path", "depth", "start_index", "end_index")
            inner = cut(inner)
            spread = inner.select("node_key", "doc_id", F.explode(F.sequence("start_index", "end_index")).alias("page_number"))
            own = spread.join(pages, ["doc_id", "page_number"]).select(F.col("node_key").alias("doc_id"), "page_number", "text", "token_count")
            docs = inner.select(F.col("node_key").alias("doc_id"), F.lit(None).cast("string").alias("toc_content"))
            items, _ = self.sections(MODES[2], docs, own)
            started = self.checked(cut(items), own, "title_at_start", prompts.title_at_start, "start_begin")
            started = started.withColumn("appear_start", F.when(F.col("ok"), "yes").otherwise("no")).withColumnsRenamed({"doc_id": "node_key", "title": "sub_title"})
            outer = inner.withColumnsRenamed({"pos": "leaf_pos", "path": "leaf_path", "depth": "leaf_depth", "start_index": "lo", "end_index": "hi"})
            within = started.join(outer, "node_key").where("physical_index between lo and hi")
            first = F.col("pos") == F.min("pos").over(Window.partitionBy("node_key"))
            within = within.withColumn("own", first & strip(F.col("sub_title")).eqNullSafe(strip(F.col("title")))).where("not own").drop("own")
            ranged = toc.boundaries(within.drop("doc_id").withColumnRenamed("node_key", "doc_id"), F.col("hi")).withColumnRenamed("doc_id", "node_key")
            smaller = ranged.where("not (start_index = lo and end_index = hi)")
            last = nodes.groupBy("doc_id").agg(F.max("pos").alias("last"))
            order = Window.partitionBy("doc_id").orderBy("leaf_path", "pos")
            placed = smaller.drop("title").join(inner.select("node_key", "doc_id"), "node_key").join(last, "doc_id")
            placed = placed.withColumn("new_pos", F.col("last") + F.row_number().over(order))
            kids = placed.select(
                "doc_id", F.col("new_pos").alias("pos"), F.col("leaf_pos").alias("parent_pos"), F.array_append("leaf_path", F.col("new_pos")).alias("path"), (F.col("leaf_depth") + 1).alias("depth"),
                "structure", F.col("sub_title").alias("title"), "start_index", "end_index",
            )
            kids = cut(kids)
            if kids.isEmpty():
                break
            nodes = cut(nodes.unionByName(kids))
            frontier = kids
        return nodes

    def build(self, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(nodes, failures)`` of all documents: ids, optional text, summaries, optional ``doc_description``."""
        s = self.settings
        pages = cut(pages)
        items, failures = self.section_lists(pages)
        nodes = self.assemble(items, pages)
        nodes = tree.number(nodes) if s.add_node_ids else nodes.withColumn("node_id", F.lit(None).cast("string"))
        nodes = cut(nodes.withColumn("text", F.lit(None).cast("string")))
        if s.add_node_text or s.add_summaries:
            nodes = cut(tree.add_text(nodes, pages))
        nodes = self.summarize(nodes) if s.add_summaries else nodes.withColumn("summary", F.lit(None).cast("string"))
        if s.add_doc_description:
            nodes = nodes.join(self.describe(nodes), "doc_id", "left")
        return (nodes if s.add_node_text else tree.remove_text(nodes)), failures

    def summarize(self, nodes: DataFrame) -> DataFrame:
        """Nodes with summaries; where there is no text or the call fails, null."""
        asked = self._complete(nodes.where("text is not null and text <> ''"), "summary", prompt_column(prompts.summarize, F.col("text")), ["doc_id", "pos"], text=F.col("text"))
        good = asked.where("status = 'ok'").select("doc_id", "pos", F.col("reply").alias("summary"))
        return nodes.drop("summary").join(good, ["doc_id", "pos"], "left")

    def describe(self, nodes: DataFrame) -> DataFrame:
        """``(doc_id, doc_description)`` from the tree without its texts; null where the call fails."""
        structure = tree.to_json(nodes, ("title", "start_index", "end_index", "node_id", "summary"))
        asked = self._complete(structure, "describe", prompt_column(prompts.describe, F.col("structure")), ["doc_id"], text=F.col("structure"))
        return asked.select("doc_id", F.when(F.col("status") == "ok", F.col("reply")).alias("doc_description"))

    def search(self, questions: DataFrame, nodes: DataFrame, k: int = 5, preference: str | None = None) -> DataFrame:
        """``(query_id, doc_id, thinking, node_ids)``; the rule completer scores words, others read the tree."""
        if isinstance(self.completer, RuleCompleter):
            return search(questions, nodes, k)
        view = tree.to_json(tree.search_view(nodes).withColumn("text", F.lit(None).cast("string")), ("title", "node_id", "summary"))
        asked = questions.join(view, "doc_id")
        prompt = prompt_column(lambda q, t: prompts.search(q, t, preference), F.col("question"), F.col("structure"))
        replies = self._complete(asked, "search", prompt, ["query_id", "doc_id"], question=F.col("question"), tree=F.col("structure"))
        read = node_list(repair_json(F.col("reply")))
        return replies.select("query_id", "doc_id", read["thinking"].alias("thinking"), read["node_ids"].alias("node_ids"))

    def answer(self, questions: DataFrame, nodes: DataFrame, pages: DataFrame | None, k: int = 5, preference: str | None = None) -> DataFrame:
        """``(query_id, doc_id, answer, context, citations)``.

        Only nodes that the search named are joined with pages; ``pages`` is null where the nodes hold
        their own text. Questions without context get a fixed sentence and cost no call.
        """
        found = cut(tree.resolve(self.search(questions, nodes, k, preference), nodes))
        if pages is not None:
            wanted = found.select("doc_id", "pos", "start_index", "end_index").distinct()
            texts = tree.add_text(wanted, pages).select("doc_id", "pos", "text")
            found = found.drop("text").join(texts, ["doc_id", "pos"], "left")
        contexts = cut(tree.context_and_citations(found))
        asked = contexts.join(questions, ["query_id", "doc_id"])
        replies = self._complete(
            asked, "answer", prompt_column(prompts.answer, F.col("question"), F.col("context")), ["query_id", "doc_id"],
            question=F.col("question"), context=F.col("context"),
        )
        none = F.array().cast("array<struct<node_id:string,title:string,start_page:int,end_page:int>>")
        rows = questions.select("query_id", "doc_id").join(contexts, ["query_id", "doc_id"], "left").join(replies.select("query_id", "doc_id", "reply"), ["query_id", "doc_id"], "left")
        return rows.select(
            "query_id", "doc_id", F.coalesce("reply", F.lit(NOTHING)).alias("answer"), F.coalesce("context", F.lit("")).alias("context"),
            F.coalesce("citations", none).alias("citations"),
        )
