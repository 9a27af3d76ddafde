import json

import pytest
from pyspark.sql import functions as F

from quire.completion import base, folds, http, offline, prompts
from quire.config import MODES, Settings
from quire.plans import training
from quire.plans.build import TreeBuilder
from quire.sources import pages as page_source
from quire.sources import records
from quire.streaming import ingest

PAGES = "doc_id long, page_number int, text string, token_count int"
PAPER = ["1 Introduction\nwords", "more\n2 Methods\nhow", "2.1 Data\nwhat", "3 Results\nnumbers", "end"]


def paper(spark, doc=1, texts=PAPER):
    return spark.createDataFrame([(doc, n, t, len(t) // 4) for n, t in enumerate(texts, 1)], PAGES)


def test_a_paper_becomes_a_tree(spark):
    nodes, failures = TreeBuilder().build(paper(spark))
    rows = nodes.orderBy("node_id").collect()
    assert [(r.node_id, r.title, r.start_index, r.end_index, r.depth) for r in rows] == [
        ("0001", "Introduction", 1, 2, 1), ("0002", "Methods", 2, 3, 1), ("0003", "Data", 3, 4, 2), ("0004", "Results", 4, 5, 1)
    ]
    assert all(r.text is None and r.summary for r in rows) and failures.count() == 0


def test_documents_that_fit_no_mode_are_reported(spark):
    nodes, failures = TreeBuilder().build(paper(spark, 2, ["no sections", "at all"]))
    assert nodes.count() == 0 and [r.doc_id for r in failures.collect()] == [2]


def test_large_leaves_are_divided_within_their_range(spark):
    texts = ["1 One\nstart"] + [f"page {n}" for n in range(2, 8)] + ["2 Two\nx"]
    builder = TreeBuilder(Settings(max_pages_per_node=2, max_tokens_per_node=1, add_summaries=False))
    items = spark.createDataFrame([(1, 1, "1", "One", 1), (1, 2, "2", "Two", 8)], "doc_id long, pos int, structure string, title string, physical_index int")
    numbered = [t.replace("page 4", "1.1 Inner\ntext") for t in texts]
    nodes = builder.assemble(items, paper(spark, 1, numbered))
    rows = nodes.collect()
    got = {(r.title, r.depth): (r.start_index, r.end_index) for r in rows}
    assert got["Inner", 2] == (4, 8) and got["One", 1] == (1, 8) and got["Two", 1] == (8, 8)
    by_pos = {r.pos: r for r in rows}
    assert all(by_pos[r.parent_pos].start_index <= r.start_index <= r.end_index <= by_pos[r.parent_pos].end_index for r in rows if r.parent_pos)


def test_questions_get_answers_with_citations(spark):
    builder = TreeBuilder()
    pages = paper(spark)
    nodes, _ = builder.build(pages)
    asked = spark.createDataFrame([(1, 1, "what methods"), (2, 1, "zzz")], "query_id long, doc_id long, question string")
    rows = {r.query_id: r for r in builder.answer(asked, nodes, pages).collect()}
    assert rows[1].citations[0].title == "Methods" and "2 Methods" in rows[1].context
    assert rows[2].answer.startswith("I could not find") and rows[2].citations == []


def test_tables_of_contents_are_found(spark):
    table = "1 Alpha .... 2\n2 Beta .... 3\n3 Gamma .... 4"
    probe = TreeBuilder().detect_toc(paper(spark, 1, [table, "1 Alpha", "2 Beta"]).union(paper(spark, 2))).collect()
    got = {r.doc_id: (r.mode, r.toc_page_list) for r in probe}
    assert got == {1: (MODES[0], [1]), 2: (MODES[2], None)}


def test_a_scripted_model_builds_corrects_and_answers(spark):
    def send(url, body, headers, timeout):
        import json
        import re

        prompt = body["messages"][-1]["content"]
        squeeze = lambda t: re.sub(r"\s", "", t).lower()
        if prompt.startswith("Does the page below"):
            reply = {"thinking": "", "toc_detected": "no"}
        elif prompt.startswith("List the sections"):
            rows = [("1", "Introduction", 1), ("2", "Methods", 2), ("2.1", "Data", 3), ("3", "Results", 1)]
            reply = [{"structure": s, "title": t, "physical_index": f"<physical_index_{n}>"} for s, t, n in rows]
        elif prompt.startswith("Does this section appear") or prompt.startswith("Does this section begin"):
            title, page = re.search(r"Section: (.*)\n\nPage:\n([\s\S]*)", prompt).groups()
            field = "answer" if "appear" in prompt[:30] else "start_begin"
            reply = {"thinking": "", field: "yes" if squeeze(title) in squeeze(page) else "no"}
        elif prompt.startswith("On which of these pages"):
            reply = {"thinking": "", "physical_index": "<physical_index_4>"}
        elif prompt.startswith("Which nodes"):
            reply = {"thinking": "by title", "node_list": ["0004", "9999", "0002"]}
        else:
            return {"choices": [{"message": {"content": "Some words."}, "finish_reason": "stop"}]}
        return {"choices": [{"message": {"content": "```json\n" + json.dumps(reply) + "\n```"}, "finish_reason": "stop"}]}

    backend = http.compatible("http://none", "m")
    builder = TreeBuilder(completer=http.HttpCompleter(backend, retries=1, delay=0, send=send))
    nodes, failures = builder.build(paper(spark))
    rows = nodes.orderBy("node_id").collect()
    assert [(r.title, r.start_index, r.end_index) for r in rows] == [("Introduction", 1, 1), ("Methods", 2, 2), ("Data", 3, 3), ("Results", 4, 5)]
    assert all(r.summary == "Some words." for r in rows) and failures.count() == 0
    asked = spark.createDataFrame([(1, 1, "which results?")], "query_id long, doc_id long, question string")
    row = builder.answer(asked, nodes, paper(spark)).collect()[0]
    assert row.answer == "Some words." and [c.title for c in row.citations] == ["Results", "Methods"]


def recorder(answers):
    """A fake backend that keeps every prompt in a folder, and replies by the first words of it."""

    def send(url, body, headers, timeout):
        import hashlib
        from pathlib import Path

        prompt = body["messages"][-1]["content"]
        (Path(url.split("/", 2)[2].removesuffix("/chat/completions")) / hashlib.md5(prompt.encode()).hexdigest()).write_text(prompt)
        for start, reply in answers.items():
            if prompt.startswith(start):
                if reply is None:
                    raise OSError("the line is down")
                return {"choices": [{"message": {"content": reply if isinstance(reply, str) else json.dumps(reply)}, "finish_reason": "stop"}]}
        raise AssertionError(prompt[:60])

    return send


ANSWERS = {
    "Does the page below": {"toc_detected": "yes"}, "Copy the full": "1 Alpha\n2 Beta", "Does this table of contents give": {"page_index_given_in_toc": "yes"},
    "Give each entry": [{"structure": "1", "title": 'A "quoted" {title}', "physical_index": "<physical_index_2>"}, {"structure": "2", "title": "Beta", "physical_index": 1}, {"structure": "3", "title": "C", "physical_index": 1}],
    "Does this section appear": {"answer": "yes"}, "Does this section begin": {"start_begin": "yes"}, "Describe in a few": "Said.", "Describe in one": "One sentence.",
    "Which nodes": {"thinking": "t", "node_list": ["0002"]}, "Answer the question": "An answer.",
}


def prompts_in(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_every_stage_sends_its_texts_as_they_are(spark, tmp_path):
    backend = http.compatible(f"http://{tmp_path}", "m")
    builder = TreeBuilder(Settings(add_doc_description=True, max_concurrent_llm_calls=2), http.HttpCompleter(backend, retries=1, delay=0, send=recorder(ANSWERS)), count_requests=True)
    assert builder.completer.inflight == 2
    text = ['Contents "x" \\u0000 [[quire]]', "A page {0} %s"]
    pages = paper(spark, 1, text)
    nodes, failures = builder.build(pages)
    rows = nodes.orderBy("node_id").collect()
    assert failures.count() == 0 and {r.doc_description for r in rows} == {"One sentence."} and len(rows) == 4
    asked = spark.createDataFrame([(1, 1, 'which "part"?')], "query_id long, doc_id long, question string")
    row = builder.answer(asked, nodes, pages).collect()[0]
    assert row.answer == "An answer." and len(row.citations) == 1
    sent = prompts_in(tmp_path)
    tagged = "".join(f"<physical_index_{n}>\n{t}\n<physical_index_{n}>\n\n" for n, t in enumerate(text, 1))
    items = [("A \"quoted\" {title}", 1), ("Beta", 0), ("C", 0)]
    with_ranges = tree_json([(r.title, r.start_index, r.end_index, r.node_id, r.summary) for r in rows], ("title", "start_index", "end_index", "node_id", "summary"))
    searched = tree_json([(r.title, r.node_id, r.summary) for r in rows], ("title", "node_id", "summary"))
    want = [prompts.toc_page(t) for t in text] + [prompts.extract_toc("\n".join(text)), prompts.detect_page_index("1 Alpha\n2 Beta"), prompts.index_toc("1 Alpha\n2 Beta", tagged)]
    want += [prompts.title_appears(t, text[p]) for t, p in items] + [prompts.title_at_start(t, text[p]) for t, p in items]
    want += [prompts.describe(with_ranges), prompts.search('which "part"?', searched), prompts.answer('which "part"?', row.context)]
    assert set(want) <= set(sent)
    assert {p for p in sent if not p.startswith("Describe in a few")} == set(want)
    assert sum(builder.requested.values()) == len(sent)


def tree_json(rows, fields):
    return json.dumps([dict(zip(fields, r)) for r in rows], separators=(",", ":"), ensure_ascii=False)


def test_prompts_without_their_texts_are_refused():
    from quire.plans.build import prompt_column

    for build in (lambda a, b: a, lambda a, b: b + a, lambda a, b: a + a + b, lambda a, b: json.dumps({"\x00": a})):
        with pytest.raises(ValueError, match="does not hold"):
            prompt_column(build, F.lit("x"), F.lit("y"))


def test_one_completer_serves_the_folds_and_their_errors_are_kept(spark, tmp_path):
    answers = {"Does the page below": {"toc_detected": "no"}, "List the sections": None}
    backend = http.compatible(f"http://{tmp_path}", "m")
    nodes, failures = TreeBuilder(completer=http.HttpCompleter(backend, retries=1, delay=0, send=recorder(answers))).build(paper(spark))
    error = failures.collect()[0].error
    assert nodes.count() == 0 and "no_toc: RuntimeError" in error and "the line is down" in error
    assert any(p.startswith("List the sections") for p in prompts_in(tmp_path))
    nothing = spark.createDataFrame([], "req_id string, text string, finish_reason string")
    error = TreeBuilder(completer=offline.ReplayCompleter(nothing)).build(paper(spark))[1].collect()[0].error
    assert "no recorded reply for first_sections" in error


def test_a_local_model_answers_every_stage(spark):
    def generate(messages):
        if messages[-1]["content"].startswith("List the sections"):
            return base.Reply('[{"structure": "1", "title": "Introduction", "physical_index": 1}]', "stop")
        if "broken" in messages[-1]["content"]:
            raise OSError("no")
        return base.Reply('{"toc_detected": "no", "answer": "yes", "start_begin": "no"}', "stop")

    nodes, failures = TreeBuilder(Settings(add_summaries=False), http.LocalCompleter(generate)).build(paper(spark))
    assert [r.title for r in nodes.collect()] == ["Introduction"] and failures.count() == 0
    done = http.LocalCompleter(generate).complete(requests(spark, ["a", "broken", "a"])).collect()
    assert {r.req_id: r.status for r in done} == {"a": "ok", "broken": "error"}


def test_first_children_that_repeat_their_leaf_are_left_out(spark):
    texts = ["1 One\nstart"] + [f"page {n}" for n in range(2, 6)] + ["1 One\nagain", "1.1 One\nlast"]
    builder = TreeBuilder(Settings(max_pages_per_node=2, max_tokens_per_node=1, add_summaries=False))
    items = spark.createDataFrame([(1, 1, "1", "\u00a0One ", 1)], "doc_id long, pos int, structure string, title string, physical_index int")
    rows = builder.assemble(items, paper(spark, 1, texts)).collect()
    assert [(r.title.strip(), r.depth) for r in rows] == [("One", 1)]


def test_jobs_write_pairs_once_and_examples(spark, tmp_path):
    from quire.plans import batch

    for name in ("a", "b", "c"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.pdf").write_bytes(b"%PDF-1.4 x" if name != "c" else b"not one")
    readers = lambda: [lambda data: list(PAPER)]
    out = [str(tmp_path / n) for n in ("good", "bad", "progress")]
    first = batch.run_batch(spark, str(tmp_path / "in"), *out, limit=2, readers=readers).collect()[0]
    assert (first.processed, first.errors, first.skipped) == (2, 0, 1)
    second = batch.run_batch(spark, str(tmp_path / "in"), *out, readers=readers).collect()[0]
    assert (second.processed, second.errors, second.skipped) == (0, 1, 2)
    assert batch.run_batch(spark, str(tmp_path / "in"), *out, readers=readers).collect()[0].total == 3
    pairs = records.read_training(spark, out[0], lines=True)
    rows = {r.arxiv_id: r for r in pairs.collect()}
    assert set(rows) == {"a", "b"} and len(pairs.collect()) == 2 and rows["a"].page_count == 5 and rows["a"].document_text == "\n\n".join(PAPER)
    assert json.loads(rows["a"].tree)["doc_name"] == "a" and json.loads(rows["a"].tree)["structure"][0]["title"] == "Introduction"
    counts = {(r.kind, r.split): r.examples for r in batch.write_examples(spark, pairs, str(tmp_path / "examples")).collect()}
    assert counts == {("treegen", "train"): 1, ("treegen", "eval"): 1, ("treesearch", "train"): 36, ("treesearch", "eval"): 4}
    assert records.read_examples(spark, str(tmp_path / "examples" / "treesearch" / "train")).count() == 36


def test_providers_are_compared(spark):
    from quire.plans import batch

    class Broken(base.Completer):
        name = "broken"

        def complete(self, requests):
            raise OSError("no")

    rows = {r.provider: r for r in batch.compare_providers(paper(spark), {"openai": offline.RuleCompleter(), "broken": Broken()}).collect()}
    assert rows["openai"].nodes == 4 and rows["openai"].depth == 2 and rows["openai"].requests > 10 and rows["openai"].cost == "$0.0002"
    assert rows["broken"].error == "OSError: no" and rows["broken"].cost is None


def test_folds():
    groups = ["<physical_index_1>\n1 A\n<physical_index_1>\n\n", "<physical_index_2>\n1 A\n2 B\n<physical_index_2>\n\n"]
    assert [i["title"] for i in folds.fold_no_toc(groups, folds.rule_ask)] == ["A", "B"]
    assert [i["physical_index"] for i in folds.fold_no_pages("1 A .. 1\n2 B .. 2", groups, folds.rule_ask)] == ["<physical_index_1>", "<physical_index_2>"]

    def broken(stage, prompt, inputs):
        if stage != "first_sections":
            raise OSError("down")
        return '[{"structure": "1", "title": "A", "physical_index": 1}]'

    assert len(folds.fold_no_toc(groups, broken)) == 1


def test_retry_and_continuation():
    calls = []

    def flaky(messages, limit):
        calls.append(messages)
        if len(calls) < 3:
            raise OSError("try again")
        return base.Reply("done", "stop")

    assert base.with_retry(flaky, [], "x", delay=0).text == "done" and len(calls) == 3
    with pytest.raises(RuntimeError, match=r"\[x\] Failed after 2 attempts: OSError"):
        base.with_retry(lambda m, n: (_ for _ in ()).throw(OSError("no")), [], "x", retries=2, delay=0)
    parts = iter([base.Reply("a", "length"), base.Reply("b", "length"), base.Reply("c", "stop")])
    assert base.with_continuation(lambda m, n: next(parts), "p", "x", delay=0) == base.Reply("abc", "stop")


def test_backends_speak_their_formats(monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    seen = {}

    def chat(url, body, headers, timeout):
        seen.update(url=url, body=body, headers=headers)
        return {"choices": [{"message": {"content": " hi "}, "finish_reason": "stop"}]}

    assert http.call(http.BACKENDS["openai"], [{"role": "user", "content": "q"}], None, chat) == base.Reply("hi", "stop")
    assert seen["url"].endswith("/chat/completions") and seen["body"]["temperature"] == 0.0
    monkeypatch.setenv("ANTHROPIC_API_KEY", "k")
    cut = lambda *a: {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "stop_reason": "max_tokens"}
    assert http.call(http.BACKENDS["claude"], [], None, cut) == base.Reply("ab", "length")
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    with pytest.raises(ValueError, match="GROQ_API_KEY"):
        http.call(http.BACKENDS["groq"], [], None, chat)
    assert http.is_available(http.with_model("ollama", "qwen"), lambda url: {"models": [{"name": "qwen2.5:7b"}]})


def requests(spark, prompts_):
    rows = [(p, 1, "s", None, p, {}) for p in prompts_]
    return spark.createDataFrame(rows, "req_id string, doc_id long, stage string, key string, prompt string, inputs map<string,string>")


def test_http_completions_are_rows_even_when_they_fail(spark):
    send = lambda url, body, headers, timeout: (_ for _ in ()).throw(OSError("no")) if body["messages"][-1]["content"] == "bad" else {"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}, "finish_reason": "stop"}]}
    done = http.HttpCompleter(http.compatible("http://x", "m"), retries=1, delay=0, send=send).complete(requests(spark, ["a", "bad", "a"])).collect()
    assert {r.req_id: (r.text, r.status) for r in done} == {"a": ("A", "ok"), "bad": (None, "error")} and len(done) == 2


def test_offline_completers(spark):
    asked = requests(spark, ["a", "b"])
    recorded = spark.createDataFrame([("a", "yes", "stop"), ("a", "yes", "stop")], "req_id string, text string, finish_reason string")
    assert {r.req_id: r.status for r in offline.ReplayCompleter(recorded).complete(asked).collect()} == {"a": "ok", "b": "miss"}
    assert {r.status for r in offline.RuleCompleter().complete(asked).collect()} == {"error"}


def test_prompts_ask_for_what_is_read():
    assert "physical_index" in prompts.first_sections("x") and "node_list" in prompts.search("q", [], "hint") and "hint" in prompts.search("q", [], "hint")
    assert '"answer"' in prompts.title_appears("t", "p") and "start_begin" in prompts.title_at_start("t", "p")


def test_pdf_pages_and_their_gate(spark, tmp_path):
    assert page_source.is_mostly_empty([]) and page_source.is_mostly_empty([" "] * 8 + ["long enough text"] * 2) and not page_source.is_mostly_empty(["", "long enough text"])
    first, second = (lambda b: ["", ""]), (lambda b: ["a long page of text", "b"])
    assert page_source.page_texts(b"", [first, second])[0].startswith("a long")
    for bad, message in (("x.txt", "Expected"), (str(tmp_path / "no.pdf"), "not found"), (3, "must be")):
        with pytest.raises(ValueError, match=message):
            page_source.check_source(bad)
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    readers = lambda: [lambda data: ["page \ud800 one", "two"]]
    rows = page_source.read_pdf(spark, str(tmp_path), readers=readers).collect()
    assert {(r.doc_name, r.page_number) for r in rows} == {("a", 1), ("a", 2), ("b", None)}
    assert next(r for r in rows if r.page_number == 1).text == "page ? one"


def test_papers_come_from_a_feed(spark):
    from quire.sources import feed

    def get(url):
        if "query?" in url:
            if "cat:cs.LG" in url:
                raise OSError("no answer")
            start = int(url.split("start=")[1].split("&")[0])
            names = [f"2401.{start + n:05d}v1" for n in range(int(url.split("max_results=")[1].split("&")[0]))]
            entry = '<entry><id>http://arxiv.org/abs/{0}</id><title>On\n {0}</title>{1}</entry>'
            link = '<link type="application/pdf" href="http://x/{0}"/>'
            return ('<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entry.format(n, link.format(n) if i else "") for i, n in enumerate(names)) + "</feed>").encode()
        return {"00000v1": b"%PDF-1", "00001v1": b"<html>", "00002v1": b"%PDF-long"}[url[-7:]]

    listed = feed.list_papers(spark, 60, ("cs.AI", "cs.LG"), get, 0).collect()
    good = [r for r in listed if r.error is None]
    assert len(good) == 60 and good[0].title == "On 2401.00000v1" and good[0].url == "https://arxiv.org/pdf/2401.00000v1" and good[1].url == "http://x/2401.00001v1"
    assert [r.error for r in listed if r.error] == ["OSError: no answer"] * 2
    papers = spark.createDataFrame([(r.arxiv_id, r.url) for r in good[:3]] * 2 + [(None, "x")], "arxiv_id string, url string")
    readers = lambda: [lambda data: ["page"] * (40 if b"long" in data else 2)]
    got = {r.arxiv_id: r for r in feed.download(papers, get, 0, readers=readers).collect()}
    assert len(got) == 3 and got["2401.00000v1"].pages == 2 and got["2401.00001v1"].error == "ValueError: not a PDF file" and got["2401.00002v1"].error == "ValueError: more than 30 pages"
    files = feed.download(papers, get, 0, readers=readers).where("error is null").select(F.xxhash64("arxiv_id").alias("doc_id"), F.col("arxiv_id").alias("doc_name"), "content")
    assert [r.page_number for r in page_source.pdf_pages(files, readers=readers).orderBy("page_number").collect()] == [1, 2]


def test_markdown_files_and_records(spark, tmp_path):
    (tmp_path / "n.md").write_text("# T\nx")
    assert [(r.doc_name, r.content) for r in page_source.read_markdown(spark, str(tmp_path)).collect()] == [("n", "# T\nx")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p.json").write_text(json.dumps({"arxiv_id": "1", "document_text": "d", "page_count": 2, "tree": {"structure": []}, "metadata": {"model": "m"}}, indent=1))
    row = records.read_training(spark, str(tmp_path / "t")).collect()[0]
    assert (row.arxiv_id, row.page_count, row.metadata.model) == ("1", 2, "m")
    results = spark.createDataFrame([("1", "d", None, 1.0), ("2", None, "TimeoutError: ", 300.0)], "arxiv_id string, document_text string, error string, elapsed_seconds double")
    records.write_results(results, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert [r.error for r in records.read_errors(spark, str(tmp_path / "bad")).collect()] == ["TimeoutError: "]
    assert records.progress(results, 3).collect()[0] == (1, 1, 3, 5)
    records.save_progress(results, str(tmp_path / "progress"), 3)
    assert spark.read.json(str(tmp_path / "progress")).collect()[0].total == 5
    docs = spark.createDataFrame([("1",), ("2",), ("3",)], "arxiv_id string")
    assert [r.arxiv_id for r in records.pending(docs, results.where("error is null"), results.where("error is not null"), "arxiv_id", 5).collect()] == ["3"]


def test_examples_and_split(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "0001", "A", "s"), (1, "0002", "B", None)], "doc_id long, node_id string, title string, summary string")
    made = training.search_examples(nodes, spark.createDataFrame([(1, "[]")], "doc_id long, structure string")).collect()
    assert len(made) == len(training.QUESTIONS) and json.loads(made[0].messages[2].content)["node_list"] == ["0001"]
    rows = spark.range(100)
    parts = training.split(rows, F.col("id"))
    assert training.split(rows.limit(0), F.col("id")).count() == 0 and training.split(rows.limit(1), F.col("id")).where("split = 'eval'").count() == 1
    assert parts.where("split = 'eval'").count() == 10 and parts.exceptAll(training.split(rows, F.col("id"))).count() == 0
    docs = spark.createDataFrame([(1, 'a "q"', "t" * 50, "[]")], "doc_id long, doc_name string, document_text string, structure string")
    (tmp_path / "e.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "q"}]}) + "\n\n")
    assert records.read_examples(spark, str(tmp_path / "e.jsonl")).collect()[0].messages[0].content == "q"
    assert json.loads(training.build_examples(docs).collect()[0].messages[2].content) == {"doc_name": 'a "q"', "structure": []}


def test_documents_stream_through_the_pipeline_once(spark, tmp_path):
    source = tmp_path / "in"
    schema = "doc_id long, text string, source string, fetched_at timestamp_ntz"
    make = lambda doc: spark.createDataFrame([(doc, "1 A\nx\ny\nz\n2 B\nw", "s", None)], schema)
    make(1).write.parquet(str(source / "a"))
    arriving = lambda: ingest.document_stream(spark, str(source / "*"), schema)
    out, bad, mark = (str(tmp_path / n) for n in ("nodes", "bad", "mark"))
    ingest.build_trees(arriving(), out, bad, mark).awaitTermination(120)
    make(2).write.parquet(str(source / "b"))
    ingest.build_trees(arriving(), out, bad, mark).awaitTermination(120)
    got = spark.read.parquet(out).select("doc_id", "title").collect()
    assert {(r.doc_id, r.title) for r in got} == {(1, "A"), (1, "B"), (2, "A"), (2, "B")} and len(got) == 4


def test_windows_count_documents_by_event_time(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select * from values (1L, 's', timestamp_ntz'2026-01-01 00:10:00'), (2L, 's', timestamp_ntz'2026-01-01 00:50:00'), (3L, 's', timestamp_ntz'2026-01-01 09:00:00') t(doc_id, source, fetched_at)").write.parquet(source)
    seen = []
    counts = ingest.windowed_counts(ingest.document_stream(spark, source, "doc_id long, source string, fetched_at timestamp_ntz"), "fetched_at", "source")
    ingest.write_windows(counts, lambda df, n: seen.extend(df.collect()), str(tmp_path / "mark")).awaitTermination(120)
    assert [r.documents for r in seen if r.window_start.hour == 0] == [2]
