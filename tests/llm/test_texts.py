import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


from quire.llm import leaks, normal_form, pairs, pieces, tokens, toxicity, truncation

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=0, max_size=400), st.integers(20, 90), st.integers(0, 15))
def test_pieces_lose_nothing_and_keep_the_limit(text, limit, overlap):
    parts = pieces.split_text(text, limit, overlap)
    assert all(len(p) <= limit for p in parts)
    assert parts[0] + "".join(p[min(overlap, len(q)) :] for q, p in zip(parts, parts[1:])) == text
    assert all(p.startswith(q[len(q) - min(overlap, len(q)) :]) for q, p in zip(parts, parts[1:]))


def test_pieces_end_at_natural_boundaries():
    text = "One sentence of some words stands here. " * 60
    parts = pieces.split_text(text, 300, 40)
    assert all(p.endswith(". ") for p in parts)
    assert max(map(len, parts)) - min(map(len, parts)) < 120
    sizes = [len(p) for p in pieces.split_text("x" * 1000, 300, 0)]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 300 / 8
    with pytest.raises(ValueError, match="overlap"):
        pieces.split_text("abc", 2, 2)


def test_piece_costs_equal_an_exhaustive_search():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) + rng.choice(["", ".", "\n"]) for _ in range(40))
    limit, overlap = 60, 10
    places, penalty = pieces.boundaries(text, (limit - overlap) // 8)
    room, n = limit - overlap, len(text)
    target = (n - overlap) / (1 + -(-(n - limit) // room))
    cost_of = dict(zip(places.tolist(), penalty.tolist()))
    best = {0: 0.0}
    for p in places.tolist():
        options = [best[q] + (((p - q - (overlap if q == 0 else 0)) - target) / target) ** 2 for q in best if p - q <= (limit if q == 0 else room)]
        if options:
            best[p] = min(options) + cost_of[p]
    ends = [0, *pieces.cut_points(text, limit, overlap)]
    got = sum((((b - a - (overlap if a == 0 else 0)) - target) / target) ** 2 + cost_of[b] for a, b in zip(ends, ends[1:]))
    assert got == pytest.approx(best[n])


def test_only_oversized_texts_come_out_in_pieces(spark):
    rows = [(1, "a" * 32_003, "x"), (2, "b " * 16_002, "x"), (3, None, "x"), (4, "", "x"), (None, "c" * 40_000, "x"), (2, "b " * 16_002, "x"), (5, "d" * 100_000, "x")]
    df = spark.createDataFrame(rows, "pair_id long, document_text string, piece string")
    out = pieces.pieces(df, "pair_id", "document_text").collect()
    assert {r.pair_id for r in out} == {2, 5} and all(r.piece_tokens <= 8000 for r in out)
    assert pieces.pieces(df.limit(0), "pair_id", "document_text").count() == 0


ALIKE = [("Ｆｕｌｌ wide", "Full wide"), ("café", "café"), ("soft­hy", "softhy"), ("a b", "a b"), ("ﬁne", "fine"), ("Неllo", "Hello"), ("z‍w", "zw"), ("ο", "o"), ("Ⅷ", "VIII"), ("Ꭺlpha", "Alpha"), ("αlpha", "alpha"), ("νaρor", "vapor"), ("dıgit", "digit"), ("ӏine", "line"), ("ꓡisu", "Lisu"), ("a\u3164b\uffa0c\u115f", "abc"), ("ё", "ë")]
APART = [("x²", "x2"), ("Case", "case"), ("résumé", "resume"), ("l", "I"), ("0", "O"), ("a b", "ab"), ("①", "1"), ("½", "1/2"), ("œ", "oe")]


def test_skeletons_are_equal_for_what_looks_the_same():
    assert all(normal_form.skeleton(a) == normal_form.skeleton(b) for a, b in ALIKE)
    assert all(normal_form.skeleton(a) != normal_form.skeleton(b) for a, b in APART)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_normal_forms_stay_as_they_are(text):
    once = normal_form.normal_form(text)
    assert normal_form.normal_form(once) == once and normal_form.skeleton(once) == normal_form.skeleton(text)


def test_lookalike_pairs_equal_brute_force(spark):
    base = ["Method Overview", "Ｍethod Overview", "Method Overview", "method overview", "M​ethod Overview", "Method Overview", "", None, "​"]
    rows = [(k, k % 2, t, "s") for k, t in enumerate(base * 2)] + [(0, 0, base[0], "s"), (None, 0, base[1], "s"), (99, None, base[1], "s")]
    df = spark.createDataFrame(rows, "node_key long, pair_id long, title string, scope string")
    got = {(r.id_a, r.id_b) for r in normal_form.lookalike_pairs(normal_form.digests(df, "node_key", "title", "pair_id")).collect()}
    one = {k: (p, t) for k, p, t, _ in rows if k is not None and p is not None and t}
    want = {(a, b) for a in one for b in one if a < b and one[a][0] == one[b][0] and one[a][1] != one[b][1] and normal_form.skeleton(one[a][1]) == normal_form.skeleton(one[b][1]) != ""}
    assert got == want and want
    assert normal_form.lookalike_pairs(normal_form.digests(df.limit(0), "node_key", "title")).count() == 0
    forms = {r.key: r.form for r in normal_form.forms(df.where("node_key < 9"), "node_key", "title").collect()}
    assert forms[1] == "Method Overview" and forms[7] is None and forms[6] == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_token_ids_equal_the_library(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    library = test_token_ids_equal_the_library.__dict__.setdefault("t", Tokenizer.from_file(public.path("byte_bpe_50k.json")))
    library.encode_special_tokens = True
    assert tokens.load(VOCABULARY).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_pretokens_equal_the_library():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    rng = random.Random(9)
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for text in ("a" * 30_000, "".join(rng.choice("abcdeé") for _ in range(30_000)), "<|endoftext|>" + " " * 5000):
        library.encode_special_tokens = True
        assert tokens.load(VOCABULARY).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rank_queue_pops_by_rank_then_place():
    queue, rng = tokens.RankQueue(50_256), random.Random(1)
    entries = [(rng.randrange(50_256), rng.randrange(1000)) for _ in range(3000)]
    for e in entries:
        queue.push(*e)
    out = []
    while (e := queue.pop()) is not None:
        out.append(e)
    assert out == sorted(entries)


def test_encoding_of_a_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (1, "Hello world", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    assert {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()} == {1: [15496, 995], 2: [], 3: []}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


ITEM = "The orchard near Tamin drew a faulty plan of a mechanical owl to please an impatient aunt so that a travelling choir carried away the bell of Tezaprel during the third regatta of that year"
HALF_1, HALF_2 = " ".join(ITEM.split()[:10]), " ".join(ITEM.split()[20:31])


def mangled(text):
    words = text.split()
    words[4] = words[4].upper()
    words[7] = words[7][:-1] + "x"
    return "<b>" + "</b>\n> **".join(words) + "**"


@pytest.mark.parametrize(
    ("text", "held"),
    [(ITEM, True), (mangled(ITEM), True), ("other words " * 20 + HALF_1 + " in between stands much that is of no use here at all " + HALF_2, True),
     (HALF_1, False), ("", False), ("!!", False), (ITEM.replace(" ", "\\n"), True), (" ".join(reversed(ITEM.split())), False), ("x " * 20_000 + ITEM, True)],
)
def test_leaks(text, held):
    index = leaks.Index([(5, ITEM), (6, "Quite another item of the set with words of its own that no document holds at any place whatsoever today")])
    assert [index.ids[i] for i, _ in leaks.leaked(index, leaks.Hasher(), [text])[0]] == ([5] if held else [])


FAR = " ".join(f"filler{i}" for i in range(500))
BLURRED = " ".join(w[:-1] + "qz" if i % 4 == 3 and len(w) > 4 else w for i, w in enumerate(HALF_2.split()))


@pytest.mark.parametrize(
    ("text", "held"),
    [(f"{HALF_1} {FAR} {HALF_2}", True), (f"{FAR} {HALF_1} {FAR} {FAR} {BLURRED} {FAR}", True), (f"{HALF_2} {FAR} {HALF_1}", False), (f"{HALF_1} {FAR} {HALF_1}", False),
     (f"{' '.join(ITEM.split()[5:17])} {FAR} {HALF_1} {FAR} {HALF_2}", True)],
)
def test_leaks_in_two_stretches_far_apart(text, held):
    assert [i for i, _ in leaks.leaked(leaks.Index([(5, ITEM)]), leaks.Hasher(), [text])[0]] == ([0] if held else [])


def test_blocks_find_every_fingerprint_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    for size, blocks in leaks.Index([(1, ITEM)]).blocks.items():
        assert size in leaks.window_sizes(len(ITEM.split()))
        for _ in range(100):
            row = int(rng.integers(len(blocks.prints)))
            flipped = blocks.prints[row]
            for bit in rng.choice(64, int(rng.integers(0, leaks.RADIUS + 1)), replace=False):
                flipped ^= np.uint64(1) << np.uint64(bit)
            _, _, place = blocks.hits(np.array([flipped]))
            assert blocks.place[row] in place


SHORT_ITEM = "seven quiet owls mend the broken clock by candle light"


@pytest.mark.parametrize(
    ("item", "text", "held"),
    [("owls mend broken clocks", "they say that owls mend broken clocks at night", True), ("owls mend broken clocks", "they say that owls mend nothing", False),
     ("what do owls mend when they rest", "we ask what do owls mend and why", True), (SHORT_ITEM, "at home seven quiet owls mend the house", True),
     (SHORT_ITEM, "seven quiet dogs", False), ("owls", "the owls are here", True), (SHORT_ITEM, f"{FAR} the broken clock {FAR} by candle light {FAR}", True)],
)
def test_short_items_are_found(item, text, held):
    index = leaks.Index([(1, item), (2, ITEM)])
    assert [i for i, _ in leaks.leaked(index, leaks.Hasher(), ["", text])[1]] == ([0] if held else [])


def test_windows_do_not_depend_on_chunks_or_neighbours(monkeypatch):
    import numpy as np

    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))] for _ in range(30)]
    whole = {(s, t, p): int(x) for s, ts, ps, xs in leaks.Hasher().windows(texts, [2, 6, 16]) for t, p, x in zip(ts, ps, xs)}
    assert len(whole) == sum(max(0, len(t) - s + 1) for t in texts for s in (2, 6, 16))
    monkeypatch.setattr(leaks, "CHUNK_WORDS", 7)
    assert whole == {(s, t, p): int(x) for s, ts, ps, xs in leaks.Hasher().windows(texts, [2, 6, 16]) for t, p, x in zip(ts, ps, xs)}
    one = next(iter(leaks.Hasher().windows([texts[3]], [2])))
    assert all(whole[2, 3, int(p)] == int(x) for p, x in zip(one[2], one[3])) and isinstance(one[3], np.ndarray)


def test_items_are_dealt_by_number_and_size(spark, monkeypatch):
    monkeypatch.setattr(leaks, "CHARS_PER_BLOCK", 300)
    items = spark.createDataFrame([(i, ITEM) for i in range(6)] + [(9, ITEM + " and more" * 100)], "item_id long, text string")
    assert leaks.item_blocks(items.withColumnRenamed("item_id", "item")) >= 4
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert {r.item_id for r in leaks.found(docs, items, "doc_id", "text", "item_id", "text").collect()} == set(range(6))


def test_leaks_equal_brute_force_over_the_tables(spark, data):
    from quire.llm.queries import p8_found
    from quire.runtime import table

    texts = [(r.doc_id, leaks.words(r.text)) for r in table(spark, data, "documents").where("text is not null").collect()]
    items = [(r.item_id, leaks.words(r.text)) for r in table(spark, data, "benchmark").collect()]
    want = set()
    for d, ws in texts:
        there = set(ws)
        for i, mine in items:
            if sum(w in there for w in mine) >= leaks.HALF * 0.8 * len(mine) and leaks.coverage(mine, ws) >= leaks.HALF:
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in p8_found(spark, data).collect()} == want


def test_leaks_of_a_table_with_gaps(spark):
    docs = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (3, "", 0), (None, ITEM, 0)], "doc_id long, text string, share int")
    items = spark.createDataFrame([(5, ITEM, "a"), (6, None, "a"), (7, "", "a"), (5, ITEM, "a")], "item_id long, text string, answer string")
    assert [(r.doc_id, r.item_id) for r in leaks.found(docs, items, "doc_id", "text", "item_id", "text").collect()] == [(1, 5)]
    assert leaks.found(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.found(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0


WHOLE = "The section describes the parser and explains how it handles tables. The authors compare two methods and report a gain of 3.1 points."
CUT = [WHOLE[:-12], WHOLE[:-30] + "...", WHOLE[:90] + " [truncated]", WHOLE[:-20] + "&am", WHOLE[:-25] + "(see Fig.", WHOLE[:90] + "\\u00", WHOLE[:-3] + "�", "The section describes the parser and", "The authors compare"]
KEPT = [WHOLE, WHOLE + " [4]", WHOLE + " (Parser = 3.1)", "Keywords: tables; parsers; pages", "- Tables\n- Pages", "Overview of tables with a parser", "", " ", None, "TBD", "​", "Is this all?", "本节介绍了表格。"]


def test_truncation_marks_what_was_cut(spark):
    rows = [(i, t, "m", "") for i, t in enumerate([*CUT, *KEPT])]
    rows += [(100 + i, WHOLE, "m", "") for i in range(20)] + [(None, CUT[0], "m", ""), (0, CUT[0], "m", "")]
    df = spark.createDataFrame(rows, "node_key long, summary string, model string, part string")
    found = truncation.truncated(df, "node_key", "summary")
    assert sorted(r.node_key for r in found.collect()) == list(range(len(CUT)))
    share = truncation.shares(df, found, "node_key", "summary", "model").collect()[0]
    assert share.truncated == len(CUT) and share["values"] == len(rows) - 3
    assert truncation.truncated(df.limit(0), "node_key", "summary").count() == 0


def test_a_strict_prefix_of_a_closed_sentence_was_cut_however_many_copies_are_open(spark):
    texts = ["The section describes the parser and", *["The section describes"] * 30, WHOLE]
    texts += ["- Tables of pages\n- Parsers", *["- Tables of pages\n- Parsers\n- Trees"] * 3, "- Tables of pages\n- Parsers\n- Trees and more."]
    texts += ["Results of the second study", *["Results of the second study in tables"] * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "node_key long, summary string")
    assert sorted(r.node_key for r in truncation.truncated(df, "node_key", "summary").collect()) == list(range(31))


def test_a_long_fragment_finds_its_longer_copy(spark):
    long = "Seen " + " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(400)) + "."
    texts = [" ".join(long.split()[:n]) for n in (60, 140, 300, 399)] + [long, "Seen " + "other " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "node_key long, summary string")
    got = {r.key: r.reason for r in truncation.judged(df, "node_key", "summary").collect()}
    assert got == {0: "prefix", 1: "prefix", 2: "prefix", 3: "prefix", 5: None}


def test_prefixes_equal_brute_force_over_any_ranges(spark):
    rng = random.Random(3)
    alphabet = ["a", "ab", "b", "ba", "é", "zz"]
    sentences = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows = [(None, None, None, None, s, None, rng.randint(0, 1), 1) for s in sentences[:250]]
    rows += [(i, False, False, 1, s, None, None, None) for i, s in enumerate([*sentences[150:], ""])]
    df = spark.createDataFrame(rows, truncation.PARSED.format(kind="long"))
    closed = [s for *_, s, _, n, _ in rows[:250] if n]
    want = {i: bool(s) and any(c != s and c.startswith(s) for c in closed) for i, _, _, _, s, *_ in rows[250:]}
    for partitions in ("1", "7", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.key: r.goes_on for r in truncation.continued(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == want


PAIRS = [
    ("Data", "", "empty"), ("Data", " ​", "empty"), ("Data", "N/A", "empty"), ("Data", "--", "empty"), ("Data", None, None),
    ("Data", "I'm sorry, but I can't help with that request.", "refusal"), ("Data", "Je ne peux pas résumer cette section.", "refusal"),
    ("Data", "Lo siento, pero no puedo resumir esta sección.", "refusal"), ("Data", "Leider kann ich bei dieser Anfrage nicht helfen.", "refusal"),
    ("Data", 'The section studies how assistants say "I cannot help with that" and the rate of such replies.', None),
    ("Data", "The authors are sorry to report that the parser cannot be reproduced on the tables.", None),
    ("Effect of tables", "effect of tables", "copy"), ("Effect of tables", "What is Effect of Tables about?", "copy"), ("Effect of tables", "Section: Effect of tables.", "copy"),
    ("Effect of tables", "What is Effect of tables about? The authors show that the tables of the corpus are read by the parser.", None),
    ("Data", "Der Abschnitt beschreibt den Aufbau und erläutert die Behandlung von Tabellen mit dem Verfahren.", "language"), ("Data", "本节介绍了如何处理脚注和表格。", "language"),
    ("Data", "The section describes the parser and explains how it handles tables. The authors comp", "truncated"),
    (None, "The section describes the parser and explains how it handles tables.", None),
    ("Data", "Keywords: tables; pages; parsers", None),
]


def test_defects(spark):
    rows = [(i, 1, t, s, "x") for i, (t, s, _) in enumerate(PAIRS)]
    rows += [(50 + i, 1, "The results of the study", "The section is about the data of the study and how it was collected by the authors.", "x") for i in range(6)]
    rows += [(0, 1, "Data", "", "x"), (None, 1, "Data", "", "x"), (70, None, "Data", "", "x")]
    df = spark.createDataFrame(rows, "node_key long, pair_id long, title string, summary string, cluster string")
    got = {r.node_key: r.defect for r in pairs.defects(df, "node_key", "pair_id", "title", "summary").collect()}
    assert got == {**{i: d for i, (_, _, d) in enumerate(PAIRS) if d}, 70: "empty"}
    assert pairs.defects(df.limit(0), "node_key", "pair_id", "title", "summary").count() == 0


def test_templates_are_refusals_whatever_their_words_and_length(spark):
    told = "The section describes the parser of number {} and explains how it handles tables of the year {}."
    rows = [(i, f"Study of {w}", told.format(w, i)) for i, w in enumerate(["ants", "bees", "cats", "dogs", "emus", "fish"])]
    bare = "Nothing on {} has been recorded by this office, and none will be."
    rows += [(10 + i, f"Notes on {w}", bare.format(f"Notes on {w}")) for i, w in enumerate(["oak", "elm", "ash", "fir"])]
    heads = ["Overview of page policy with a layered outline"] * 4 + ["Overview of the access policy, "] * 4
    rows += [(30 + i, f"Part {w}", t) for i, (w, t) in enumerate(zip("abcdefgh", heads))]
    policy = "The size of the access policy and the {} retries follow. The study of {} comes next and shows gains."
    rows += [(40 + i, f"On {w}", policy.format(i, w)) for i, w in enumerate(["iron", "zinc", "lead", "gold"])]
    long = "I'm sorry, I cannot summarise this section. " + "The reasons for it are many and are laid down in the rules of the house. " * 8
    rows += [(20, "Trees", long.strip()), (21, "Rivers", "Thank you for the question. I am unable to answer it.")]
    df = spark.createDataFrame([(k, 1, t, s) for k, t, s in rows], "node_key long, pair_id long, title string, summary string")
    got = {r.node_key: r.defect for r in pairs.defects(df, "node_key", "pair_id", "title", "summary").collect()}
    assert got == {10: "refusal", 11: "refusal", 12: "refusal", 13: "refusal", 20: "refusal", 21: "refusal"}


def test_links_connect_what_is_similar_and_templates_cost_little():
    import time

    rng = random.Random(2)
    base = [f"w{i}" for i in range(30)]
    for _ in range(20):
        texts = [" ".join(base[rng.randrange(4) : rng.randrange(20, 31)] + [f"t{rng.randrange(3)}"]) for _ in range(60)]
        held = [pairs.shingles(t) for t in texts]
        assert classes(range(60), pairs.links(held)) == classes(range(60), [(a, b) for a in range(60) for b in range(a) if similar(texts[a], texts[b])])
    held = [pairs.shingles(" ".join([*base, f"x{i}"])) for i in range(20_000)]
    began = time.perf_counter()
    assert len(pairs.links(held)) == 19_999 and time.perf_counter() - began < 5


def test_openings_cluster_by_verified_similarity(spark):
    long = "no summary of this text can be given because the policy of the service does not allow it at all today"
    texts = [long, long + " sir", "quite another opening that has nothing to do with the first one", "i cannot", "i cannot"]
    df = spark.createDataFrame([(t,) for t in set(texts)], "opening string")
    got = {r.opening: r.cluster for r in pairs.opening_clusters(df.distinct()).collect()}
    assert set(got) == {long, long + " sir"} and len(set(got.values())) == 1


def similar(a, b):
    x, y = (set(pairs.shingles(t).tolist()) for t in (a, b))
    return len(x & y) >= pairs.SIMILARITY * len(x | y)


def classes(members, linked):
    of = {m: m for m in members}
    for a, b in linked:
        of = {m: of[b] if c == of[a] else c for m, c in of.items()}
    groups = {}
    for m, c in of.items():
        groups.setdefault(c, set()).add(m)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("block", [2_000, 3])
def test_opening_clusters_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = random.Random(7)
    texts = set()
    for family in range(12):
        base = [f"w{family}x{i}" for i in range(40)]
        for _ in range(12):
            start, end = rng.choice([(0, 40), (0, 36), (0, 24), (4, 40), (16, 40), (8, 34)])
            tail = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
            texts.add(" ".join(base[start:end] + tail))
    texts = sorted(texts)
    linked = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if similar(a, b)]
    got = {}
    for r in pairs.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect():
        got.setdefault(r.cluster, set()).add(r.opening)
    assert {frozenset(g) for g in got.values()} == classes(texts, linked)


def test_a_dissimilar_smallest_opening_hides_no_link(spark):
    rng = random.Random(0)
    base = [f"w{i}" for i in range(44)]
    texts = [" ".join(base), " ".join([*base[:36], "t0"])]
    shapes = [(rng.choice([0, 1, 2, 3]), rng.choice([10, 11, 12, 13])) for _ in range(40)]
    texts += [" ".join(base[start:] + [f"r{rng.randrange(10**6)}" for _ in range(more)]) for start, more in shapes]
    linked = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if similar(a, b)]
    got = {}
    for r in pairs.opening_clusters(spark.createDataFrame([(t,) for t in texts], "opening string")).collect():
        got.setdefault(r.cluster, set()).add(r.opening)
    assert {frozenset(g) for g in got.values()} == classes(texts, linked)


def test_disguises_fall_away():
    assert toxicity.plain("You 1d10t") == toxicity.plain("you IDIOT") == toxicity.plain("You iddddiot") == toxicity.plain("you i.d.i.o.t") == "you idiot"
    assert toxicity.plain("n-a-k-e-d r a t s") == "naked rats" and "*" in toxicity.plain("s**t")
    assert toxicity.plain("Model-2 got 31.8 in 2024") == "N got 0 in 0".lower()


def corpus(seed, toxic):
    rng = random.Random(seed)
    calm = ["the parser reads {} pages of tables", "we leave the {} to later work", "results on {} improve a little", "thanks, that fixed it for me and the {}", "each {} is merged with the others in the end", "figure two shows how {} changes over time", "earlier work on {} does not depend on it"]
    rude = ["you are a stupid {} and nobody likes you", "shut up you worthless {}", "only an idiot would write such {}"]
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "re", "tu", "san", "vor"]) for _ in range(3))
    lines = [rng.choice(calm).format(word()) + "." for _ in range(5)]
    if toxic:
        lines[rng.randrange(5)] = rng.choice(rude).format(word()).capitalize() + "."
    return " ".join(lines)


def test_toxic_documents_are_told_apart_despite_wrong_labels():
    labels = [int(i % 4 == 0) for i in range(400)]
    texts = [corpus(i, y) for i, y in enumerate(labels)]
    noisy = [y if i % 25 else 1 - y for i, y in enumerate(labels)]
    model = toxicity.train(texts, noisy)
    held = [(corpus(1000 + i, i % 2), i % 2) for i in range(100)]
    best = [max(toxicity.scores(*model, toxicity.grams(toxicity.sentences(t)))) for t, _ in held]
    right = sum((b >= toxicity.THRESHOLD) == bool(y) for b, (_, y) in zip(best, held))
    assert right >= 95


def test_scores_and_rates(spark):
    docs = spark.createDataFrame([(i, corpus(i, i % 4 == 0), "s" if i % 2 else None, 0.0) for i in range(200)] + [(900, None, "s", 0.0), (901, "", "s", 0.0), (902, " ", "t", 0.0), (None, "x", "s", 0.0), (1, corpus(1, False), "s", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(3, None), (900, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert len(rows) == 203 and rows[900] == rows[901] == rows[902] == 0.0
    assert sum((rows[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(200)) >= 190
    rate = {r.source: r for r in toxicity.rates(docs, scored).collect()}
    assert rate["s"].documents + rate[None].documents + rate["t"].documents == 203 and rate["t"].rate == 0.0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score > 0.1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_long_texts_are_read_whole():
    text = "calm words stand here. " * 30_000 + "the end is not."
    assert toxicity.sentences(text)[-1] == "the end is not."
    assert truncation.ending("a " * 200_000 + "end").open
    assert len(re.findall("x", pairs.plain("X" * 50_000))) == 50_000
