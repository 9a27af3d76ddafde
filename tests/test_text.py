import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import json_text, text


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_token_counts(spark):
    assert column(spark, ["", "x" * 400, "ab", None, "é" * 9], text.count_tokens) == [0, 100, 1, None, 2]
    assert column(spark, ["", "ab"], lambda c: text.provider_tokens(c, "base")) == [0, 0]
    assert column(spark, ["", "ab"], lambda c: text.provider_tokens(c, "groq")) == [1, 1]


def test_exact_counts_with_a_public_vocabulary(spark):
    from pathlib import Path

    import pytest

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not (text.can_count_exactly() and Path(path).exists()):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None)], "id long, t string")
    assert {r.id: r.tokens for r in text.exact_tokens(df, "id", "t", path).collect()} == {1: 2, 2: 0, 3: None}


def test_strip_knows_all_white_space(spark):
    values = [" \t\n a b  ", "\x1c\x85x\xa0", "", None]
    assert column(spark, values, text.strip) == ["a b", "x", "", None]


def test_truncation_and_tags(spark):
    assert column(spark, ["a" * 60, "short"], lambda c: text.truncate_text(c, 50)) == ["a" * 47 + "...", "short"]
    assert column(spark, ["a" * 9], lambda c: text.truncate_for_training(c, 2)) == ["aaaaaaaa\n[truncated]"]
    assert column(spark, ["p"], lambda c: text.tag_page(c, F.lit(3))) == ["<physical_index_3>\np\n<physical_index_3>\n\n"]
    assert column(spark, ["a  \t b\n\n\n\nc "], text.normalize_whitespace) == ["a b\n\nc"]


def test_ids_are_padded_but_never_cut(spark):
    assert [r.x for r in spark.range(9999, 10001).select(text.pad_id(F.col("id")).alias("x")).collect()] == ["9999", "10000"]


def test_costs(spark):
    got = column(spark, ["openai", "ollama", "other"], lambda c: text.estimated_cost(c, F.lit(1_000_000), F.lit(500_000)))
    assert got == ["$0.4500", "free", "free"]


REPLIES = [
    ('{"a": 1}', 1), ('```json\n{"a": 1}\n```', 1), ('{"a": 1,}', 1), ("{'a': 1}", 1), ('see {"a": 1} there', 1), ("nothing", None), ("", None),
]


def test_json_repair_agrees_with_python(spark):
    got = column(spark, [r for r, _ in REPLIES], lambda c: F.get_json_object(json_text.repair_json(c), "$.a").cast("int"))
    assert got == [a for _, a in REPLIES]
    assert [(json_text.safe_extract_json(r, {}) or {}).get("a") for r, _ in REPLIES] == [a for _, a in REPLIES]


def test_json_lists_and_literals(spark):
    assert column(spark, ["[1, 2,]"], json_text.repair_json) == ["[1, 2]"]
    assert json_text.extract_json('{"x": None, "y": True}') == {"x": None, "y": True}
    assert json_text.safe_extract_json(None, 7) == 7


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3), lambda s: st.lists(s, max_size=3) | st.dictionaries(st.text("xy", max_size=2), s, max_size=3)))
def test_json_round_trip(value):
    assert json_text.extract_json(f"```json\n{json.dumps(value)}\n```") == value


def test_indices(spark):
    values = ["<physical_index_7>", "physical_index_8", " 9 ", "-3", "5.0", "junk", None, "on physical_index_4, physical_index_5", "99999999999"]
    assert column(spark, values, json_text.parse_index) == [7, 8, 9, -3, None, None, None, 4, None]
    values = ["5", "5.0", "5.5", '"6"', '"6.0"', '"physical_index_2"', "null"]
    assert column(spark, values, lambda c: json_text.parse_json_index(F.parse_json(c))) == [5, 5, None, 6, None, 2, None]


def test_answers_and_lists(spark):
    assert column(spark, [" YES\n", "no", None], json_text.is_yes) == [True, False, False]
    got = column(spark, ['{"thinking":"t","node_list":["0001",3,null,""]}', "[1]", "x"], json_text.node_list)
    assert [(r.thinking, r.node_ids) for r in got] == [("t", ["0001", "3"]), ("", []), ("", [])]
    got = column(spark, ['{"table_of_contents":[{"title":"a"}]}', '[{"title":"b"}]', "{}"], lambda c: F.transform(json_text.toc_envelope(c), lambda x: x["title"]))
    assert got == [["a"], ["b"], []]
