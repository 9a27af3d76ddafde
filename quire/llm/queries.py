"""The training-data queries ``pN_...`` over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import leaks, normal_form, pairs, pieces, quantiles, splits, tokens, toxicity, truncation
from quire.runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups(table(spark, sf_dir, "training"), table(spark, sf_dir, "paper_authors"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose paper group holds several pairs, with the group's smallest paper number."""
    return splits.shared_groups(_groups(spark, sf_dir))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its group and its split, 80/10/10 of the rows."""
    return splits.assign(_groups(spark, sf_dir))


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the pairs, the groups that stand in several splits, and whether each share is met within one in a hundred rows, or within the largest group where that is larger."""
    rows = cut(p1_splits(spark, sf_dir))
    sizes = cut(rows.where("group_key is not null").groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits")))
    largest, several = sizes.agg(F.coalesce(F.max("n"), F.lit(1)), F.count(F.when(F.col("splits") > 1, 1))).first()
    slack = F.greatest(F.lit(0.01), F.lit(largest) / F.count(F.lit(1)))
    share = lambda name, part: (F.abs(F.avg((F.col("split") == name).cast("double")) - part) <= slack).alias(name)
    counted = rows.agg(F.count(F.lit(1)).alias("pairs"), *(share(name, part) for name, part in splits.SPLITS))
    return counted.withColumn("split_groups", F.lit(several).cast("int"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose summary was cut off."""
    return truncation.truncated(table(spark, sf_dir, "training_nodes"), "node_key", "summary", "title")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's summaries were cut off."""
    nodes = table(spark, sf_dir, "training_nodes")
    return truncation.shares(nodes, p2_found(spark, sf_dir), "node_key", "summary", "model").withColumnRenamed("source", "model")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of title and summary, each with its defect."""
    return pairs.defects(table(spark, sf_dir, "training_nodes"), "node_key", "pair_id", "title", "summary")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = "generation_time_seconds"
    training = quantiles.measured(table(spark, sf_dir, "training"), "training", "pair_id", seconds, "created_at")
    runs = quantiles.measured(table(spark, sf_dir, "batch_runs"), "batch_runs", "run_id", seconds, "started_at")
    return training.union(runs)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.daily_sketches(_values(spark, sf_dir))


def p4_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the generation time per model and per model and page count, over all days."""
    return quantiles.percentiles(_daily(spark, sf_dir))


def p4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable sketches per source, model, page count and day."""
    return _daily(spark, sf_dir)


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each percentile, at every level, lies within its stated rank error, counted exactly."""
    values = _values(spark, sf_dir)
    points = quantiles.QUANTILES
    keys = ["source", "level", "model", "page_count"]
    plain = [F.coalesce("model", F.lit("")).alias("model"), F.coalesce("page_count", F.lit(-1)).alias("page_count")]
    of = lambda i, c: F.max(F.when(F.col("p") == points[i], F.col(c)))
    got = quantiles.percentiles(quantiles.daily_sketches(values)).select("source", "level", *plain, "n", "p", "value", "rank_error")
    wide = [x for i in range(len(points)) for x in (of(i, "value").alias(f"at{i}"), of(i, "rank_error").alias(f"error{i}"))]
    got = cut(got.groupBy(*keys, "n").agg(*wide))
    levels = F.array(F.struct(F.lit("model").alias("level"), F.lit(-1).alias("page_count")), F.struct(F.lit("model_pages").alias("level"), F.coalesce("page_count", F.lit(-1)).alias("page_count")))
    each = values.select(F.explode(F.array("source", F.lit("all"))).alias("source"), F.coalesce("model", F.lit("")).alias("model"), F.explode(levels).alias("l"), "value")
    joined = each.select("source", "l.level", "model", "l.page_count", "value").join(got, keys)
    held = [x for i in range(len(points)) for x in (F.count(F.when(F.col("value") < F.col(f"at{i}"), 1)).alias(f"below{i}"), F.count(F.when(F.col("value") <= F.col(f"at{i}"), 1)).alias(f"upto{i}"))]
    counted = joined.groupBy(*keys, "n", *(f"error{i}" for i in range(len(points)))).agg(*held)

    def within(i: int) -> Column:
        slack = F.col(f"error{i}") + 1 / F.col("n")
        return (F.col(f"below{i}") / F.col("n") - slack <= points[i]) & (points[i] <= F.col(f"upto{i}") / F.col("n") + slack)

    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), within(i).alias("within")) for i, p in enumerate(points)))).alias("r")
    return counted.select(*keys, "n", rows).select(*keys, "n", "r.p", "r.within")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "training"), "pair_id", "document_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose text is above the limit: those that came out in pieces."""
    return _pieces(spark, sf_dir).select("pair_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized texts, each once."""
    return _pieces(spark, sf_dir).dropDuplicates(["pair_id", "piece_no"])


def p5_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each oversized text: whether its pieces keep the limit, repeat the last 800 characters, and give the text again."""
    overlap = pieces.OVERLAP_TOKENS * pieces.CHARS_PER_TOKEN
    parts = _pieces(spark, sf_dir).groupBy("pair_id", "piece_no").agg(F.max("piece").alias("piece"), F.max("piece_tokens").alias("tokens"))
    listed = parts.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).alias("p"), F.max("tokens").alias("most"))
    texts = table(spark, sf_dir, "training").groupBy("pair_id").agg(F.max("document_text").alias("text"))
    joined = listed.join(texts, "pair_id")
    rest = F.expr(f"transform(slice(p, 2, greatest(size(p) - 1, 0)), x -> substring(x.piece, {overlap + 1}))")
    ends = F.expr(f"forall(sequence(2, greatest(size(p), 2)), i -> size(p) < 2 or startswith(p[i - 1].piece, right(p[i - 2].piece, {overlap})))")
    whole = F.concat(F.col("p")[0]["piece"], F.array_join(rest, "")) == F.col("text")
    return joined.select("pair_id", F.length("text").alias("chars"), (F.col("most") <= pieces.MAX_TOKENS).alias("within"), ends.alias("overlap"), whole.alias("whole"))


def _looks(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    titles = normal_form.digests(table(spark, sf_dir, "training_nodes"), "node_key", "title", within="pair_id")
    texts = normal_form.digests(table(spark, sf_dir, "training"), "pair_id", "document_text")
    return [("title", titles), ("document_text", texts)]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose title or text looks the same and differs in its characters."""
    parts = [normal_form.lookalike_pairs(marks).select(F.lit(name).alias("field_name"), "id_a", "id_b") for name, marks in _looks(spark, sf_dir)]
    return parts[0].union(parts[1])


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of those pairs, once per text, with their class and number of links."""
    parts = [normal_form.lookalike_classes(marks).select(F.lit(name).alias("field_name"), "*") for name, marks in _looks(spark, sf_dir)]
    return parts[0].union(parts[1])


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title and text, each key once."""
    titles, texts = table(spark, sf_dir, "training_nodes"), table(spark, sf_dir, "training")
    parts = [
        normal_form.forms(rows.groupBy(key).agg(F.max(text).alias(text)), key, text).select(F.lit(text).alias("field_name"), F.col("key").alias("id"), "form")
        for rows, key, text in ((titles, "node_key", "title"), (texts, "pair_id", "document_text"))
    ]
    return parts[0].union(parts[1])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document under byte_bpe_50k, without special tokens."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leaks.found(documents, items, "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with the number of documents that hold it and the largest share held."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("share"))


def _toxicity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model), model.threshold


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document for abusive, hateful or sexual language."""
    return _toxicity(spark, sf_dir)[0]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold abusive, hateful or sexual language."""
    scored, threshold = _toxicity(spark, sf_dir)
    return scored.where(F.col("score") >= threshold).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of such documents for each source."""
    scored, threshold = _toxicity(spark, sf_dir)
    return toxicity.rates(table(spark, sf_dir, "documents"), scored, threshold=threshold)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_bounds, p2_found, p2_shares, p3_found, p4_quantiles, p4_daily, p4_bounds, p5_found, p5_pieces, p5_bounds, p6_found, p6_groups, p6_forms,
        p7_ids, p8_found, p8_items, p9_found, p9_scores, p9_rates,
    )
}

_PAPER = r"regexp_extract(arxiv_id, '(^|[^0-9])([0-9]{4}\.[0-9]{4,5})($|[^0-9])', 2)"

_USABLE = "t IS NOT NULL AND NOT isnan(t) AND t >= 0 AND t < 'infinity'::DOUBLE"


# For the SQL alone, written down from the tables and not from the operator's table: letters of other scripts there, and what they look like.
_SEEN, _SHOWN = "АВЕКМНОРСТХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXSIJaeopcyxsijABEZHIKMNOPTYXo"


def _skeleton_sql(column: str) -> str:
    """The skeleton in SQL, for the characters that the tables hold: composed form instead of decomposed."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    source, target = wide + _SEEN, "".join(chr(ord(c) - 0xFEE0) for c in wide) + _SHOWN
    bare = f"regexp_replace({column}, '[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g')"
    spaced = f"regexp_replace({bare}, '[\u00a0\u2000-\u200a\u202f\u205f\u3000]', ' ', 'g')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        spaced = f"replace({spaced}, '{ligature}', '{letters}')"
    mapped = "translate(nfc_normalize({0}), '{1}', '{2}')".format(spaced, source.replace("'", "''"), target.replace("'", "''"))
    return f"nfc_normalize({mapped})"


def _class_sql(name: str, relation: str, key: str, column: str, scope: str) -> str:
    return f"""SELECT '{name}' AS field_name, k AS id, min(k) OVER g AS class, count(*) OVER g - count(*) OVER (PARTITION BY scope, look, t) AS links
        FROM (SELECT DISTINCT {key} AS k, {scope} AS scope, {column} AS t, {_skeleton_sql(column)} AS look FROM {relation} WHERE {key} IS NOT NULL)
        WHERE look <> '' AND scope IS NOT NULL WINDOW g AS (PARTITION BY scope, look) QUALIFY min(t) OVER g <> max(t) OVER g"""


def _lookalike_sql(name: str, relation: str, key: str, column: str, scope: str) -> str:
    return f"""SELECT '{name}' AS field_name, a.k AS id_a, b.k AS id_b
        FROM (SELECT DISTINCT {key} AS k, {scope} AS scope, {column} AS t, {_skeleton_sql(column)} AS look FROM {relation}) a
        JOIN (SELECT DISTINCT {key} AS k, {scope} AS scope, {column} AS t, {_skeleton_sql(column)} AS look FROM {relation}) b
        ON a.look = b.look AND a.scope = b.scope AND a.k < b.k AND a.t <> b.t WHERE a.look <> ''"""


ORACLE: dict[str, str] = {
    "p4_bounds": f"""
        WITH v AS (SELECT DISTINCT 'training' AS source, pair_id AS k, coalesce(model, '') AS model, page_count, generation_time_seconds AS t FROM training
                   UNION ALL SELECT DISTINCT 'batch_runs', run_id, coalesce(model, ''), page_count, generation_time_seconds FROM batch_runs)
        , r AS (SELECT s.source, l.level, model, CASE WHEN l.level = 'model' THEN -1 ELSE coalesce(page_count, -1) END AS page_count, count(*) AS n
                FROM v, (SELECT unnest(['model', 'model_pages']) AS level) l, (SELECT unnest(['training', 'batch_runs', 'all']) AS source) s
                WHERE s.source IN (v.source, 'all') AND {_USABLE} GROUP BY ALL)
        SELECT source, level, model, page_count, n, CAST(p AS DOUBLE) AS p, true AS within FROM r, (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS p)
    """,
    "p6_found": _lookalike_sql("title", "training_nodes", "node_key", "title", "pair_id")
    + " UNION ALL "
    + _lookalike_sql("document_text", "training", "pair_id", "document_text", "0"),
    "p6_groups": _class_sql("title", "training_nodes", "node_key", "title", "pair_id")
    + " UNION ALL "
    + _class_sql("document_text", "training", "pair_id", "document_text", "0"),
    "p6_forms": f"""SELECT 'title' AS field_name, node_key AS id, {_skeleton_sql("max(title)")} AS form FROM training_nodes GROUP BY node_key
        UNION ALL SELECT 'document_text', pair_id, {_skeleton_sql("max(document_text)")} FROM training GROUP BY pair_id""",
    "p1_found": f"""
        WITH RECURSIVE rows AS (SELECT DISTINCT pair_id, nullif({_PAPER}, '') AS paper FROM training),
        written AS (SELECT DISTINCT author_id, nullif({_PAPER}, '') AS paper FROM paper_authors WHERE author_id IS NOT NULL),
        links AS (SELECT DISTINCT a.paper AS u, b.paper AS v FROM written a JOIN written b USING (author_id)
                  WHERE a.paper IS NOT NULL AND b.paper IS NOT NULL),
        reach(u, v) AS (SELECT paper, paper FROM rows WHERE paper IS NOT NULL
                        UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
        keys AS (SELECT u AS paper, min(v) AS group_key FROM reach GROUP BY u),
        keyed AS (SELECT DISTINCT pair_id, group_key FROM rows JOIN keys USING (paper) WHERE pair_id IS NOT NULL)
        SELECT pair_id, group_key FROM keyed
        WHERE group_key IN (SELECT group_key FROM keyed GROUP BY group_key HAVING min(pair_id) <> max(pair_id))
    """,
    "p1_bounds": """SELECT count(*) AS pairs, true AS train, true AS validation, true AS test, CAST(0 AS INT) AS split_groups
        FROM (SELECT DISTINCT pair_id FROM training)""",
    "p5_bounds": """SELECT pair_id, CAST(max(length(document_text)) AS INT) AS chars, true AS within, true AS overlap, true AS whole FROM training
        WHERE greatest(1, length(document_text) // 4) > 8000 AND pair_id IS NOT NULL GROUP BY pair_id""",
    "p5_found": "SELECT DISTINCT pair_id FROM training WHERE greatest(1, length(document_text) // 4) > 8000 AND pair_id IS NOT NULL",
}
