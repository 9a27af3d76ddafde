"""Scalar text expressions: token counts, page tags, truncation, white space, prices. All built-in columns."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f\x85\xa0]"
# The tag of a page and the note behind a text cut for training.
TAG, CUT_NOTE = "<physical_index_", "\n[truncated]"
# US dollars per million input and output tokens.
PRICES = {"groq": (0.05, 0.10), "openai": (0.15, 0.60), "anthropic": (0.25, 1.25), "ollama": (0.0, 0.0)}


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def count_tokens(text: Column) -> Column:
    """0 for an empty text, else code points div 4 and at least 1; null for null."""
    return F.when(F.length(text) == 0, F.lit(0)).when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def provider_tokens(text: Column, provider: str) -> Column:
    """A provider's own estimate: the generic one may be 0, the hosted ones count at least 1."""
    size = F.floor(F.length(text) / 4).cast("int")
    return size if provider == "base" else F.when(text.isNotNull(), F.greatest(F.lit(1), size))


def can_count_exactly() -> bool:
    """Whether the library for exact counts is installed here."""
    return find_spec("tiktoken") is not None


def exact_tokens(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, tokens)`` counted with a ``.tiktoken`` vocabulary file in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        import base64
        from pathlib import Path

        import tiktoken

        lines = (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line)
        ranks = {base64.b64decode(a): int(b) for a, b in lines}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [None if t is None else len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], [key, "tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tokens int")


def tag_page(text: Column, number: Column) -> Column:
    """A page between two equal tags that name its number."""
    tag = F.concat(F.lit(TAG), number.cast("string"), F.lit(">"))
    return F.concat(tag, F.lit("\n"), text, F.lit("\n"), tag, F.lit("\n\n"))


def truncate_text(text: Column, max_chars: int = 2000, suffix: str = "...") -> Column:
    """At most ``max_chars`` characters, the suffix included."""
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, max_chars - len(suffix)), F.lit(suffix)))


def truncate_for_training(text: Column, max_tokens: int = 8000) -> Column:
    """The first ``4 * max_tokens`` characters and a note that the rest is left out."""
    limit = 4 * max_tokens
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit(CUT_NOTE)))


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks become one space, three or more newlines two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def pad_id(number: Column) -> Column:
    """At least four digits, never cut."""
    return F.format_string("%04d", number)


def estimated_cost(provider: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """``$0.1234`` by the price table, ``free`` where the price is zero or unknown."""
    price = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in PRICES.items() for x in (k, v[i])]), provider), F.lit(0.0))
    cost = (tokens_in * price(0) + tokens_out * price(1)) / 1e6
    return F.when(cost == 0, F.lit("free")).otherwise(F.format_string("$%.4f", cost))
