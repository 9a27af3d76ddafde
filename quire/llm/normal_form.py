"""One consistent form for texts that look the same (confusables skeleton)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import cut, spread

# Letters of other scripts that look like a Latin letter (Cyrillic, Greek, Armenian, Cherokee, Lisu).
LOOKALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗ", "L": "ԼᏞꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ",
    "U": "Սꓴ", "V": "ᏙꓦѴ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "c": "сϲ", "d": "ԁᏧ", "e": "е", "g": "ɡց", "h": "һհᏂ", "i": "іⅰıι", "j": "јϳյ", "l": "ӏ", "n": "ոռ", "o": "оοօσ",
    "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝա", "x": "х", "y": "уүγ", "-": "‐‑",
    "": "\u115f\u1160\u3164\uffa0", " ": "\u2800",
}


# The code points with a category or a decomposition of interest: neither Han nor Hangul nor private ones.
READ = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xD7A4, 0xE000), range(0xF900, 0x20000), range(0xE0000, 0xE0200))


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Code point to prototype.

    Built by rule from the character database: format characters and variation selectors vanish,
    every space becomes the plain space, width forms and ligatures of letters become their parts,
    and ``LOOKALIKES`` become Latin: the scripts and letters named there, no more. Raised signs, circled, mathematical and fraction forms, which a
    reader can tell apart, stay as they are.
    """
    table: dict[int, str] = {}
    for code in chain(*READ):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F or 0xE0100 <= code <= 0xE01EF:
            table[code] = ""
        elif kind == "Zs":
            table[code] = " "
        elif (parts := unicodedata.decomposition(char)).startswith(("<wide>", "<narrow>", "<compat>")):
            plain = unicodedata.normalize("NFKD", char)
            if parts.startswith(("<wide>", "<narrow>")) or all(c.isalpha() for c in plain) and char != "ſ":
                table[code] = plain
    for prototype, alike in LOOKALIKES.items():
        table.update((ord(c), prototype) for c in alike)
    return {code: "".join(table.get(ord(c), c) for c in plain) for code, plain in table.items()}


def skeleton(text: str) -> str:
    """Decompose, replace by prototypes, decompose again; equal for texts that look the same."""
    if text.isascii():
        return text
    table, text = prototypes(), unicodedata.normalize("NFD", text)
    found = [c for c in set(text) if c > "\x7f" and ord(c) in table]
    if not found:
        return text
    for char in found:
        text = text.replace(char, table[ord(char)])
    return unicodedata.normalize("NFD", text)


def normal_form(text: str) -> str:
    """The skeleton in composed form: what is stored in place of the text."""
    return text if text.isascii() else unicodedata.normalize("NFC", skeleton(text))


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, form)``, one row per row of ``df``: the consistent form of ``text``; null stays null, empty empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else normal_form(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "form"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, form string")


def digests(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """``(key, scope, look, own)``: 128-bit digests of the skeleton and of the text itself.

    Only digests leave the executors' Python workers, so no text is shuffled. Null keys, null texts
    and texts that are empty or become so give no row. Rows delivered several times come out once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            looks, owns, rows = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                if t and (bare := skeleton(t)):
                    rows.append(i)
                    looks.append(_digest(bare))
                    owns.append(looks[-1] if bare == t else _digest(t))
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [kept.column(0), kept.column(1), pa.array(looks, pa.binary()), pa.array(owns, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "scope", "look", "own"])

    scope = F.col(within).cast("string") if within else F.lit("")
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    if within:
        rows = rows.where(F.col(within).isNotNull())
    read = rows.select(F.col(key).alias("key"), scope.alias("scope"), F.col(text).alias("text"))
    return spread(read).mapInArrow(run, f"key {kind}, scope string, look binary, own binary").distinct()


def lookalike_groups(marks: DataFrame) -> DataFrame:
    """Rows of ``digests`` in groups of one look with at least two different texts; copies of one text are no group."""
    mixed = marks.groupBy("scope", "look").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi")
    return marks.join(mixed.select("scope", "look"), ["scope", "look"], "left_semi")


def lookalike_classes(marks: DataFrame) -> DataFrame:
    """``(id, class, links)`` of the rows of ``lookalike_groups``, one row per key and text.

    ``class`` is the smallest key of the group; ``links`` counts the group's rows whose text differs
    from this one's. Groups of any size are counted, never expanded into pairs.
    """
    mixed = cut(lookalike_groups(cut(marks)))
    same = mixed.groupBy("scope", "look", "own").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("same"))
    whole = same.groupBy("scope", "look").agg(F.min("first").alias("class"), F.sum("same").alias("n"))
    counted = mixed.join(same.drop("first"), ["scope", "look", "own"]).join(whole, ["scope", "look"])
    return counted.select(F.col("key").alias("id"), "class", (F.col("n") - F.col("same")).alias("links"))


def lookalike_pairs(marks: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, smaller key first: rows whose texts look the same and differ in their characters.

    Only groups that hold different texts are joined, on digests; equal texts never pair. The
    groups' sizes are the result's own, and adaptive execution splits a hot one.
    """
    mixed = lookalike_groups(cut(marks))
    a = mixed.select("scope", "look", F.col("key").alias("id_a"), F.col("own").alias("own_a"))
    b = mixed.select("scope", "look", F.col("key").alias("id_b"), F.col("own").alias("own_b"))
    return a.join(b, ["scope", "look"]).where("id_a < id_b and own_a <> own_b").select("id_a", "id_b").distinct()
