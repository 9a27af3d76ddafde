"""Broken prompt and response pairs.

Openings of all responses, their prompt's title masked, are clustered by verified MinHash. A cluster
that recurs across unrelated prompts is a template; one that speaks of being unable, or whose
responses say the same whatever the prompt, is a refusal. Checks for content, copying, language and
endings label the other defects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.graph import components
from quire.llm.normal_form import normal_form
from quire.llm.truncation import CLOSED, is_empty, masked, truncated, visible
from quire.runtime import cut, spread

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
BLOCK = 10_000
UNRELATED = 3
MAX_ASK_WORDS = 9
CACHED_WORDS = 200_000

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with as are on by this it which from an be or at not has its how what their each was were than",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus wie wird oder bei einem einer nach wir zum zur außerdem sind",
    "fr": "le la les de des et en un une du que est pour dans qui par sur au aux avec ne se sont ce plus pas cette ces comme mais elle leur son ses nous entre",
    "es": "el la los las de del y en un una que es para por con se al como su sus más no lo son este esta entre sin sobre pero también cómo",
    "it": "il lo la gli le di del della dei delle e in un una che è per con si al come i sono non più anche questo questa nel nella da due fine",
    "pt": "o a os as de do da dos das e em um uma que é para por com se ao como não mais são no na pelo pela esta este também seção sobre",
    "nl": "de het een en van in is dat op te met voor zijn aan niet om er als bij ook door over deze dit worden wordt tot naar hoe enkele",
    "pl": "i w z na do się jest że nie to o jak po ta ten dla przez są od lub oraz tej część jego która które dwie autorzy",
    "sv": "och i att det som en på är av för med den till inte om ett har de var från hur kan vid eller detta denna",
}
LANGUAGES = list(FUNCTION_WORDS)
LANGUAGES_OF: dict[str, list[int]] = {}
for _place, _words in enumerate(FUNCTION_WORDS.values()):
    for _word in set(_words.split()):
        LANGUAGES_OF.setdefault(_word, []).append(_place)
SHARED_WEIGHT = (0, 6, 3, 1, 1, 0, 0, 0, 0, 0)
LETTER, FOREIGN = regex.compile(r"\p{L}"), regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)
BEYOND_LATIN = re.compile("[\u0370-\u1cff\u1f00-\u1fff\u2c80-\ua71f\ua840-\uaaff\uabc0-\ufaff\ufb13-\uff20\uff5b-\U0010ffff]")

# Phrases by which a response says that it will not or cannot answer.
FIRST_PERSON = re.compile(
    r"\b(?:i(?:'m| am)?(?: really| very| so| afraid)? (?:sorry|afraid|cannot|can't|can ?not|could not|couldn't|am unable|(?:am |'m )?not able|unable|must (?:decline|refuse)"
    r"|(?:have to|need to) (?:decline|refuse)|won't|will not|would rather not|do not have|don't have|do not know|don't know|apologi[sz]e|decline|refuse)"
    r"|(?:my|our) apologies|i apologi[sz]e|^(?:i'm )?sorry\b|(?:possible|information) for me\b|as an? (?:ai|language model|assistant)\b|against my|without it i\b"
    r"|(?:allow|permit)(?:s|ed)? me\b|not (?:allowed|permitted) to\b|(?:erlaub\w+|gestatt\w+) (?:es )?mir\b|me permet(?:tent|s)?\b|me permiten?\b"
    r"|could you (?:please )?(?:share|provide|paste)|please (?:paste|provide|share) the|^no (?:summary|answer) (?:can|could) be|unfortunately,? i\b"
    r"|es tut mir leid|tut mir leid|leider (?:kann|darf|muss) ich|(?:kann|darf|muss) ich\b.*\b(?:nicht|kein\w*|ablehnen)|ich (?:kann|darf|bin|muss)\b.*\b(?:nicht|kein\w*|ablehnen)|als (?:ki|sprachmodell|assistent)\b|ist (?:es )?mir nicht möglich"
    r"|désolé|je (?:ne|n')\b.*\b(?:peux|puis|suis pas|dispose|pas)\b|je (?:dois|suis contraint\w* de) (?:refuser|décliner)|je refuse|m'est (?:pas|impossible)|en tant que (?:modèle|ia)"
    r"|lo siento|lamentablemente|lamento|no (?:puedo|me es posible|estoy en condiciones|tengo acceso|me está permitido)|(?:debo|tengo que) (?:rechazar|negarme|declinar)|como modelo de lenguaje)"
)
INABILITY = re.compile(
    r"\b(?:cannot|can't|could not|unable|not able|not possible|sorry|apolog\w+|declin\w+|refus\w+|not (?:allowed|permitted)|not enough|no (?:summary|answer)|access|policy|guidelines"
    r"|nicht möglich|leider|ablehnen|keine auskunft|impossible|désolée?|refuser|malheureusement|no es posible|imposible|rechazar)\b"
)
ABOUT_TEXT = re.compile(
    r"^(?:the|this|these|it|here|finally|results|der|die|das|dieser|la|le|les|cette|ce|el|los|las|esta|este)\b.{0,40}?\b(?:section|authors?|paper|text|part|paragraphs?|chapter|abschnitt|autoren|arbeit|teil|auteurs?|texte|autores?|sección|texto)\b"
)
QUOTED = re.compile(r"[\"“„«][^\"”“»]{3,200}[\"”“»]")
ASK = re.compile(
    r"\?\s*$|^(?:please|question|q|what|which|how|why|who|when|where|summari[sz]e|describe|explain|give|tell|write|provide|outline|state|discuss"
    r"|bitte|frage|was|wie|worum|welche\w*|wovon|fasse?n?|beschreib\w*|erkläre?n?|gib|geben|nenne?n?|schreib\w*"
    r"|question|veuillez|résume[zr]?|décri\w+|expliquez?|donnez?|quel\w*|que|de quoi|comment|pourquoi|présentez?"
    r"|pregunta|resum[ea]\w*|describ\w+|expli\w+|qué|cuál\w*|cómo|de qué|por favor|haga|escrib\w+|indi\w+)\b"
)


@lru_cache(maxsize=16)
def plain(text: str) -> str:
    """A text for comparison: one form of look-alikes and case, single spaces."""
    return " ".join(normal_form(visible(text)).casefold().replace("’", "'").split())


WORD = re.compile(r"\w+")


@lru_cache(maxsize=16)
def words(text: str) -> tuple[str, ...]:
    return tuple(WORD.findall(plain(text)))


BREAK = re.compile(r"(?<=[.!?。])\s+|\n+")


def without_title(shown: str, name: str) -> str:
    """A plain text with one sign for each mention of its plain title."""
    return re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", "#", shown) if len(name) > 1 and name in shown else shown


def opening(text: str, title: str = "") -> str:
    """The first sentence of a response with one sign for each mention of its title, name and number."""
    first = BREAK.split(visible(text), maxsplit=1)[0]
    shown, name = plain(first), plain(title)
    bare = without_title(shown, name)
    return " ".join(masked(first if bare == shown else bare))


def language_hits(found: tuple[str, ...]) -> list[int]:
    """Function words of each language among the words of a text; those of one language alone weigh most."""
    hits = [0] * len(LANGUAGES)
    for places in filter(None, map(LANGUAGES_OF.get, found)):
        weight = SHARED_WEIGHT[len(places)]
        for place in places:
            hits[place] += weight
    return hits


def foreign_script(text: str) -> bool:
    """Whether most letters are of a script other than Latin."""
    shown = plain(text)
    letters = 0 if shown.isascii() or not BEYOND_LATIN.search(shown) else len(LETTER.findall(shown))
    return letters > 3 and len(FOREIGN.findall(shown)) * 2 > letters


def is_copy(title: str, text: str) -> bool:
    """Whether a response only repeats its title or asks for it."""
    name = words(title)
    if not name or " ".join(name) not in " ".join(words(text)):
        return False
    seen = False
    for sentence in re.split(r"(?<=[.!?。])[\"”»]*\s+|\n+", visible(text)):
        left, at, here = [], 0, False
        found = words(sentence)
        while at < len(found):
            if found[at] == name[0] and found[at : at + len(name)] == name:
                at, here = at + len(name), True
            else:
                left.append(found[at])
                at += 1
        if not here:
            if left:
                return False
            continue
        seen = True
        if len(left) > 2 and not (len(left) <= MAX_ASK_WORDS and ASK.search(plain(sentence).lstrip("¿\"'«„“-–* "))):
            return False
    return seen


def refuses(text: str) -> tuple[bool, bool, bool]:
    """Whether a response refuses in the first person, speaks of being unable at all, or reports on a text.

    Its first sentence tells, and the second where the first does not report on a text. Responses of
    any length count; what stands in quotation marks does not.
    """
    first, *more = (QUOTED.sub(" ", plain(part)).strip() for part in BREAK.split(visible(text), maxsplit=2)[:2])
    if ABOUT_TEXT.search(first):
        return False, False, True
    said = [first, *(m for m in more if not ABOUT_TEXT.search(m))]
    return any(FIRST_PERSON.search(m) for m in said), INABILITY.search(first) is not None, False


_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    value = _HASHES.get(word)
    if value is None:
        if len(_HASHES) >= CACHED_WORDS:
            _HASHES.clear()
        value = _HASHES[word] = xxhash.xxh64_intdigest(word) | 1
    return value


def shingle_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``SHINGLE``-word shingles of all texts in a row, and where those of each text begin.

    A shorter text is one shingle, filled up with empty words.
    """
    found = [text.split() for text in texts]
    sizes = np.array([max(SHINGLE, len(f)) for f in found], dtype=np.int64)
    flat = np.array([h for f in found for h in ([*map(_hash, f), *[0] * (SHINGLE - len(f))] if len(f) < SHINGLE else map(_hash, f))], dtype=np.uint64)
    counts = sizes - (SHINGLE - 1)
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(np.cumsum(sizes) - sizes - first, counts)
    value = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            value = (value ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return value, first


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingles of one text."""
    return np.unique(shingle_table([text])[0])


_SEEDS = np.array([xxhash.xxh64_intdigest(f"minhash {i}") | 1 for i in range(2 * BANDS * ROWS)], dtype=np.uint64)


def bands(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket per text and band of the MinHash signature, texts in rows."""
    out = np.zeros((len(first), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            for row in range(band * ROWS, (band + 1) * ROWS):
                mixed = values * _SEEDS[row] + _SEEDS[BANDS * ROWS + row]
                mixed ^= mixed >> np.uint64(31)
                out[:, band] = (out[:, band] ^ np.minimum.reduceat(mixed, first)) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


FEATURES = (
    "key long, tree long, title_hash long, reply long, empty boolean, copied boolean, strong boolean, weak boolean, about boolean, closed boolean, "
    "foreign boolean, words int, title_hits array<int>, text_hits array<int>, opening string"
)


def features(df: DataFrame) -> DataFrame:
    """What each pair ``(key, tree, title, text)`` shows by itself: one row per key with a response.

    ``reply`` is a hash of the response without its title; ``opening`` is its first sentence likewise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, tree, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                title = title or ""
                name, found = plain(title), words(text)
                reply = xxhash.xxh64_intdigest(without_title(plain(text), name)) >> 1
                rows.append(
                    (key, tree, xxhash.xxh64_intdigest(name) >> 1, reply, is_empty(text), is_copy(title, text), *refuses(text), CLOSED.search(visible(text)) is not None,
                     foreign_script(text), len(found), language_hits(words(title)), language_hits(found), opening(text, title))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    whole, yes, counts = pa.int64(), pa.bool_(), pa.list_(pa.int32())
    kinds = [whole, whole, whole, whole, yes, yes, yes, yes, yes, yes, yes, pa.int32(), counts, counts, pa.string()]
    names = [part.split()[0] for part in FEATURES.split(", ")]
    return df.select("key", "tree", "title", "text").mapInArrow(run, FEATURES)


def links(held: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of pairs of similarity ``SIMILARITY`` or more that connect all texts connected by such pairs.

    A text is compared with the members of each part connected so far until one is similar, the last
    similar one of a part first: many copies of one template cost one comparison each, and only texts
    that are similar to none meet all others.
    """
    sets = [frozenset(own.tolist()) for own in held]
    parts: list[list[int]] = []
    out = []
    for at, own in enumerate(sets):
        size = len(own)
        joined = []
        for place, part in enumerate(parts):
            for j, i in enumerate(part):
                other = sets[i]
                if min(size, len(other)) < SIMILARITY * max(size, len(other)):
                    continue
                both = len(own & other)
                if both >= SIMILARITY * (size + len(other) - both):
                    out.append((at, i))
                    joined.append(place)
                    part[0], part[j] = part[j], part[0]
                    break
        if joined:
            first = parts[joined[0]]
            for place in reversed(joined[1:]):
                first.extend(parts.pop(place))
            first.append(at)
        else:
            parts.append([at])
    return out


def opening_clusters(openings: DataFrame) -> DataFrame:
    """``(id, opening, cluster)`` for the distinct ``openings(opening)`` that have a near copy.

    Candidates share a band of the MinHash signature; all members of a bucket are compared with each
    other and linked where the exact similarity of their shingles is ``SIMILARITY`` or more, with no
    more links than connect them, and links chain through the bands. A pair of similarity 0.8 shares
    no band with a probability of 0.0002. A bucket of more than ``BLOCK`` members is dealt into blocks
    and every two blocks are compared in a group of their own, so a group stays small. Shingles are
    hashed once; they join only the openings that share a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, first = shingle_table(batch.column(1).to_pylist())
            buckets = bands(values, first) if len(first) else np.zeros((0, BANDS), dtype=np.int64)
            ends = [*first[1:].tolist(), len(values)]
            grams = [np.unique(values[a:b]).view(np.int64) for a, b in zip(first.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets.tolist(), pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], ["id", "buckets", "grams"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, ids, held = None, [], []

        def close() -> list[tuple[int, int]]:
            return [(ids[a], ids[b]) for a, b in links(held)]

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            found = []
            groups = zip(*(batch.column(i).to_pylist() for i in range(4)))
            grams = batch.column(5)
            starts, values = grams.offsets.to_numpy(), grams.values.to_numpy()
            for at, (group, k) in enumerate(zip(groups, batch.column(4).to_pylist())):
                if group != open_group:
                    found += close()
                    open_group, ids, held = group, [], []
                ids.append(k)
                held.append(values[starts[at] : starts[at + 1]])
            yield out(found)
        yield out(close())

    named = openings.withColumn("id", F.xxhash64("opening"))
    signed = cut(named.select("id", "opening").mapInArrow(run, "id long, buckets array<long>, grams array<long>"))
    placed = signed.select("id", F.posexplode("buckets").alias("band", "bucket"))
    shared = placed.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = placed.join(shared, ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("id", "band", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    group = ["band", "bucket", "lo", "hi"]
    members = dealt.join(signed.select("id", "grams"), "id").repartition(*group).sortWithinPartitions(*group).select(*group, "id", "grams")
    linked = members.mapInArrow(verify, "u long, v long")
    return named.join(components(linked).withColumnRenamed("vertex", "id"), "id").select("id", "opening", F.col("component").alias("cluster"))


def templates(pairs: DataFrame) -> DataFrame:
    """``(opening, cluster, refusing, bare)`` of the openings of responses that recur across unrelated prompts.

    A cluster recurs with ``UNRELATED`` responses or more to different prompts. ``bare``: without their
    titles its responses are mostly the same, and all are whole sentences that report on no text. ``refusing``: half of its
    responses or more refuse in the first person, or speak of being unable and are bare; the others
    with them.
    """
    own = pairs.where("not empty and not copied and opening <> ''").withColumn("id", F.xxhash64("opening"))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    seen = own.groupBy("id", "reply").agg(
        F.min("title_hash").alias("lo"), F.max("title_hash").alias("hi"), F.count(F.lit(1)).alias("n"), count("strong"), count("weak"),
        F.count(F.when(F.col("about") | ~F.col("closed"), 1)).alias("other"),
    )
    seen = cut(seen)
    clusters = cut(opening_clusters(own.select("opening").distinct()).select("id", "cluster"))
    named = seen.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    sums = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.sum(c).alias(c) for c in ("n", "strong", "weak", "other"))]
    whole = named.groupBy("cluster", "reply").agg(*sums).groupBy("cluster").agg(*sums, F.count(F.lit(1)).alias("replies"))
    bare = F.expr("2 * replies <= n and other = 0")
    refusing = F.expr("2 * strong >= n") | (bare & F.expr("2 * weak >= n"))
    recurring = whole.where(f"n >= {UNRELATED} and lo <> hi").select("cluster", refusing.alias("refusing"), bare.alias("bare"))
    ids = seen.select("id").distinct().join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    return ids.join(recurring.where("refusing or bare"), "cluster")


def defects(df: DataFrame, key: str, tree: str, title: str, text: str) -> DataFrame:
    """``(key, defect)`` of every defective pair of a prompt ``title`` and its response ``text``, each key once.

    In this order: ``empty`` (nothing, invisible characters or a placeholder), ``refusal``, ``copy``
    (only repeats the title or asks for it), ``language`` (not the language of the tree's titles and
    texts), ``truncated``. A null response is no pair; a null title is an empty prompt. Openings are
    compared over all responses, and languages over whole trees; groups of any size are aggregated
    before they are shuffled. Columns other than the four named are not read.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(tree).cast("long").alias("tree"), F.col(title).alias("title"), F.col(text).alias("text")
    )
    best_row = F.max(F.struct("text", "title", "tree")).alias("r")
    once = spread(cut(rows.groupBy("key").agg(best_row).select("key", "r.tree", "r.title", "r.text")))
    pairs = cut(features(once.where("text is not null")))
    known = templates(pairs).select("id", "refusing", "bare")

    hits = [F.sum(F.col("title_hits")[i] * 2 + F.col("text_hits")[i]).alias(c) for i, c in enumerate(LANGUAGES)]
    best = F.greatest(*LANGUAGES)
    place = F.array_position(F.array(*LANGUAGES), best).cast("int")
    trees = pairs.groupBy("tree").agg(*hits).select("tree", F.when(best > 0, place).alias("place"))

    own = F.expr("try_element_at(text_hits, place)")
    most = F.array_max("text_hits")
    other = F.col("place").isNotNull() & (
        F.col("foreign") | ((most >= 6) & (most > 2 * own)) | ((most - own >= 12) & (most > own * 1.3)) | ((own == 0) & (F.col("words") >= 14))
    )
    found = truncated(once, "key", "text", "title").withColumn("was_cut", F.lit(True))
    joined = pairs.withColumn("id", F.xxhash64("opening")).join(known, "id", "left").join(trees, "tree", "left").join(found, "key", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(yes(F.col("refusing")) | F.col("strong"), "refusal")
        .when(F.col("copied"), "copy")
        .when(yes(other), "language")
        .when(yes(F.col("bare")), "refusal")
        .when(yes(F.col("was_cut")), "truncated")
    )
    return joined.select(F.col("key").alias(key), defect.alias("defect")).where("defect is not null")
