"""Abusive, hateful or sexual language: a character n-gram classifier.

Features are hashed character n-grams of a sentence, scaled by naive Bayes log-count ratios; a
logistic regression weighs them (Wang, Manning 2012). Labels belong to whole documents, so training
alternates: a document labelled toxic keeps as toxic only the sentences that the model finds so,
and documents whose label the model contradicts strongly are set aside as wrongly labelled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm.normal_form import normal_form
from quire.runtime import cut, spread

BITS, SIZES = 18, (3, 4, 5)
MAX_TOXIC, MAX_HARMLESS, MAX_SAMPLE_CHARS = 1_000, 2_500, 20_000
FOLDS, ROUNDS, HARMLESS_SHARE, BORDER, SMOOTH, COMMON = 5, 3, 0.9, 0.7, 0.1, 3
STEPS, PENALTY, POSITIVE_SHARE = 150, 1e-5, 0.2
THRESHOLD, HARMLESS_BELOW = 0.4, 0.98
BLOCK_CHARS, BLOCK_TEXTS = 2_000_000, 5_000
CACHED_CHARS, BLOCK_ROWS = 20_000_000, 500

# Digits and signs that stand for a letter inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e"}
SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'»”’)]*\s+|\n+")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
# A lone letter, as every spaced word has; a digit or a sign that may stand for a letter; a sign three times over.
TRIPLE = re.compile(r"(.)\1\1")
LONE, STAND_IN = re.compile(r"(?<![^\W_])[^\W\d_][ .\-_*][^\W\d_][ .\-_*]"), re.compile(r"[\d@$€]")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
NAME = re.compile(r"\b\w*[^\W\d_][A-Z]\w*\b|\b\w+-(?:\d+k?|XL|Net)\b")
MIXED = re.compile(r"(?<![^\W_])[^\W_]*[0-9@$€][\w@$€]*")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def _letters(m: re.Match[str]) -> str:
    word = m[0]
    kinds = [c.isalpha() for c in word]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    if sum(kinds) < 2 or len(word) < 4 or turns < 2 and not (kinds[0] and len(word) > 4) or not all(k or c in STAND_INS for k, c in zip(kinds, word)):
        return word
    return "".join(STAND_INS.get(c, c) for c in word)


def plain(sentence: str) -> str:
    """A sentence without disguise: one form of look-alikes, case, stand-ins, spaced and repeated letters, masks.

    Each step is skipped where a cheap test shows that it would change nothing.
    """
    s = normal_form(sentence)
    lower = s.lower()
    if s != lower and sum(map(str.isupper, s)) * 10 > sum(map(str.isalpha, s)) * 6:
        s = lower
    if LONE.search(s):
        s = SPACED.sub(lambda m: m[0].replace(m[1], ""), s)
    if s != lower or "-" in s:
        s = NAME.sub("N", s).lower()
    if "**" in s:
        s = re.sub(r"\*{2,}", "*", s)
    if STAND_IN.search(s):
        s = NUMBER.sub("0", MIXED.sub(_letters, s))
    if TRIPLE.search(s):
        s = REPEATED.sub(r"\1", s)
    return " ".join(s.split())


def raw_sentences(text: str) -> list[str]:
    """The sentences of a text as they stand; lines broken within a sentence are joined."""
    if "\n" in text:
        text = re.sub(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", "", text)
        text = re.sub(r"(?<=[^\n.!?:])\n(?=[^\W\d_A-Z])", " ", text)
    return SENTENCE.split(text)


def sentences(text: str) -> list[str]:
    """The sentences of a text in plain form, those of three letters or more."""
    return [p for part in raw_sentences(text) if sum(map(str.isalpha, part)) > 2 and (p := plain(part))]


@dataclass
class Grams:
    """Distinct hashed n-grams of each sentence, as rows of a sparse matrix."""

    row: np.ndarray
    feature: np.ndarray
    count: int


def grams(texts: Sequence[str]) -> Grams:
    """Distinct hashed character n-grams of all ``texts``, a block of texts at a time."""
    rows, features = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int32)]
    for start in range(0, len(texts), BLOCK_TEXTS):
        keys = _keys(texts[start : start + BLOCK_TEXTS])
        rows.append((keys >> BITS).astype(np.int32) + np.int32(start))
        features.append((keys & ((1 << BITS) - 1)).astype(np.int32))
    return Grams(np.concatenate(rows), np.concatenate(features), len(texts))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts in place."""
    values.sort()
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _keys(texts: Sequence[str]) -> np.ndarray:
    padded = [f" {t} \0" for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    keys = []
    with np.errstate(over="ignore"):
        for size in SIZES:
            if len(codes) < size:
                continue
            n = len(codes) - size + 1
            value, whole = np.full(n, size, dtype=np.uint64), np.ones(n, dtype=bool)
            for k in range(size):
                part = codes[k : k + n]
                value = (value ^ part) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
                whole &= part != 0
            feature = (value >> np.uint64(64 - BITS)).astype(np.int64)
            keys.append((owner[:n][whole] << BITS) | feature[whole])
    return distinct(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)


def scores(weights: np.ndarray, bias: float, g: Grams) -> np.ndarray:
    """The model's probability for each sentence."""
    total = np.bincount(g.row, weights=weights[g.feature], minlength=g.count)
    size = np.bincount(g.row, minlength=g.count)
    z = total / np.sqrt(np.maximum(size, 1)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_count_ratios(g: Grams, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of every feature; 0 for features not seen."""
    pos = np.bincount(g.feature, weights=(target * weight)[g.row], minlength=1 << BITS)
    neg = np.bincount(g.feature, weights=((1 - target) * weight)[g.row], minlength=1 << BITS)
    smooth = 0.5 * min(1.0, max(1e-3, (target @ weight) / max(len(target), 1)))
    ratio = np.log((pos + smooth) / (pos + smooth).sum()) - np.log((neg + smooth) / (neg + smooth).sum())
    return np.where(pos + neg > 0, ratio, 0.0)


def _regress(g: Grams, target: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on ratio-scaled features, by accelerated gradient steps."""
    size = np.sqrt(np.maximum(np.bincount(g.row, minlength=g.count), 1))
    features, column = np.unique(g.feature, return_inverse=True)
    column = column.astype(np.int32)
    scale = (ratio[g.feature] / size[g.row]).astype(np.float32)
    order = np.argsort(column, kind="stable").astype(np.int32)
    by_column, scale_by_column = g.row[order], scale[order]
    rows, row_starts = np.unique(g.row, return_index=True)
    column_starts = np.searchsorted(column[order], np.arange(len(features)))
    step = 4.0 / (float(np.bincount(g.row, weights=scale**2, minlength=g.count).max()) + 1.0)
    share = (weight / weight.sum()).astype(np.float32)
    w = np.zeros(len(features), dtype=np.float32)
    vw, b, vb = w.copy(), 0.0, 0.0
    z = np.zeros(g.count, dtype=np.float32)
    for k in range(1, STEPS + 1):
        z[rows] = np.add.reduceat(vw[column] * scale, row_starts)
        error = share * (1 / (1 + np.exp(-np.clip(z + vb, -30, 30))) - target)
        grad = np.add.reduceat(error[by_column].astype(np.float32) * scale_by_column, column_starts) + PENALTY * vw
        nw, nb = vw - step * grad, vb - step * float(error.sum())
        momentum = (k - 1) / (k + 2)
        vw, vb = nw + np.float32(momentum) * (nw - w), nb + momentum * (nb - b)
        w, b = nw, nb
    model = np.zeros(1 << BITS)
    model[features] = w * ratio[features]
    return model, b


def _divide(values: np.ndarray) -> float:
    """The border between the two clusters of some numbers (two means)."""
    border = float(values.mean())
    for _ in range(50):
        low, high = values[values <= border], values[values > border]
        if not len(high) or not len(low):
            break
        border = float(low.mean() + high.mean()) / 2
    return border


def _clean(g: Grams, doc: np.ndarray, toxic: np.ndarray, docs: int) -> np.ndarray:
    """Which sentences of the documents labelled toxic are so.

    Naive Bayes over documents, cross-fitted so that no document counts for itself: a sentence stays
    toxic while the mean log-count ratio of its n-grams lies above what nearly all documents labelled
    harmless reach, and well up towards the upper of the two clusters that the toxic documents' best sentences form. A document without such a sentence was labelled wrongly.
    """
    fold = (doc * 2654435761 >> 7) % FOLDS
    size = np.maximum(np.bincount(g.row, minlength=g.count), 1)
    harmless = np.ones(docs, dtype=bool)
    harmless[doc[toxic]] = False

    def pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = rows[g.row]
        keys = distinct((doc[g.row[mine]] << BITS) | g.feature[mine])
        return fold_of[keys >> BITS].astype(np.int8), (keys & ((1 << BITS) - 1)).astype(np.int32)

    def counts(folds: np.ndarray, features: np.ndarray, but: int) -> np.ndarray:
        return np.bincount(features[folds != but], minlength=1 << BITS)

    fold_of = np.zeros(docs, dtype=np.int64)
    fold_of[doc] = fold
    harmless_pairs, target = pairs(~toxic), toxic
    for _ in range(ROUNDS):
        value, toxic_pairs, held = np.zeros(g.count), pairs(target), np.unique(doc[target])
        for f in range(FOLDS):
            pos, neg = counts(*toxic_pairs, f), counts(*harmless_pairs, f)
            n_pos, n_neg = 1 + (fold_of[held] != f).sum(), 1 + (harmless & (fold_of != f)).sum()
            ratio = np.log((pos + SMOOTH) / n_pos) - np.log((neg + SMOOTH) / n_neg)
            ratio[pos + neg == 0] = 0.0
            mine = fold[g.row] == f
            value += np.bincount(g.row[mine], weights=ratio[g.feature[mine]], minlength=g.count)
        value /= size
        best = np.full(docs, -np.inf)
        np.maximum.at(best, doc, value)
        reached = best[harmless & np.isfinite(best)]
        bar = max(BORDER * _divide(best[np.unique(doc[toxic])]), np.quantile(reached, HARMLESS_SHARE) if len(reached) else -np.inf)
        chosen = toxic & (value > bar)
        if not chosen.any():
            break
        target = chosen
    return target.astype(float)


def train(texts: Sequence[str], labels: Sequence[int]) -> tuple[np.ndarray, float]:
    """Weights per hashed n-gram and the bias, from documents with labels 0 or 1.

    A sentence that documents labelled harmless hold about as often is never taken for toxic; what
    remains undecided in toxic documents teaches nothing.
    Without a document of either kind the model scores everything 0.
    """
    return _train([list(dict.fromkeys(sentences(t))) for t in texts], labels)


def _train(parts: Sequence[list[str]], labels: Sequence[int]) -> tuple[np.ndarray, float]:
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    toxic = np.asarray(labels, dtype=bool)[doc] if len(doc) else np.empty(0, dtype=bool)
    if not len(doc) or not toxic.any() or toxic.all():
        return np.zeros(1 << BITS), -30.0
    flat = [s for p in parts for s in p]
    calm = Counter(s for s, t in zip(flat, toxic.tolist()) if not t)
    rude = Counter(s for s, t in zip(flat, toxic.tolist()) if t)
    usual = np.array([COMMON * calm[s] >= rude[s] and calm[s] > 0 for s in flat])
    target = _clean(grams(flat), doc, toxic & ~usual, len(parts))
    kept: dict[tuple[str, float], float] = {}
    for sentence, mark, other in zip(flat, target.tolist(), (toxic & ~usual & (target == 0)).tolist()):
        if other:
            continue
        kept[sentence, mark] = kept.get((sentence, mark), 0.0) + 1.0
    marks = np.array([m for _, m in kept])
    weight = np.sqrt(np.array(list(kept.values())))
    weight[marks > 0] *= POSITIVE_SHARE / (1 - POSITIVE_SHARE) * weight[marks == 0].sum() / weight[marks > 0].sum()
    g = grams([s for s, _ in kept])
    return _regress(g, marks, weight, log_count_ratios(g, marks, np.ones(len(marks))))


@dataclass
class Model:
    """Weights per hashed n-gram, bias, and the score from which a document counts as toxic."""

    weights: np.ndarray
    bias: float
    threshold: float = THRESHOLD


def calibrated(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """The model of ``train`` with a threshold by cross-fitting.

    Two models, each of one half of the documents, score the other half. The threshold is what
    ``HARMLESS_BELOW`` of the documents labelled harmless stay below, ``THRESHOLD`` at least: with few
    labels, when scores of harmless documents scatter widely, fewer documents are reported.
    """
    parts = [list(dict.fromkeys(sentences(t))) for t in texts]
    labels = np.asarray(labels)
    held = []
    for half in (0, 1):
        own = [i for i in range(len(parts)) if i % 2 == half]
        model = _train([parts[i] for i in own], labels[own])
        held += [scores(*model, grams(parts[i])).max() for i in range(len(parts)) if i % 2 != half and parts[i] and not labels[i]]
    threshold = max(THRESHOLD, float(np.quantile(held, HARMLESS_BELOW))) if held else THRESHOLD
    return Model(*_train(parts, labels), threshold)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on at most ``MAX_TOXIC`` and ``MAX_HARMLESS`` labelled documents, chosen by a hash of their key.

    The keys are chosen from the labels, then one scan reads their texts. Those that are null or
    longer than ``MAX_SAMPLE_CHARS`` are not in the sample, which bounds what the driver holds to 70
    million characters. A document labelled several times takes the mean of its labels, rounded; null
    labels are left out. Everything else about the corpus is read in full by ``score``.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    order = [F.xxhash64("k"), "k"]
    toxic, harmless = (marks.where(F.col("y") == mark).orderBy(*order).limit(most) for mark, most in ((1, MAX_TOXIC), (0, MAX_HARMLESS)))
    chosen = cut(toxic.union(harmless))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= MAX_SAMPLE_CHARS)
    found = rows.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.max("t").alias("t")).collect()
    sample = sorted(((r["y"], xxh64_intdigest(repr(r["k"])), r["t"]) for r in found), key=lambda r: r[:2])
    return calibrated([t for _, _, t in sample], [y for y, _, _ in sample])


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)``, one row per key: the highest score of the text's sentences.

    Null, empty and blank texts score 0. Whole texts are read, in blocks of sentences; a sentence met
    before, among the last ``CACHED_CHARS`` characters or so, keeps its score. Rows without a key give
    no row and repeated rows come out once. The model is a table of fixed size.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known: dict[str, float] = {}
        size = 0

        def learn(new: list[str]) -> None:
            plains = [plain(part) if sum(map(str.isalpha, part)) > 2 else "" for part in new]
            known.update(zip(new, np.where([not p for p in plains], 0.0, scores(weights, bias, grams(plains))).tolist()))

        for batch in batches:
            best: list = [raw_sentences(value) if value else [] for value in batch.column(1).to_pylist()]
            for start in range(0, len(best), BLOCK_ROWS):
                rows = best[start : start + BLOCK_ROWS]
                if size > CACHED_CHARS:
                    known.clear()
                    size = 0
                new: dict[str, None] = {}
                waiting = 0
                for part in (part for parts in rows for part in parts):
                    if part not in known and part not in new:
                        new[part] = None
                        waiting += len(part)
                        if waiting > BLOCK_CHARS:
                            learn(list(new))
                            size, waiting = size + waiting, 0
                            new = {}
                if new:
                    learn(list(new))
                    size += waiting
                best[start : start + BLOCK_ROWS] = [max((known[p] for p in parts), default=0.0) for parts in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64())], [key, "score"])

    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.where(F.col(key).isNotNull()).select(key, text))
    return rows.mapInArrow(run, f"`{key}` {kind}, score double").groupBy(key).agg(F.max("score").alias("score"))


def rates(documents: DataFrame, scored: DataFrame, key: str = "doc_id", source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``(source, documents, toxic, rate)`` for every source, null sources included."""
    rows = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(source).alias("source")).join(scored, key)
    toxic = F.sum((F.col("score") >= threshold).cast("long")).alias("toxic")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), toxic).withColumn("rate", F.col("toxic") / F.col("documents"))
