"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (4 to 6 bytes, with marks at both ends) and of itself, each hashed to an
embedding; the vectors of the words in a window are averaged and a two-class softmax reads the average.  Misspelt words
share most n-grams with the word that was learnt.  A few words make a long text toxic, so a text is read in windows of
some words and its logit is that of its worst window; of a toxic text only the worst window teaches toxicity, while
every window of a clean text teaches the other class.  Some training texts are held back to calibrate the scores.

Training uses a bounded sample of labelled rows of all lengths (``MOST_ROWS`` for each class, ``MOST_TOTAL`` bytes in
all) in the driver; scoring reads every whole text in Arrow tasks with the weights broadcast (``BUCKETS`` numbers) and no shuffle.

Defined results: null and empty texts score as a text without evidence; rows without a label are scored alike; a text
labelled twice is toxic if one label says so; without labels of both classes every score is the share of toxic labels;
extra columns are ignored, and never read by the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterkit.llm.rows import with_text_columns
from rosterkit.llm.words import NOT_ALPHANUMERIC, Slab, hash_ranges
from rosterkit.session import stage

BUCKETS = 1 << 17
DIMENSIONS = 4
WINDOW = 3
GRAMS = (4, 5, 6)
MOST_ROWS = 1500
MOST_TOTAL = 3_500_000  # bytes of text of each class, over all lengths
ROUNDS = 45
SUSPECTS = 12
RATE = 0.1


def word_buckets(slab: Slab, examples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words, and how many each word has."""
    sizes = slab.ends[examples] - slab.starts[examples]
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    total = int((sizes + 3).sum())
    text = np.full(total, ord("\n"), dtype=np.uint8)
    text[starts], text[starts + sizes + 1] = ord("<"), ord(">")
    inside = np.repeat(starts + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(slab.starts[examples] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    text[inside] = slab.data[source]
    parts = [(np.arange(len(examples)), hash_ranges(text, starts, starts + sizes + 2))]
    for n in GRAMS:
        count = np.maximum(sizes + 2 - n + 1, 0)
        word = np.repeat(np.arange(len(examples)), count)
        at = starts[word] + np.arange(len(word)) - (np.cumsum(count) - count)[word]
        parts.append((word, hash_ranges(text, at, at + n)))
    word, hashes = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(word, kind="stable")
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(word, minlength=len(examples))


def _window_sums(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of ``values`` over the windows of each text, and their first and last + 1 word (one shorter window for a
    text of fewer words)."""
    counts = np.diff(first)
    windows = np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)
    owner = np.repeat(np.arange(len(counts)), windows)
    start = first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    stop = np.minimum(start + WINDOW, first[1:][owner])
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    size = (stop - start).reshape(-1, *[1] * (values.ndim - 1))
    return (sums[stop] - sums[start]) / size, start, stop


@dataclass
class ToxicityModel:
    """What scoring needs: one weight for each bucket, the softmax bias, and the calibration of logits."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the worst window of each text; the bias alone without words."""
        slab = Slab(texts, NOT_ALPHANUMERIC, lower=True)
        out = np.full(len(texts), self.bias)
        if len(slab.hashes):
            _, example, place = np.unique(slab.hashes, return_index=True, return_inverse=True)
            buckets, counts = word_buckets(slab, example)
            word = np.add.reduceat(self.weights[buckets], np.cumsum(counts) - counts) / counts
            means, start, _ = _window_sums(word[place], slab.first)
            has = np.flatnonzero(slab.counts())
            out[has] = np.maximum.reduceat(means, np.searchsorted(start, slab.first[has])) + self.bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -50, 50)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.moments, self.steps = rate, {}, 0

    def step(self, **pairs):
        self.steps += 1
        for name, (value, gradient) in pairs.items():
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
            self.moments[name] = m, v
            value -= self.rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(v / (1 - 0.99 ** self.steps)) + 1e-8)


def train(texts: list[str], toxic: np.ndarray, prior: float | None = None, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax together, then the calibration on a quarter of the texts.

    ``prior`` is the share of toxic texts where the model will be used; by default that of the sample.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.25
    fit = np.flatnonzero(~held)
    slab = Slab([texts[i] for i in fit], NOT_ALPHANUMERIC, lower=True)
    if not len(slab.hashes):
        return ToxicityModel(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    label = toxic[fit]
    _, example, place = np.unique(slab.hashes, return_index=True, return_inverse=True)
    buckets, counts = word_buckets(slab, example)
    buckets, place = buckets.astype(np.int32), place.astype(np.int32)
    owner, part = np.repeat(np.arange(len(example), dtype=np.int32), counts), np.cumsum(counts) - counts
    table = rng.normal(0, 0.3, (DIMENSIONS, BUCKETS)).astype(np.float32)
    softmax, bias = rng.normal(0, 1.0, (DIMENSIONS, 2)), np.zeros(2)
    adam = _Adam(RATE)
    _, start, stop = _window_sums(np.zeros(len(slab.hashes)), slab.first)
    of_text = np.searchsorted(slab.first, start, side="right") - 1
    firsts = np.flatnonzero(np.concatenate([[True], of_text[1:] != of_text[:-1]]))
    sizes = np.diff(np.append(firsts, len(start)))
    positive = label[of_text] > 0
    for number in range(ROUNDS):
        means = np.stack([_window_sums((np.add.reduceat(row[buckets], part) / counts)[place], slab.first)[0] for row in table])
        gap = sum(w * m for w, m in zip(softmax[:, 1] - softmax[:, 0], means)) + bias[1] - bias[0]
        error = 1 / (1 + np.exp(-np.clip(gap, -30, 30))) - positive
        if number < SUSPECTS:  # every window of a toxic text is a suspect
            error *= np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
        else:  # the worst window of each toxic text; all windows of the clean ones, the worst of them most
            worst = gap >= np.repeat(np.maximum.reduceat(gap, firsts), sizes)
            weight = np.where(positive, 0.0, 0.15 / max(1, (~positive).sum()))
            weight[worst & positive] = 0.5 / max(1, (worst & positive).sum())
            weight[worst & ~positive] += 0.35 / max(1, (worst & ~positive).sum())
            error *= weight
        used = np.flatnonzero(error)
        delta, length = error[used], (stop - start)[used]
        gradient = np.empty_like(table)
        for d in range(DIMENSIONS):
            push = delta * (softmax[d, 1] - softmax[d, 0]) / length
            marks = np.bincount(start[used], push, len(slab.hashes) + 1) - np.bincount(stop[used], push, len(slab.hashes) + 1)
            at_distinct = np.bincount(place, np.cumsum(marks)[:-1], len(example)) / counts
            gradient[d] = np.bincount(buckets, at_distinct[owner], BUCKETS)
        pull = np.array([(m[used] * delta).sum() for m in means])
        adam.step(table=(table, gradient + np.float32(1e-6) * table), bias=(bias, np.array([-1.0, 1.0]) * delta.sum()),
                  softmax=(softmax, np.stack([-pull, pull], axis=1) + 1e-5 * softmax))
    model = ToxicityModel(sum(w * row for w, row in zip(softmax[:, 1] - softmax[:, 0], table)), float(bias[1] - bias[0]), 1.0, 0.0)
    rest = np.flatnonzero(held) if held.any() and 0 < toxic[held].mean() < 1 else np.arange(len(texts))
    model.slope, model.shift = _calibrate(
        model.logits([texts[i] for i in rest]), toxic[rest].astype(float), share if prior is None else prior)
    return model


def _calibrate(logits: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, the classes weighing as they occur."""
    target = np.where(label > 0, 1 - 1 / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    weight = np.where(label > 0, prior / label.sum(), (1 - prior) / (1 - label).sum())
    middle, scale = np.median(logits), logits.std() + 1e-9
    z, slope, shift = (logits - middle) / scale, 1.0, 0.0
    for _ in range(60):
        chance = 1 / (1 + np.exp(-(slope * z + shift)))
        error, curve = (chance - target) * weight, chance * (1 - chance) * weight
        hessian = np.array([[(curve * z * z).sum() + 1e-3, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-4]])
        step = np.linalg.solve(hessian, [(error * z).sum() + 1e-3 * slope, error.sum()])
        slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
    return max(slope, 1e-3) / scale, shift - max(slope, 1e-3) * middle / scale


def fold_of(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> tuple[DataFrame, float | None]:
    """``text, toxic`` of the bounded sample (outside ``fold``, the smallest id hashes of each class, texts of all lengths),
    and the share of toxic texts among all labelled rows outside ``fold``."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter(
        fold_of(F.col("id"), folds) != fold)
    known = stage(texts.select("id", F.octet_length("text").alias("size")).join(marked, "id"), "labelled")
    rows = known.groupBy("id", "toxic").agg(F.max("size").alias("size"))
    drawn = [rows.filter(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(MOST_ROWS).collect() for value in (1, 0)]
    chosen = texts.sparkSession.createDataFrame([(r.id, r.toxic) for part in drawn for r in within_bytes(part, MOST_TOTAL)],
                                                T.StructType([known.schema["id"], T.StructField("toxic", T.IntegerType())]))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return sample.orderBy("id").select("text", "toxic"), known.agg(F.avg("toxic")).first()[0]


def within_bytes(rows: list, most: int) -> list:
    """The rows in order that fit into ``most`` bytes of text together, whatever the length of each."""
    kept, total = [], 0
    for r in rows:
        if total + (r.size or 0) <= most:
            kept.append(r)
            total += r.size or 0
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    sample, share = training_rows(docs, labels)
    rows = sample.collect()
    return train([r.text for r in rows], np.array([r.toxic for r in rows], dtype=np.int64), share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns, by default all) and the ``toxic_score`` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, "toxic_score double", lambda texts: [pa.array(shared.value.scores(texts), pa.float64())],
                             keep=keep)
