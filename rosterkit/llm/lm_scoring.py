"""Language-model scoring by a weighted backoff automaton.

The model is a trigram model interpolated with bigrams and add-half unigrams.  Its counts cover all training documents and
are made by three exchanges of packed hashes (``chunks``): words, pairs of words, and triples whose first two words occur
``LEAST_HISTORY`` times in training.  How much of a state's weight its failure arc gets is estimated for all states of one
order and about the same count together (Witten-Bell over count classes): a class of T distinct continuations in C tokens
hands T / (C + T) to the next shorter history.

As an automaton: the root has an arc for each word; each word of the training texts is a state with an arc for every word
seen after it; each pair of words that occurs often enough is a state, too.  The failure arc of a pair leads to its last
word, that of a word to the root.  Each chunk of documents asks for the states and arcs that its texts can reach, builds
this part, and walks every text once from left to right: the state behind a token is the longest kept history, from which
the next token takes the first arc that is there on the chain of failure arcs.

Defined results: a null or empty text has only its end token; a null id trains and is not held out; equal rows count
each; extra columns are ignored; with no training rows every token has the same weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterkit.llm.chunks import (answers_of, bucket_count, by_range, chunk_rows, expand, pack_sorted, squeeze,
                                  unpack_sorted, write_chunks)
from rosterkit.llm.words import Slab, mix
from rosterkit.session import stage

END = np.uint64(0x454E44)
START = np.uint64(0x5354)
_MUL = np.uint64(0x9E3779B97F4A7C15)
CLASSES = 130
START_CLASS = CLASSES - 1
LEAST_HISTORY = 2  # training occurrences of a pair that is a state
_QUESTIONS = "bucket int, chunk long, payload binary, counts binary, classes binary"
_ANSWERS = "chunk long, bucket int, payload binary, sums array<struct<class:long,tokens:long,kinds:long>>"
_RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double, n_backoff long")


def held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id does not."""
    import zlib

    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], dtype=bool)


class Tokens:
    """The tokens of a chunk's texts in one row: words in lower case, and an end after each text."""

    def __init__(self, texts: list[bytes]):
        slab = Slab(texts, lower=True)
        counts = slab.counts()
        self.counts = counts + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.owner = np.repeat(np.arange(len(counts)), self.counts)
        self.ends = self.first[1:] - 1
        hashes = np.empty(int(self.first[-1]), dtype=np.uint64)
        is_word = np.ones(len(hashes), dtype=bool)
        is_word[self.ends] = False
        hashes[is_word], hashes[self.ends] = slab.hashes, END
        self.words, self.word = np.unique(hashes, return_inverse=True)
        before = np.concatenate([[START], hashes[:-1]])
        before[self.first[:-1]] = START
        links = mix(before * _MUL + hashes)
        self.pairs, self.pair = np.unique(links, return_inverse=True)
        self.starts = self.first[:-1]
        # The pair before each token, as its history; a text's first token has none.
        self.history = np.concatenate([[-1], self.pair[:-1]])
        self.history[self.starts] = -1
        self.triple_hash = mix(np.concatenate([[START], links[:-1]]) * _MUL + hashes)

    def pair_states(self) -> np.ndarray:
        """For each distinct pair the number of its first word, -1 for a text's start."""
        before = np.concatenate([[-1], self.word[:-1]])
        before[self.starts] = -1
        out = np.empty(len(self.pairs), dtype=np.int64)
        out[self.pair] = before
        return out


    def triples(self, pair_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens behind a history that is a state, the distinct triples they end, and each one's number among these."""
        at = np.flatnonzero((self.history >= 0) & (pair_counts[self.history] >= LEAST_HISTORY))
        return at, *np.unique(self.triple_hash[at], return_inverse=True)


def count_class(counts: np.ndarray) -> np.ndarray:
    """States of about the same count share a class: two classes for each doubling."""
    return np.minimum((2 * np.log2(counts + 1.0)).astype(np.int64), START_CLASS - 1)


class BackoffAutomaton:
    """The part of the model's automaton that some texts can reach: arcs and failure arcs of each order."""

    def __init__(self, word_counts, pair_counts, failure, train_tokens, train_words, texts_trained):
        self.root = np.log10((word_counts + 0.5) / (train_tokens + 0.5 * (train_words + 1)))
        self.word_counts, self.pair_counts, self.failure, self.texts_trained = word_counts, pair_counts, failure, texts_trained

    @staticmethod
    def _step(count, total, fail, below):
        """Weight from a state: its arc, interpolated with what is below, or its failure arc and the weight below."""
        seen = count > 0
        arc = np.zeros(len(below))
        np.divide((1 - fail) * count, total, out=arc, where=seen)
        return np.where(seen, np.log10(arc + fail * np.power(10.0, below)), np.log10(fail) + below), seen

    def walk(self, tokens: Tokens, triple_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each token as its text is read from left to right, and the failure arcs it took.

        Which history is carried to a token follows from the tokens before it alone, so the walk over all texts is one
        pass over arrays: from the root up, each order adds the arcs of the states that are behind the tokens.
        """
        states = tokens.pair_states()
        total = np.where(states < 0, self.texts_trained, self.word_counts[states])
        fail = self.failure[2][np.where(states < 0, START_CLASS, count_class(self.word_counts[states]))]
        weight, seen = self._step(self.pair_counts[tokens.pair], total[tokens.pair], fail[tokens.pair], self.root[tokens.word])
        failures = (~seen).astype(np.int64)
        at, _, triple = tokens.triples(self.pair_counts)
        history = self.pair_counts[tokens.history[at]]
        weight[at], seen = self._step(triple_counts[triple], history, self.failure[3][count_class(history)], weight[at])
        failures[at] = np.where(seen, 0, failures[at] + 1)
        return weight, failures


def _rows(chunk: int, keys, counts, classes, order, cuts, buckets, batch: bool):
    keep = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
    keys, counts = keys[order], counts[order]
    classes = None if classes is None else classes[order].astype(np.uint8)
    part = [slice(cuts[b], cuts[b + 1]) for b in keep]
    made = [pa.array(keep, pa.int32()), pa.array([chunk] * len(keep), pa.int64()),
            pa.array([pack_sorted(keys[p]) for p in part], pa.binary()),
            pa.array([squeeze(counts[p].astype(np.int64)) for p in part], pa.binary()),
            pa.array([None if classes is None else squeeze(classes[p]) for p in part], pa.binary())]
    kind = pa.RecordBatch if batch else pa.Table
    return kind.from_arrays(made, names=["bucket", "chunk", "payload", "counts", "classes"])


def _totals(table):
    """Answer one bucket: the training count of each key that was asked, and the bucket's sums by class."""
    asked = [unpack_sorted(x) for x in table.column("payload").to_pylist()]
    every = np.concatenate(asked)
    counts = np.concatenate([expand(x, np.int64) for x in table.column("counts").to_pylist()])
    distinct, place = np.unique(every, return_inverse=True)
    totals = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(totals, place, counts)
    classes = np.zeros(len(distinct), dtype=np.int64)
    if table.column("classes")[0].as_py() is not None:
        classes[place] = np.concatenate([expand(x, np.uint8) for x in table.column("classes").to_pylist()])
    tokens = np.bincount(classes, weights=totals, minlength=CLASSES).astype(np.int64)
    kinds = np.bincount(classes[totals > 0], minlength=CLASSES)
    parts = np.split(totals[place], np.cumsum([len(x) for x in asked])[:-1])
    sums = [{"class": int(c), "tokens": int(tokens[c]), "kinds": int(kinds[c])} for c in np.flatnonzero(tokens | kinds)]
    kind = pa.list_(pa.struct([("class", pa.int64()), ("tokens", pa.int64()), ("kinds", pa.int64())]))
    return pa.Table.from_arrays(
        [table.column("chunk"), table.column("bucket"), pa.array([squeeze(x) for x in parts], pa.binary()),
         pa.array([sums, *[None] * (len(asked) - 1)], kind)], names=["chunk", "bucket", "payload", "sums"])


def _class_sums(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct keys by class; at most CLASSES rows come back."""
    sums = (answers.filter("sums IS NOT NULL").select(F.inline("sums"))
            .groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect())
    out = np.zeros((2, CLASSES), dtype=np.float64)
    for row in sums:
        out[:, row["class"]] = row.tokens, row.kinds
    return out


def _round(answers, number):
    return answers.filter(pc.equal(answers.column("round"), number))


def score_texts(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Log10 probabilities of all texts by the unigrams and by the automaton; ``fold`` of the ids is held out.

    ``n_backoff`` counts the failure arcs that were taken.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark)
    chunks = write_chunks(docs)

    def trained(tokens, ids):
        return (~held_out(ids, folds, fold))[tokens.owner]

    def ask_words(batches):
        for batch in batches:
            for chunk, ids, texts in chunk_rows(batch):
                tokens = Tokens(texts)
                counts = np.bincount(tokens.word, weights=trained(tokens, ids), minlength=len(tokens.words))
                yield _rows(chunk, tokens.words, counts, None, *by_range(tokens.words, buckets), buckets, True)

    words = stage(chunks.mapInArrow(ask_words, _QUESTIONS).groupBy("bucket").applyInArrow(_totals, _ANSWERS), "words")
    tokens_seen, words_seen = _class_sums(words)
    train_tokens, train_words = float(tokens_seen.sum()), float(words_seen.sum())

    def word_counts(tokens, answers):
        return answers_of(_round(answers, 1), np.int64, *by_range(tokens.words, buckets))

    def ask_pairs(chunk_table, answers):
        (chunk, ids, texts), = chunk_rows(chunk_table)
        tokens = Tokens(texts)
        counts = np.bincount(tokens.pair, weights=trained(tokens, ids), minlength=len(tokens.pairs))
        states = tokens.pair_states()
        classes = np.where(states < 0, START_CLASS, count_class(word_counts(tokens, answers)[states]))
        return _rows(chunk, tokens.pairs, counts, classes, *by_range(tokens.pairs, buckets), buckets, False)

    def pair_counts(tokens, answers):
        return answers_of(_round(answers, 2), np.int64, *by_range(tokens.pairs, buckets))

    def ask_triples(chunk_table, answers):
        (chunk, ids, texts), = chunk_rows(chunk_table)
        tokens = Tokens(texts)
        known = pair_counts(tokens, answers)
        at, triples, triple = tokens.triples(known)
        counts = np.bincount(triple, weights=trained(tokens, ids)[at], minlength=len(triples))
        classes = np.zeros(len(triples), dtype=np.int64)
        classes[triple] = count_class(known[tokens.history[at]])
        return _rows(chunk, triples, counts, classes, *by_range(triples, buckets), buckets, False)

    def failures_of(answers):
        in_class, kinds_in_class = _class_sums(answers)
        out = np.ones(CLASSES)
        np.divide(kinds_in_class, in_class + kinds_in_class, out=out, where=in_class > 0)
        return out, in_class

    def exchange(ask, answers):
        asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, _QUESTIONS)
        return asked.groupBy("bucket").applyInArrow(_totals, _ANSWERS)

    words = words.withColumn("round", F.lit(1))
    pairs = stage(exchange(ask_pairs, words), "pairs").withColumn("round", F.lit(2))
    triples = stage(exchange(ask_triples, pairs), "triples").withColumn("round", F.lit(3))
    failure2, in_class = failures_of(pairs)
    failure = {2: failure2, 3: failures_of(triples)[0]}
    texts_trained = int(in_class[START_CLASS])

    def walk(chunk_table, answers):
        (_, ids, texts), = chunk_rows(chunk_table)
        tokens = Tokens(texts)
        known, arcs = word_counts(tokens, answers), pair_counts(tokens, answers)
        _, asked, _ = tokens.triples(arcs)
        triples = answers_of(_round(answers, 3), np.int64, *by_range(asked, buckets))
        automaton = BackoffAutomaton(known, arcs, failure, train_tokens, train_words, texts_trained)
        weights, failures = automaton.walk(tokens, triples)
        starts = tokens.starts
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held_out(ids, folds, fold)), pa.array(tokens.counts, pa.int64()),
             pa.array(np.add.reduceat((known > 0)[tokens.word].astype(np.int64), starts), pa.int64()),
             pa.array(np.full(len(ids), int(train_tokens)), pa.int64()),
             pa.array(np.add.reduceat(automaton.root[tokens.word], starts), pa.float64()),
             pa.array(np.add.reduceat(weights, starts), pa.float64()),
             pa.array(np.add.reduceat(failures, starts), pa.int64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_backoff"])

    answers = words.unionByName(pairs).unionByName(triples).select("chunk", "bucket", "payload", "round")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(walk, _RESULT)
