"""Benchmark decontamination: an FM-index for each training shard, searched for all test phrases.

The test phrases are the windows of the benchmark items.  Repeated items count once and long ones are cut into pieces that
share all but one word of a window.  The pieces are broadcast in blocks of bounded size, and each further block is one more
pass over the documents, so a benchmark of any size is searched whole.  A shard is some megabytes of
documents within a task.  A phrase consists of benchmark words only, so the shard's index holds the runs of benchmark
words that are long enough for the shortest phrase; no other place can match.  Backward search finds the phrases that
occur, sampled suffix positions give their places, and covered words merge to removal spans.  Nothing is shuffled.

Defined results: null and empty texts have no words and no hits; an item without words has no window; equal items (same
id) count once; an item without id marks words but is not named; equal rows are judged alike; extra columns are ignored;
an empty benchmark leaves all clean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterkit.llm.fm_index import FMIndex
from rosterkit.llm.rows import with_text_columns
from rosterkit.llm.words import NOT_ALPHANUMERIC, Slab, window_hashes
from rosterkit.session import stage

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


@dataclass
class Phrases:
    """One block of the benchmark: its words by hash, distinct windows by length, and the items of each window."""

    words: np.ndarray
    by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    ids: list[str | None]
    shortest: int


def phrases_of(ids: list, texts: list[str | None], window: int) -> Phrases:
    slab = Slab(texts, NOT_ALPHANUMERIC, lower=True)
    words, symbol = np.unique(slab.hashes, return_inverse=True)
    counts = slab.counts()
    by_length = []
    for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        at = np.concatenate([np.arange(f, f + (n - window + 1 if length == window else 1))
                             for f, n in zip(slab.first, counts) if n and min(n, window) == length])
        item = np.searchsorted(slab.first, at, side="right") - 1
        rows = symbol[at[:, None] + np.arange(length)] + 1
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        by_length.append((length, distinct, item[order], cuts))
    return Phrases(words, by_length, ids, min((x[0] for x in by_length), default=window))


def _runs(symbol: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words within one text that can hold a phrase: the sequence with a 0 behind each, and its places."""
    known = symbol > 0
    cut = np.flatnonzero(np.concatenate([[True], (known[1:] != known[:-1]) | (owner[1:] != owner[:-1]), [True]]))
    starts, sizes = cut[:-1], np.diff(cut)
    use = known[starts] & (sizes >= shortest) if len(symbol) else np.zeros(0, dtype=bool)
    starts, sizes = starts[use], sizes[use] + 1
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    sequence = symbol[np.minimum(places, max(0, len(symbol) - 1))]
    sequence[np.cumsum(sizes) - 1] = 0
    return sequence, places


def search_shard(slab: Slab, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the shard are covered, and the (text, item) pairs that occur, each once."""
    covered = np.zeros(len(slab.hashes) + 1, dtype=np.int32)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    if len(phrases.words) and len(slab.hashes):
        near = np.minimum(np.searchsorted(phrases.words, slab.hashes), len(phrases.words) - 1)
        symbol = np.where(phrases.words[near] == slab.hashes, near + 1, 0)
        owner = np.repeat(np.arange(len(slab.first) - 1), slab.counts())
        sequence, places = _runs(symbol, owner, phrases.shortest)
        if len(sequence):
            index = FMIndex(sequence, len(phrases.words) + 1)
            for length, rows, items, cuts in phrases.by_length:
                found, low, high = index.search(rows)
                sizes = high - low
                ranks = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                word = places[index.locate(ranks)]
                np.add.at(covered, word, 1)
                np.add.at(covered, word + length, -1)
                hits = np.unique(np.stack([owner[word], np.repeat(found, sizes)], axis=1), axis=0)
                sizes = cuts[hits[:, 1] + 1] - cuts[hits[:, 1]]
                item = items[np.repeat(cuts[hits[:, 1]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                pairs.append(np.unique(np.stack([np.repeat(hits[:, 0], sizes), item], axis=1), axis=0))
    return np.cumsum(covered)[:-1] > 0, np.unique(np.concatenate(pairs), axis=0)


def _merged(hit: np.ndarray, first: np.ndarray, earlier: list | None) -> tuple[np.ndarray, list[list[int]]]:
    """Covered words with those of earlier blocks, and the merged spans [start, end, ...] of each text."""
    for i, spans in enumerate(earlier or []):
        for start, end in zip((spans or [])[::2], (spans or [])[1::2]):
            hit[first[i] + start:first[i] + end] = True
    out = []
    for f, t in zip(first[:-1], first[1:]):
        part = np.concatenate([[False], hit[f:t], [False]])
        out.append(np.flatnonzero(part[1:] != part[:-1]).tolist() if part.any() else [])
    return hit, out


def _without(slab: Slab, spans: list[list[int]], texts: list[str | None]) -> list[str | None]:
    out = []
    for i, (found, text) in enumerate(zip(spans, texts)):
        if found:
            begin, at, parts = slab.begin[i], slab.begin[i], []
            for start, end in zip(found[::2], found[1::2]):
                parts.append(slab.buffer[at:slab.starts[slab.first[i] + start]])
                at = slab.ends[slab.first[i] + end - 1]
            parts.append(slab.buffer[at:slab.begin[i + 1] - 1])
            text = b"".join(parts).decode("utf-8", "surrogatepass")
        out.append(text)
    return out


def item_pieces(text: str | None, window: int, most: int) -> list[str | None]:
    """A long item as overlapping texts of about ``most`` characters that together have exactly its windows."""
    if text is None or len(text) <= most:
        return [text]
    words = [m.span() for m in _WORD.finditer(text)]
    out, first = [], 0
    while len(words) > window:
        last = first + window
        while last < len(words) and words[last][1] - words[first][0] <= most:
            last += 1
        out.append(text[words[first][0]:words[last - 1][1]])
        if last == len(words):
            break
        first = last - window + 1
    return out or [" ".join(text[a:b] for a, b in words)]


def benchmark_pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """``item_id, text`` of the distinct items, long ones in pieces, so that no block of them is much over its size."""
    def cut(batches):
        for batch in batches:
            made = [(i, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in item_pieces(t, window, most)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.string()), pa.array([p for _, p in made], pa.string())], names=["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return stage(items.mapInArrow(cut, "item_id string, text string").distinct(), "benchmark")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the document), ``n_words``, ``spans`` (starts and ends of hit word runs), ``items``, and ``clean_text``.

    ``clean_text`` is the text without its removal spans, all else unchanged; null unless asked for.
    """
    spark = docs.sparkSession
    items = benchmark_pieces(benchmark, window, max(1, block_bytes // 4))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    passed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
                         F.col("text").cast("string").alias("text"), F.lit(None).cast("array<long>").alias("spans"),
                         F.lit(None).cast("array<string>").alias("items"))
    for number in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        phrases = spark.sparkContext.broadcast(phrases_of([r.item_id for r in rows], [r.text for r in rows], window))
        last = number == blocks - 1

        def search(texts, earlier_spans, earlier_items, phrases=phrases, last=last):
            slab, block = Slab(texts, NOT_ALPHANUMERIC, lower=True), phrases.value
            hit, pairs = search_shard(slab, block)
            _, spans = _merged(hit, slab.first, earlier_spans)
            named = [set(x or ()) for x in earlier_items]
            for text, item in pairs.tolist():
                if block.ids[item] is not None:
                    named[text].add(block.ids[item])
            return [pa.array(slab.counts(), pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                    pa.array(_without(slab, spans, texts) if clean and last else [None] * len(texts), pa.string())]

        found = with_text_columns(passed, "n_words long, spans array<long>, items array<string>, clean_text string", search,
                                  SHARD_BYTES, ("spans", "items"),
                                  ["document"] if last else None)
        if not last:
            passed = stage(found.select("row.document", "row.text", "spans", "items"), "leaks")
    return found.select(F.col("row.document").alias("row"), "n_words", "spans", "items", "clean_text")


def hit_words(spans):
    """How many words the spans cover."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"),
                       lambda total, x: total + x)
