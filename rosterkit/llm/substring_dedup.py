"""Exact substring dedup by fixed-block anchors.

A repeat of ``window`` words always holds one whole block of a grid of half that size.  So only the non-overlapping
blocks of each text are indexed, and every rolling window of block size probes them.  Blocks that some other place also
holds are anchors.  Around each anchor the hit is extended: all windows that hold it are compared, by a 64-bit hash,
with the windows around the other anchors; adjoining windows found elsewhere merge to the maximal exact repeats, and
their words are removed.

Both comparisons are exchanges of packed hashes (``chunks``): no pairs of places are formed, so a passage that a
thousand documents share costs a thousand entries.  An anchor is judged by 32 bits and its bucket, which may only add
candidates; what is removed is decided by 64-bit hashes of whole windows.

Defined results: null and empty texts have no words; documents shorter than the window lose nothing; equal rows repeat
each other; the first occurrence is removed like the others; extra columns are ignored; null ids stay null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterkit.llm.chunks import bucket_count, by_bucket, chunk_rows, write_chunks
from rosterkit.llm.words import Slab
from rosterkit.session import stage

WINDOW = 35
_LOW = np.uint64(0xFFFFFFFF)
_QUESTIONS = "bucket int, chunk long, told binary, asked binary"
_ANSWERS = "chunk long, bucket int, payload binary"
_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _grid(slab: Slab, block: int) -> np.ndarray:
    """First words of the whole blocks of each text."""
    counts = slab.counts() // block
    firsts = np.repeat(slab.first[:-1], counts)
    number = np.arange(len(firsts)) - np.repeat(np.cumsum(counts) - counts, counts)
    return firsts + number * block


def _twice(values: np.ndarray) -> np.ndarray:
    """Sorted values, each at most twice: more of them say no more."""
    values = np.sort(values)
    return values[~np.concatenate([[False, False], values[2:] == values[:-2]])] if len(values) > 2 else values


def _anchor_questions(slab: Slab, block: int, buckets: int):
    """Probes (all rolling windows) and index (the grid's blocks), and how the blocks were dealt."""
    at, rolling = slab.windows(block)
    grid = _grid(slab, block)
    blocks = rolling[np.searchsorted(at, grid)]
    return _twice(rolling), grid, blocks, by_bucket(blocks, buckets)


def _candidates(slab: Slab, window: int, block: int, grid: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows that hold a hit block."""
    at, hashes = slab.windows(window)
    near = np.zeros(len(slab.hashes) + 2, dtype=np.int32)
    starts = grid[hit]
    np.add.at(near, np.maximum(starts - (window - block), 0), 1)
    np.add.at(near, starts + 1, -1)
    chosen = np.cumsum(near)[at] > 0
    return at[chosen], hashes[chosen]


def _bits(table: pa.Table, order, cuts) -> np.ndarray:
    out = np.zeros(len(order), dtype=bool)
    for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
        part = order[cuts[bucket]:cuts[bucket + 1]]
        out[part] = np.unpackbits(np.frombuffer(payload, np.uint8), count=len(part)).astype(bool)
    return out


def _rows(chunk: int, told: list[bytes], asked: list[bytes], batch: bool = True):
    keep = [i for i, (t, a) in enumerate(zip(told, asked)) if t or a]
    made = [pa.array(keep, pa.int32()), pa.array([chunk] * len(keep), pa.int64()),
            pa.array([told[i] for i in keep], pa.binary()), pa.array([asked[i] for i in keep], pa.binary())]
    kind = pa.RecordBatch if batch else pa.Table
    return kind.from_arrays(made, names=["bucket", "chunk", "told", "asked"])


def _marked(asked: list[np.ndarray], values: np.ndarray) -> list[bytes]:
    """For each array the bits of its entries that are among the sorted ``values``."""
    every = np.concatenate(asked)
    found = np.zeros(len(every), dtype=bool)
    if len(values):
        found = values[np.minimum(np.searchsorted(values, every), len(values) - 1)] == every
    return [np.packbits(x).tobytes() for x in np.split(found, np.cumsum([len(x) for x in asked])[:-1])]


def _repeated_blocks(table):
    """Answer one bucket: which blocks were probed at two places or more (their own place is one)."""
    told = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("told").to_pylist()]))
    twice = np.unique(told[1:][told[1:] == told[:-1]])
    return _answer(table, _marked([np.frombuffer(x, np.uint32) for x in table.column("asked").to_pylist()], twice))


def _repeated_windows(table):
    """Answer one bucket: which windows occur more than once, in one chunk or in several."""
    told = [np.frombuffer(x, np.uint64) for x in table.column("told").to_pylist()]
    own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)).astype(bool)
           for x, t in zip(table.column("asked").to_pylist(), told)]
    every = np.sort(np.concatenate(told + [t[o] for t, o in zip(told, own)]))
    return _answer(table, _marked(told, np.unique(every[1:][every[1:] == every[:-1]])))


def _answer(table: pa.Table, payloads: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array(payloads, pa.binary())],
                                names=["chunk", "bucket", "payload"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: ``kept`` is what is left, words joined by one space.

    A word goes if a run of ``window`` words of its text that covers it also starts at any other place of any text.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    buckets = bucket_count(spark)
    chunks = write_chunks(docs)

    def probe(batches):
        for batch in batches:
            for chunk, _, texts in chunk_rows(batch):
                told, _, blocks, (order, cuts) = _anchor_questions(Slab(texts), block, buckets)
                dealt, at = by_bucket(told, buckets)
                low, asked = (told[dealt] & _LOW).astype(np.uint32), (blocks[order] & _LOW).astype(np.uint32)
                yield _rows(chunk, [low[at[b]:at[b + 1]].tobytes() for b in range(buckets)],
                            [asked[cuts[b]:cuts[b + 1]].tobytes() for b in range(buckets)])

    anchors = stage(chunks.mapInArrow(probe, _QUESTIONS).groupBy("bucket").applyInArrow(_repeated_blocks, _ANSWERS),
                    "anchors").withColumn("round", F.lit(1))

    def located(chunk_table, answers):
        """The chunk, its text, the candidate windows, and the distinct ones as they are dealt."""
        (chunk, ids, texts), = chunk_rows(chunk_table)
        slab = Slab(texts)
        _, grid, _, (order, cuts) = _anchor_questions(slab, block, buckets)
        hit = _bits(answers.filter(pa.compute.equal(answers.column("round"), 1)), order, cuts)
        at, hashes = _candidates(slab, window, block, grid, hit)
        distinct, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return chunk, ids, slab, at, distinct, place, counts, by_bucket(distinct, buckets)

    def extend(chunk_table, answers):
        chunk, _, _, _, distinct, _, counts, (order, cuts) = located(chunk_table, answers)
        told, own = distinct[order], counts[order] > 1
        return _rows(chunk, [told[cuts[b]:cuts[b + 1]].tobytes() for b in range(buckets)],
                     [np.packbits(own[cuts[b]:cuts[b + 1]]).tobytes() for b in range(buckets)], batch=False)

    def cut(chunk_table, answers):
        _, ids, slab, at, distinct, place, _, (order, cuts) = located(chunk_table, answers)
        again = _bits(answers.filter(pa.compute.equal(answers.column("round"), 2)), order, cuts)
        covered = np.zeros(len(slab.hashes) + window + 1, dtype=np.int32)
        starts = at[again[place]]
        covered[starts] += 1
        covered[starts + window] -= 1
        return _result(ids, slab, np.cumsum(covered)[:len(slab.hashes)] > 0)

    by_chunk = chunks.groupBy("chunk")
    windows = stage(by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(extend, _QUESTIONS)
                    .groupBy("bucket").applyInArrow(_repeated_windows, _ANSWERS), "windows").withColumn("round", F.lit(2))
    answers = anchors.unionByName(windows)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(cut, _RESULT)


def _result(ids: list, slab: Slab, removed: np.ndarray) -> pa.Table:
    """Rows of one chunk: the kept words of each text, each followed by one space but the last."""
    counts = slab.counts()
    owner = np.repeat(np.arange(len(counts)), counts)
    n_removed = np.bincount(owner[removed], minlength=len(counts))
    starts, ends = slab.starts[~removed], slab.ends[~removed]
    inside = np.zeros(len(slab.data) + 2, dtype=np.int8)
    inside[starts] += 1
    inside[ends + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:len(slab.data) + 1].astype(bool)
    data = np.concatenate([slab.data, [np.uint8(0x20)]])
    data[ends] = 0x20
    text = data[inside]
    sizes = np.bincount(owner[~removed], weights=ends - starts + 1, minlength=len(counts)).astype(np.int64)
    raw, stops = text.tobytes(), np.cumsum(sizes)
    kept = [raw[stop - size:max(stop - 1, stop - size)].decode() for stop, size in zip(stops.tolist(), sizes.tolist())]
    return pa.Table.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept"])
