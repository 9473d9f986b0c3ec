"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, cut into three segments.  Two fingerprints at most ``distance`` bits apart agree closely in
one segment at least: with radii r1, r2, r3 whose (r + 1) sum to distance + 1, they are within r of each other in some
segment.  So each distinct fingerprint is entered in a table for each segment under the segment's value, enumerates the
Hamming ball of that segment's radius as probes, and every entry that a probe meets is verified over all 64 bits.  A
probe that sets a bit finds what one that clears the bit would, so only the former are made.

Exact copies share a fingerprint and are merged first.  The matches of a table slot are verified in blocks and passed
on as a spanning forest, so a family of n near copies costs n rows, not n squared; no link between different
fingerprints is lost, because only reachability matters.  Slots that hold more than ``HOT_SLOT`` fingerprints are not
compared in one task: their fingerprints enumerate the points around them and meet there (``by_midpoints``).

Defined results: a null or empty text has fingerprint zero and links like any other; equal rows share a component; a
null id never names a component unless all its ids are null; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterkit.llm.components import connected_components
from rosterkit.llm.rows import with_text_columns
from rosterkit.llm.words import Slab
from rosterkit.session import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
HOT_SLOT = 100_000  # fingerprints of a slot that are compared pair by pair
_FOREST_EDGES = 1 << 20


def radii(distance: int) -> list[int]:
    """Ball radius by segment: (r + 1) sums to distance + 1; -1 where a segment needs no table."""
    return [(distance + 1 + i) // 3 - 1 for i in range(3)][::-1]


def _joined(slab: Slab) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with exactly one space between them, and where each starts and ends."""
    lengths = slab.ends - slab.starts
    inside = np.zeros(len(slab.data) + 2, dtype=np.int8)
    inside[slab.starts] += 1
    inside[slab.ends + 1] -= 1
    data = np.concatenate([slab.data, [np.uint8(0x20)]])
    data[slab.ends] = 0x20
    text = data[np.cumsum(inside, dtype=np.int8)[:len(data)].astype(bool)].tobytes()
    ends = np.cumsum(lengths + 1) - 1
    return text, ends - lengths, ends


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    from xxhash import xxh64_intdigest

    slab = Slab(texts, lower=True)
    text, starts, ends = _joined(slab)
    view = memoryview(text)
    words = slab.counts()
    shingles = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(words)), shingles)
    firsts = slab.first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(shingles) - shingles)[owner]
    lasts = np.minimum(firsts + shingle, slab.first[1:][owner]) - 1
    hashes = np.fromiter((xxh64_intdigest(view[s:e], SEED) for s, e in zip(starts[firsts].tolist(), ends[lasts].tolist())),
                         dtype=np.uint64, count=len(owner))
    out, weights = np.zeros(len(words), dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)
    at = 0
    for i, n in enumerate(shingles.tolist()):
        if n:
            ones = np.zeros(64, dtype=np.int64)
            for lo in range(at, at + n, 1 << 16):
                part = hashes[lo:min(at + n, lo + (1 << 16))]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * ones > n].sum(dtype=np.uint64)
            at += n
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the ``keep`` columns) and ``fp``, the fingerprint of the text as a long (two's complement)."""
    return with_text_columns(docs, "fp long", lambda texts: [pa.array(fingerprints(texts, shingle).view(np.int64))], keep=keep)


def _segment(column, low: int, bits: int):
    return F.shiftrightunsigned(column, low).bitwiseAND((1 << bits) - 1)


def slots(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``slot, fp, probe``: every entry and probe of the segment tables; a slot is a segment and a value."""
    fp = F.col("fp")
    made = []
    for number, ((low, bits), radius) in enumerate(zip(SEGMENTS, radii(distance))):
        if radius < 0:
            continue
        value = _segment(fp, low, bits) + F.lit(number << 40)
        made.append(F.array(F.struct(value.alias("slot"), F.lit(False).alias("probe"))))
        flips = [()]
        for size in range(1, radius + 1):
            flips = [(*f, i) for f in flips for i in range(f[-1] + 1 if f else 0, bits)]
            if size == 1:
                made.append(F.transform(
                    F.filter(F.array(*[F.lit(1 << i).cast("long") for (i,) in flips]), lambda bit: value.bitwiseAND(bit) == 0),
                    lambda bit: F.struct(value.bitwiseOR(bit).alias("slot"), F.lit(True).alias("probe"))))
            else:
                masks = F.array(*[F.lit(sum(1 << i for i in f)).cast("long") for f in flips])
                made.append(F.transform(masks, lambda mask: F.struct(value.bitwiseXOR(mask).alias("slot"), F.lit(True).alias("probe"))))
    return distinct.select("fp", F.explode(F.concat(*made)).alias("at")).select("at.slot", "fp", "at.probe")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect, one for each node but one of a component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[member]], nodes[member]


def _linked(slot: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links between the entries of each slot and all that stands in it.

    Rows are sorted by slot, entries before probes.
    """
    n = len(slot)
    size = np.diff(np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])))
    last = np.repeat(np.cumsum(size), size) if n else size
    entry = np.flatnonzero(~probe & (last - np.arange(n) > 1))
    found, edges = [], 0
    step = 1
    while len(entry):
        a, b = fp[entry], fp[entry + step]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        if near.any():
            found.append((a[near], b[near]))
            edges += int(near.sum())
            if edges > _FOREST_EDGES:
                found = [_forest(*(np.concatenate(x) for x in zip(*found)))]
                edges = len(found[0][0])
        step += 1
        entry = entry[entry + step < last[entry]]
    if not found:
        return fp[:0], fp[:0]
    return _forest(*(np.concatenate(x) for x in zip(*found)))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp`` that connect all pairs within ``distance`` bits."""
    def verify(batches: Iterator[pa.RecordBatch]):
        rest = None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64),
                    batch.column(2).to_numpy(zero_copy_only=False)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part)]
            cut = int(np.searchsorted(part[0], part[0][-1])) if len(part[0]) else 0
            rest = [x[cut:] for x in part]
            if cut:
                yield edges(*(x[:cut] for x in part))
        if rest is not None and len(rest[0]):
            yield edges(*rest)

    def edges(slot, fp, probe):
        a, b = _linked(slot, fp, probe, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = slots(distinct, distance)
    # A slot that many fingerprints share would be compared pair by pair in one task: those go by midpoints.
    entries = distinct.select(F.explode(F.array(*[_segment(F.col("fp"), low, bits) + F.lit(n << 40) for n, (low, bits) in enumerate(SEGMENTS)])).alias("slot"))
    hot = stage(entries.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SLOT).select("slot"), "hot-slots")
    crowded = not hot.isEmpty()
    if crowded:  # fewer than three for each HOT_SLOT fingerprints
        near = by_midpoints(rows.join(F.broadcast(hot), "slot", "left_semi").select("fp").distinct(), distance)
        rows = rows.join(F.broadcast(hot), "slot", "left_anti")
    found = rows.repartition("slot").sortWithinPartitions("slot", "probe").mapInArrow(verify, "a long, b long")
    return found.unionByName(near) if crowded else found


def _ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed numbers."""
    masks = [sum(1 << i for i in bits) for size in range(radius + 1) for bits in itertools.combinations(range(64), size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def by_midpoints(members: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints ``fp`` within ``distance`` bits, without comparing pairs.

    Two fingerprints within the distance have a point within half of it from one and the rest from the other, and two that
    share such a point are within the distance. So each is sent to all points around it, and a point links what it gets,
    which is at most as much as there are points around it.
    """
    half = distance // 2

    def sent_within(radius: int, close: bool) -> DataFrame:
        masks = F.split(F.lit(",".join(map(str, _ball(radius)))), ",").cast("array<long>")
        points = F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp"))))
        return members.select("fp", points.alias("point"), F.lit(close).alias("close"))

    sent = sent_within(distance - half, half == distance - half)
    if half < distance - half:
        sent = sent.unionByName(sent_within(half, True))
    met = sent.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
    return met.filter((F.size("all") > 1) & F.col("a").isNotNull()).select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component is the smallest id reachable over links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = stage(with_fingerprints(docs, shingle, ["doc_id"]).select("row.doc_id", "fp"), "fingerprints")
    return own.join(fingerprint_components(own, distance), "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``row`` of one document of each component: the smallest id, null ids last."""
    numbered = with_fingerprints(docs, shingle).withColumn("number", F.monotonically_increasing_id())
    own = stage(numbered, "fingerprints")  # written, so the numbers are fixed
    doc_id = F.col("row.doc_id").cast("long")
    first = own.groupBy("fp").agg(F.min(F.struct(doc_id.isNull().alias("unnamed"), doc_id.alias("doc_id"), "number")).alias("first"))
    roots = fingerprint_components(own.select(doc_id.alias("doc_id"), "fp"), distance).select("fp", "root")
    kept = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.number")
    return own.join(kept, "number", "left_semi").select("row")


def fingerprint_components(own: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, root, component_id`` of every distinct fingerprint of the staged rows ``doc_id, fp``."""
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = connected_components(links(distinct.select("fp"), distance))
    rooted = stage(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
                   .select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.select("fp", "root").join(named, "root")
