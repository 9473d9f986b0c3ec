"""Vector code compression: product codebooks fitted in integers, with LAESA pivots for the nearest entry.

Each vector becomes integers and is cut into consecutive parts; each part position has a codebook of entries and a part is
coded by its nearest entry.  Some parts per position are fixed pivots.  The distances of every part to its pivots are
computed once and written next to the integers.  In each round the entries' distances to the same pivots give a lower
bound of every part-to-entry distance, ``max |d(part, pivot) - d(entry, pivot)|``.  Exact integer distances are evaluated
in the order of the bounds, in growing steps, until the next bound is beyond the nearest entry so far.  Pruning
keeps a margin for rounding and keeps equal bounds, so the result is that of comparing all entries.

Rows are never shuffled by content: a task sums its parts per entry and one small row per task, part position and entry
goes to the grouped sum.  The driver holds codebooks and pivots only, which do not grow with the rows.

Defined results: vectors that are null, empty, of another length than most (of equally frequent lengths the shorter), or
with null or non-finite components take no part; lengths that the number of parts does not divide are cut at the floors
of their fractions; scaled components are held within 2**24, so that all sums fit a long; of equal ids the smaller
vectors come first into the codebook, null ids last; fewer rows than entries give fewer entries; repeated rows count each
time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterkit.operators.joins import join_small
from rosterkit.session import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
SCALE = 1024
LIMIT = 1 << 24
_BLOCK = 2048      # parts whose bounds are in memory at once
_FIRST = 2         # entries that the first step of exact evaluations takes; each next step takes twice as many
_MARGIN = 1e-6


def finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def bounds_of(dimension: int, parts: int) -> list[int]:
    return [dimension * p // parts for p in range(parts + 1)]


def exact_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to integer rows, in integers."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(exact_distances(x, pivots).astype(np.float64))


def spread_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: each next pivot has the largest sum of distances to those before, as LAESA takes them."""
    distinct = np.unique(entries, axis=0)
    chosen = [0]
    total = np.zeros(len(distinct))
    while len(chosen) < min(count, len(distinct)):
        total += pivot_distances(distinct, distinct[chosen[-1:]])[:, 0]
        total[chosen] = -1
        chosen.append(int(np.argmax(total)))
    return distinct[chosen]


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (ties: the lower), its squared distance, and how many distances were evaluated."""
    code, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    of_entries = pivot_distances(entries, pivots)
    evaluated = 0
    for at in range(0, len(x), _BLOCK):
        part, here = x[at:at + _BLOCK], to_pivots[at:at + _BLOCK]
        lower = np.zeros((len(part), len(entries)))
        for p in range(of_entries.shape[1]):
            np.maximum(lower, np.abs(here[:, p, None] - of_entries[None, :, p]), out=lower)
        lower = np.maximum(lower - _MARGIN, 0) ** 2 * (1 - _MARGIN)
        order = np.argsort(lower, axis=1)
        lower = np.take_along_axis(lower, order, axis=1)
        choice = np.full(len(part), len(entries))
        far = np.full(len(part), np.iinfo(np.int64).max)
        rows, done, step = np.arange(len(part)), 0, _FIRST
        while len(rows):
            tried = order[rows, done:done + step]
            distance = ((part[rows, None, :] - entries[tried]) ** 2).sum(axis=2)
            evaluated += distance.size
            least = distance.min(axis=1)
            lead = np.where(distance == least[:, None], tried, len(entries)).min(axis=1)
            better = (least < far[rows]) | ((least == far[rows]) & (lead < choice[rows]))
            far[rows[better]], choice[rows[better]] = least[better], lead[better]
            done, step = done + step, 2 * step
            if done >= len(entries):
                break
            rows = rows[lower[rows, done] <= far[rows]]  # the bounds rise, so the first one decides
        code[at:at + _BLOCK], best[at:at + _BLOCK] = choice, far
    return code, best, evaluated


@dataclass
class Codebooks:
    """Entries and pivots of every part position."""

    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    def digest(self) -> str:
        """Lowercase hex SHA-256 of all components as decimal integers, by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _integers(vector: Column) -> Column:
    scaled = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)))
    return scaled.cast("array<int>")


def _assigned(batch: pa.RecordBatch, cuts: list[int], books: Codebooks):
    """``part, integers of the parts, codes, squared distances`` of a batch's rows."""
    x = _matrix(batch.column("x"), cuts[-1]).astype(np.int64)
    ends = np.cumsum([0, *[len(p) for p in books.pivots]])
    far = _matrix(batch.column("far"), int(ends[-1]))
    for p, entries in enumerate(books.entries):
        piece = x[:, cuts[p]:cuts[p + 1]]
        yield p, piece, *nearest_entries(piece, far[:, ends[p]:ends[p + 1]], entries, books.pivots[p])[:2]


def _summed(work: DataFrame, cuts: list[int], books) -> DataFrame:
    """``part, entry, position, total, n`` of one assignment, summed in each task before the grouped sum."""
    def run(batches):
        totals = [np.zeros(e.shape, dtype=np.int64) for e in books.value.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in books.value.entries]
        for batch in batches:
            if batch.num_rows:
                for p, piece, code, _ in _assigned(batch, cuts, books.value):
                    np.add.at(totals[p], code, piece)
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p, (total, n) in enumerate(zip(totals, counts)):
            entry, position = (i.ravel() for i in np.indices(total.shape))
            used = n[entry] > 0
            if used.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(used.sum()), p), pa.int32()), pa.array(entry[used], pa.int32()), pa.array(position[used], pa.int32()),
                     pa.array(total.ravel()[used]), pa.array(n[entry[used]])], names=["part", "entry", "position", "total", "n"])

    sums = work.select("x", "far").mapInArrow(run, "part int, entry int, position int, total long, n long")
    return sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit_codebooks(given: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                  pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """The rows of ``given`` (with integers ``x``) with their pivot distances, written once, and the fitted codebooks."""
    spark = given.sparkSession
    cuts = bounds_of(dimension, parts)
    first = given.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r.x for r in first], dtype=np.int64).reshape(-1, dimension)
    books = Codebooks([start[:, a:b] for a, b in zip(cuts, cuts[1:])], [])
    books.pivots = [spread_pivots(e, pivots) for e in books.entries]
    shared = spark.sparkContext.broadcast(books)

    def measured(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dimension).astype(np.int64)
            far = np.concatenate([pivot_distances(x[:, a:b], p) for a, b, p in zip(cuts, cuts[1:], shared.value.pivots)], axis=1)
            column = pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1], far.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "far"])

    work = stage(given.mapInArrow(measured, T.StructType([*given.schema, T.StructField("far", T.ArrayType(T.DoubleType()))])), "vector-parts")
    for _ in range(rounds):
        rows = _summed(work, cuts, spark.sparkContext.broadcast(books)).collect()  # at most entries x dimension rows
        fresh = [e.copy() for e in books.entries]
        for r in rows:
            fresh[r.part][r.entry, r.position] = r.total // r.n
        books = Codebooks(fresh, books.pivots)
    return work, books


def compress_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                     parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """``id, label, codes (array<int>), error`` of every usable vector, written once, and the codebooks."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"),
                           F.col(vector_column).alias("v")).filter(finite(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = T.StructType([given.schema["id"], given.schema["label"], T.StructField("codes", T.ArrayType(T.IntegerType())),
                           T.StructField("error", T.LongType())])
    if lengths is None:
        return spark.createDataFrame([], schema), Codebooks([], [])
    given = given.filter(F.size("v") == lengths.d).select("id", "label", _integers(F.col("v")).alias("x"))
    work, books = fit_codebooks(given, lengths.d, parts, entries, rounds, pivots)
    cuts, shared = bounds_of(lengths.d, parts), spark.sparkContext.broadcast(books)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                found = [(code, far) for _, _, code, far in _assigned(batch, cuts, shared.value)]
                codes = np.stack([code for code, _ in found], axis=1)
                column = pa.ListArray.from_arrays(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1], codes.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), column, pa.array(sum(far for _, far in found))],
                                                 names=["id", "label", "codes", "error"])

    return stage(work.mapInArrow(coded, schema), "vector-codes"), books


def written(codes: Column, digits: int = 2) -> Column:
    """Codes as lowercase hex numbers of equal length, one after the other."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over the rows of equal label, nulls together.

    The sums combine before the shuffle; they are broadcast if they are small, else a frequent label is salted.
    """
    place = F.struct("label").alias("_label")  # compared as a whole, so null meets null
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(place, "label_error"), "label-errors")
    return join_small(coded.select("*", place), sums, ["_label"], salt_by=["id", "codes"]).drop("_label")
