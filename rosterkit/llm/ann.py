"""Approximate nearest neighbours by balanced posting lists, for the largest inner product.

Vectors get one more component, sqrt(M^2 - |x|^2) with the largest norm M, and queries a zero: the nearest vector by
distance is then the one with the largest inner product.  Centroids are fitted on a bounded sample by k-means that
charges for full lists.  Every vector is then put in its nearest list, and boundary vectors also in others that are
almost as near.  The centroids fit in memory; a graph of each one's neighbours is searched best-first to assign vectors
and to select the lists of a query, which are those within a distance ratio of the nearest.  A list that is still too
long (copies of one vector, for instance) is split into parts and a query visits all parts; the queries of a list that
many ask for are dealt to slices.  So no row is left out and no task gets an unbounded group.  A query whose lists hold
fewer vectors than it asks for looks into all lists.

Defined results: vectors that are null, all zero, of another length than most, without id, or with null or non-finite
components take no part; equal vectors tie by id; a repeated id counts once, with its best score; fewer candidates than
asked give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterkit.session import stage

SAMPLE = 20_000
LIST_SIZE = 200
MOST_LISTS = 4096
PART_SIZE = 4096
REPLICAS, REPLICA_RATIO = 4, 1.12
PROBES, LEAST_PROBES, PROBE_RATIO = 48, 12, 1.35
NEIGHBOURS, BEAM = 16, 64
_BLOCK = 512


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        vector, lambda x: x != 0)


def balanced_kmeans(points: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of lists of about the same length: a list's distance rises as it fills."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)].copy()
    charge = np.zeros(len(centroids))
    for _ in range(rounds):
        nearest, spread = np.empty(len(points), dtype=np.int64), 0.0
        for at in range(0, len(points), _BLOCK):
            distance = squared_distances(points[at:at + _BLOCK], centroids)
            nearest[at:at + _BLOCK] = np.argmin(distance + charge, axis=1)
            spread += float(distance.min(axis=1).sum())
        counts = np.bincount(nearest, minlength=len(centroids))
        charge = 0.5 * charge + 0.1 * spread / len(points) * np.log((counts + 1) / (len(points) / len(centroids) + 1))
        for d in range(points.shape[1]):
            sums = np.bincount(nearest, points[:, d], len(centroids))
            centroids[:, d] = np.where(counts > 0, sums / np.maximum(counts, 1), centroids[:, d])
    return centroids


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1), 0)


@dataclass
class CentroidGraph:
    """Centroids, each linked to its nearest ones and some links between far parts, and where every search starts."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, seed: int = 3) -> CentroidGraph:
        n = len(centroids)
        near = min(NEIGHBOURS, n)
        links = np.empty((n, near + 2), dtype=np.int64)
        rng = np.random.default_rng(seed)
        for at in range(0, n, _BLOCK):
            links[at:at + _BLOCK, :near] = np.argsort(squared_distances(centroids[at:at + _BLOCK], centroids), axis=1)[:, :near]
        links[:, near:] = rng.integers(0, n, (n, 2))
        return cls(centroids, links, rng.choice(n, min(n, 8), replace=False))

    def search(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids that best-first search meets, nearest first, and their squared distances."""
        n, beam = len(self.centroids), min(beam, len(self.centroids))
        rows = np.arange(len(points))
        norms = (self.centroids ** 2).sum(axis=1)
        own = (points ** 2).sum(axis=1)
        met, opened = np.zeros((len(points), n), dtype=bool), np.zeros((len(points), n), dtype=bool)
        best = np.full((len(points), beam), -1)
        far = np.full((len(points), beam), np.inf)
        fresh = np.tile(self.entries, (len(points), 1))
        while len(rows):
            new = ~met[rows[:, None], fresh]
            # the same centroid may be offered twice in one round
            order = np.argsort(fresh, axis=1, kind="stable")
            ranked = np.take_along_axis(fresh, order, axis=1)
            again = np.zeros_like(new)
            np.put_along_axis(again, order, np.concatenate([np.zeros((len(rows), 1), bool), ranked[:, 1:] == ranked[:, :-1]], axis=1), axis=1)
            new &= ~again
            met[rows[:, None], fresh] = True
            dots = np.einsum("qd,qkd->qk", points[rows], self.centroids[fresh])
            distance = np.where(new, np.maximum(own[rows, None] - 2 * dots + norms[fresh], 0), np.inf)
            every = np.concatenate([best[rows], np.where(new, fresh, -1)], axis=1)
            every_far = np.concatenate([far[rows], distance], axis=1)
            order = np.argsort(every_far, axis=1, kind="stable")[:, :beam]
            best[rows], far[rows] = np.take_along_axis(every, order, axis=1), np.take_along_axis(every_far, order, axis=1)
            closed = opened[rows[:, None], best[rows]] | (best[rows] < 0)
            going = ~closed.all(axis=1)
            rows = rows[going]
            chosen = best[rows, np.argmin(closed[going], axis=1)]
            opened[rows, chosen] = True
            fresh = self.links[chosen]
        return best, far


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _lists(graph: CentroidGraph, points: np.ndarray, most: int, least: int, ratio: float):
    """(row, list) pairs: lists within ``ratio`` of the nearest distance, at least ``least`` and at most ``most``."""
    rows, lists = [], []
    for at in range(0, len(points), _BLOCK):
        best, far = graph.search(points[at:at + _BLOCK])
        best, far = best[:, :most], far[:, :most]
        chosen = (far <= far[:, :1] * ratio ** 2 + 1e-12) | (np.arange(best.shape[1]) < least)
        row, place = np.nonzero(chosen & (best >= 0))
        rows.append(row + at)
        lists.append(best[row, place])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *lists])


def _nearest_in_part(queries: pa.Table, members: pa.Table, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best of one part for each query; exact over the part."""
    q_ids, x_ids = queries.column("id").to_numpy(), members.column("id").to_numpy()
    q, x = (_vectors(t.column("vector").combine_chunks(), dimension) for t in (queries, members))
    distinct, place = np.unique(x, axis=0, return_inverse=True)
    place = place.reshape(-1)
    order = np.lexsort((x_ids, place))
    cuts = np.searchsorted(place[order], np.arange(len(distinct) + 1))
    copies = np.minimum(np.diff(cuts), k + 1)  # the smallest ids of equal vectors, and one more for the query itself
    lengths, longest = np.sqrt((q * q).sum(axis=1)), np.sqrt((distinct * distinct).sum(axis=1).max())
    out = []
    for at in range(0, len(q), _BLOCK):
        scores = q[at:at + _BLOCK] @ distinct.T
        # One of the k + 1 best may be the query itself; vectors that tie with the last of them all stay.
        last = min(k + 1, len(distinct)) - 1
        bound = -np.partition(-scores, last, axis=1)[:, last]
        bound = bound - 1e-9 * (longest * lengths[at:at + _BLOCK]) - 1e-300
        query, flat = np.nonzero(scores >= bound[:, None])
        sizes = copies[flat]
        row = np.repeat(query, sizes)
        member = order[np.repeat(cuts[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        ids, mine = x_ids[member], q_ids[at + row]
        other = ids != mine
        row, ids, member = row[other], ids[other], member[other]
        exact = (q[at + row] * x[member]).sum(axis=1)
        rank = np.lexsort((ids, -exact, row))
        row, ids, exact = row[rank], ids[rank], exact[rank]
        first = np.searchsorted(row, np.arange(len(scores)))
        keep = np.arange(len(row)) - first[row] < k
        out.append((q_ids[at + row[keep]], ids[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id",
                       vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows for which ``is_query`` (over ``id``), against all other rows."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    given = given.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = given.groupBy(F.size("vector").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).orderBy(F.desc("n"), "d").first()
    result = "query_id long, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, rows, top = lengths.d, lengths.n, lengths.top
    given = given.filter(F.size("vector") == dimension)
    share = min(1.0, SAMPLE / rows)
    drawn = given.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("vector").distinct()
    sample = np.array([r.vector for r in drawn.collect()], dtype=np.float64).reshape(-1, dimension)

    def raised(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    lists = int(min(MOST_LISTS, max(1, rows // LIST_SIZE), max(1, len(sample) // 8)))
    graph = spark.sparkContext.broadcast(CentroidGraph.of(balanced_kmeans(raised(sample), lists) if len(sample) else np.zeros((1, dimension + 1))))

    def posted(most, least, ratio, points_of):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _vectors(batch.column(1), dimension)
                    row, number = _lists(graph.value, points_of(x), most, least, ratio)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number, pa.int64()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                        names=["list", "id", "vector"])
        return run

    def without_norm(x):
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    schema = "list long, id long, vector array<double>"
    index = stage(given.mapInArrow(posted(REPLICAS, 1, REPLICA_RATIO, raised), schema), "postings")
    queries = given.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    wanted = stage(queries.mapInArrow(posted(PROBES, LEAST_PROBES, PROBE_RATIO, without_norm), schema), "probes")
    parts = np.ones(len(graph.value.centroids), dtype=np.int64)
    for r in index.groupBy("list").count().collect():  # at most MOST_LISTS rows
        parts[r["list"]] = -(-r["count"] // PART_SIZE)

    def of_list(numbers: np.ndarray) -> Column:
        return F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), F.col("list").cast("int"))

    def nearest(asked_part, member_part):
        made = ([], [], [])
        if asked_part.num_rows and member_part.num_rows:
            made = _nearest_in_part(asked_part, member_part, k, dimension)
        return pa.Table.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.float64())],
                                    names=["query_id", "vec_id", "score"])

    def search(wanted: DataFrame) -> DataFrame:
        """The k best of every part for every (list, id, vector) that asks for a list.

        The queries of a list are dealt to slices of bounded size, and each slice meets each part of the list.
        """
        slices = np.ones(len(parts), dtype=np.int64)
        for r in wanted.groupBy("list").count().collect():  # at most MOST_LISTS rows
            slices[r["list"]] = -(-r["count"] // PART_SIZE)
        part = F.pmod(F.xxhash64("id", "vector"), of_list(parts)).cast("int")
        members = index.withColumn("part", part).withColumn("slice", F.explode(F.sequence(F.lit(0), of_list(slices) - 1)))
        asked = wanted.withColumn("slice", F.pmod(F.xxhash64("id"), of_list(slices)).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), of_list(parts) - 1)))
        at = ["list", "part", "slice"]
        return asked.groupBy(*at).cogroup(members.groupBy(*at)).applyInArrow(nearest, result)

    found = stage(search(wanted), "near")
    # Lists may hold fewer vectors than asked for (small lists, repeated ids): such queries look into every list.
    others = given.select("id").distinct().count() - 1
    full = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= min(k, others))
    short = stage(queries.join(full, queries["id"] == full["query_id"], "left_anti"), "short")
    if others > 0 and not short.isEmpty():
        lists_of = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(parts) - 1).cast("long")))
        found = found.unionByName(search(stage(short.select(lists_of.alias("list"), "id", "vector"), "every-list")))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "near")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "near.vec_id", (-F.col("near.minus")).alias("score"))
