import numpy as np
import pytest
from pyspark.sql import functions as F
from rosterkit.llm import ann
from rosterkit.llm.ann import CentroidGraph, nearest_neighbours, squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute_force(rows, k, every):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def run(spark, rows, k=20, every=20):
    table = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in sorted(nearest_neighbours(table, F.col("id") % every == 0, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_exact_when_lists_are_few_with_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 8)))]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [1.0] * 6), (1060, [float("nan")] * 8), (1080, []),
             (1100, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    got, want = run(spark, rows), brute_force(rows, 20, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_and_split_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_SIZE", 300)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))
    x *= rng.uniform(0.5, 1.5, (6000, 1))
    x[3000:4500] = x[7]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got, want = run(spark, rows), brute_force(rows, 20, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * sum(map(len, want.values()))
    assert [i for i, _ in got[3000]] == [i for i, _ in want[3000]]


def test_ties_of_many_distinct_vectors_go_to_the_smaller_ids(spark):
    import itertools

    signs = [list(v) for v in itertools.product([1.0, -1.0], repeat=8)]
    rows = [(i, [3.0 if i == 0 else 0.0] + signs[i % 256]) for i in range(1, 400)] + [(0, [1.0] + [0.0] * 8), (40, [0.0, 1.0] + [0.0] * 7)]
    got, want = run(spark, rows, every=40), brute_force(rows, 20, 40)
    assert got == {q: want[q] for q in want}


def test_queries_whose_lists_are_sparse_still_get_all_they_ask_for(spark, monkeypatch):
    for name in ("PROBES", "LEAST_PROBES", "REPLICAS"):
        monkeypatch.setattr(ann, name, 1)
    monkeypatch.setattr(ann, "LIST_SIZE", 8)
    monkeypatch.setattr(ann, "PART_SIZE", 7)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))] + [(i, [9.0] * 6) for i in range(400, 520)]
    got, want = run(spark, rows), brute_force(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    few = [(i, v) for i, v in rows if i % 40 == 0]
    assert {q: len(g) for q, g in run(spark, few).items()} == {i: len(few) - 1 for i, _ in few}


def test_few_and_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(20, [1.0, 2.0])]) == {}
    assert run(spark, [(20, [1.0, 2.0]), (21, [1.0, 0.0]), (21, [1.0, 0.0])]) == {20: [(21, 1.0)]}


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    centroids = rng.normal(size=(500, 12))
    points = rng.normal(size=(200, 12))
    best, far = CentroidGraph.of(centroids).search(points)
    real = np.argsort(squared_distances(points, centroids), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(best, real)]) > 0.95
    assert (np.diff(far, axis=1) >= 0).all()
