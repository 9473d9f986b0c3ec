import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rosterkit.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long"


def brute_force(rows, entries=256, rounds=4, parts=4):
    """vec_id, code, error, label_error, digest of usable rows by comparing everything with everything."""
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(1024 * x)) for x in r[1]]))
    x = np.floor(np.array([v for _, v, _ in good]) * 1024).astype(np.int64)
    cuts = [x.shape[1] * p // parts for p in range(parts + 1)]
    codes, errors, books = [], 0, []
    for a, b in zip(cuts, cuts[1:]):
        piece = x[:, a:b]
        book = piece[:entries].copy()
        for r in range(rounds + 1):
            far = ((piece[:, None] - book[None]) ** 2).sum(axis=2)
            code = far.argmin(axis=1)
            if r < rounds:
                for e in set(code.tolist()):
                    book[e] = piece[code == e].sum(axis=0) // int((code == e).sum())
        codes.append(code)
        errors = errors + far.min(axis=1)
        books += [str(v) for v in book.ravel().tolist()]
    sums = {}
    for (_, _, label), e in zip(good, errors.tolist()):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return [(i, "".join(f"{c[n]:02x}" for c in codes), int(errors[n]), sums[label], digest) for n, (i, _, label) in enumerate(good)]


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    coded, books = vc.compress_vectors(table, **options)
    return [(r.id, r.code, r.error, r.label_error, books.digest()) for r in vc.with_label_error(coded).withColumn(
        "code", vc.written(F.col("codes"))).collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_matches_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(rng.normal(size=(900, 16)))]
    rows += [(2000 + i, rows[3][1], 1) for i in range(200)] + [rows[5]] * 3 + [(None, rows[9][1], None)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [1.0, None] * 8, 1), (-4, [float("nan")] * 16, 2), (-5, [float("inf")] * 16, 2), (-6, [1.0] * 15, 2)]
    same(run(spark, rows), brute_force([r for r in rows if not r[1] or len(r[1]) == 16]))


def test_ties_zeros_and_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.integers(-1, 2, size=(500, 8)) / 512)] + [(900, [0.0] * 8, 1)]
    same(run(spark, rows), brute_force(rows))
    same(run(spark, rows[:20]), brute_force(rows[:20]))
    same(run(spark, rows[:1]), brute_force(rows[:1]))
    same(run(spark, rows, entries=16, rounds=2, pivots=2), brute_force(rows, entries=16, rounds=2))


def test_lengths_that_parts_do_not_divide_and_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(300, 7)))]
    same(run(spark, rows), brute_force(rows))
    assert len(run(spark, rows + [(999, [1e300, -1e300] + [1.0] * 5, 0)])) == 301


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("pivots", [1, 6])
def test_pivots_prune_and_keep_the_nearest(pivots):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, size=(256, 16))
    x = centres[rng.integers(0, 256, 5000)] + rng.integers(-60, 60, size=(5000, 16))
    chosen = vc.spread_pivots(centres, pivots)
    code, far, evaluated = vc.nearest_entries(x, vc.pivot_distances(x, chosen), centres, chosen)
    every = vc.exact_distances(x, centres)
    assert (code == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert evaluated < (0.2 if pivots == 1 else 0.02) * every.size


def test_bounds_hold_for_rounding():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 24), 1 << 24, size=(400, 16))
    entries = x[:256] + rng.integers(0, 2, size=(256, 16))
    chosen = vc.spread_pivots(entries, 6)
    code, far, _ = vc.nearest_entries(x, vc.pivot_distances(x, chosen), entries, chosen)
    every = vc.exact_distances(x, entries)
    assert (code == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
