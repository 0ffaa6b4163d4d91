"""Metric trees against plain nearest-entry search, whole results against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from formulary.llm import codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain_version(rows, parts=8, entries=16, rounds=6):
    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    kept = [(i, v, y) for i, v, y in rows if ok(v) and len(v) and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[[int(np.floor(4096 * x)) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v[p], books[p])[1] for v in cut]
            for k in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut, own) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, y), e in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{k:02x}" for _, k in f), e, by_label[y], sha) for (i, _, y), f, e in zip(kept, found, errors)
    ]


def check(spark, rows, shard_rows=codes.SHARD_ROWS, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, codes.compressed(df, shard_rows=shard_rows, **more).collect()), key=str)
    assert got == sorted(plain_version([r[:3] for r in rows], **more), key=str)
    return got


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    at = centres[rng.integers(0, 7, n)] + spread * rng.normal(size=(n, dims))
    return [(int(i), at[k].tolist(), None if k % 5 == 0 else k % 3) for k, i in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("seed,n,dims,spread,shard_rows", [(1, 700, 64, 0.3, 2048), (2, 700, 16, 0.05, 100), (3, 300, 8, 1.0, 33)])
def test_equals_the_plain_version(spark, seed, n, dims, spread, shard_rows):
    assert len(check(spark, vectors(seed, n, dims, spread), shard_rows)) == n


def test_ties_repeats_and_equal_entries(spark):
    rng = random.Random(5)
    grid = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) / 4096 for _ in range(16)] for _ in range(40)]
    rows = [(k % 50, rng.choice(grid), rng.choice([None, 1, 2])) for k in range(300)]
    check(spark, rows + rows[:40] + [(None, grid[0], 1), (None, grid[1], None)], shard_rows=64)


def test_rows_that_take_no_part(spark):
    good = vectors(6, 60, 16, 0.2)
    bad = [(100, None, 1), (101, [], 1), (102, [1.0] * 15, 1), (103, [1.0] * 24, 2), (104, [None] + [1.0] * 15, 1)]
    bad += [(-5, [float("nan")] * 16, 1), (-6, [float("inf")] * 16, 2), (-7, None, None)]
    got = check(spark, bad + good)
    assert len(got) == 60


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 8, None)], vectors(7, 5, 8, 0.1)])
def test_few_or_no_vectors(spark, rows):
    check(spark, rows)


def test_all_vectors_equal(spark):
    check(spark, [(k, [0.25] * 8, 1) for k in range(500)])


def test_other_columns_and_parameters(spark):
    schema = SCHEMA + ", vec int, error string, code int, of int, label_error int, ids int"
    rows = [(*r, 1, "x", 2, 3, 4, 5) for r in vectors(8, 120, 12, 0.2)]
    check(spark, rows, schema=schema, parts=4, entries=5, rounds=2)
    check(spark, rows, schema=schema, parts=3, entries=40, rounds=0)


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [20_000.0] * 8, 1)], SCHEMA)
    with pytest.raises(OverflowError):
        codes.compressed(df)


@pytest.mark.parametrize("seed", range(4))
def test_trees_are_whole_and_own_like_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-5000, 5000, (1500, 8)) if seed % 2 else rng.integers(-2, 3, (1500, 8))
    points[:200] = points[0]
    tree = codes.Balls.unpack(codes.Balls.build(points).pack(), 8)
    assert sorted(tree.order.tolist()) == list(range(1500)) and (tree.lo[0], tree.hi[0]) == (0, 1500)
    held = points[tree.order]
    for k in range(len(tree.lo)):
        mine = held[tree.lo[k] : tree.hi[k]]
        assert (mine.sum(0) == tree.total[k]).all()
        assert np.sqrt(((mine - mine.mean(0)) ** 2).sum(1)).max() <= tree.radius[k] * (1 + 1e-12)
        if tree.left[k] >= 0:
            assert tree.lo[k] == tree.lo[tree.left[k]] and tree.hi[tree.left[k]] == tree.lo[tree.right[k]]
    entries = points[rng.integers(0, 1500, 16)] + rng.integers(-1, 2, (16, 8))
    entries[7] = entries[3]
    owner, sums, counts = codes.owners(tree, held, entries)
    want = ((held[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (owner == want).all() and (counts == np.bincount(want, minlength=16)).all()
    assert all((sums[k] == held[want == k].sum(0)).all() for k in range(16))


def test_most_points_are_owned_by_balls():
    """Well-parted groups are given as cached sums; few points are looked at one by one."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-40_000, 40_000, (16, 8))
    points = centres[rng.integers(0, 16, 2000)] + rng.integers(-50, 51, (2000, 8))
    tree = codes.Balls.build(points)
    met = []
    plain = codes._squares
    try:
        codes._squares = lambda a, b: met.append(len(a)) or plain(a, b)
        codes.owners(tree, points[tree.order], centres)
    finally:
        codes._squares = plain
    assert sum(met) < 500


def test_passes_do_not_shuffle_vectors(spark):
    df = spark.createDataFrame(vectors(9, 100, 16, 0.2), SCHEMA)
    shards, books = codes.learned(df)
    assert "Exchange" not in codes.encoded(shards, books)._jdf.queryExecution().toString()
