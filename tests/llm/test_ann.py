import brute
import numpy as np
import pytest

from formulary.llm import ann, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, None) for i, v in rows], SCHEMA)


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute.nearest(rows, 5, 50)
    got = as_dict(queries.op3_hnsw(spark, SF).collect())
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        scores = dict((i, -s) for s, i in brute.nearest([(q, dict(rows)[q])] + rows, len(rows), 50)[q])
        assert len(found) == 5 and all(s == pytest.approx(scores[i], abs=1e-12) for i, s in found)


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(900)]
    df = frame(spark, rows)
    got = as_dict(ann.nearest(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=200).collect())
    want = brute.nearest(rows, 5, 50)
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    v, nan = [1.0, 2.0], float("nan")
    rows = [(i, v) for i in range(0, 400)] + [(400, [2.0, 1.0]), (401, None), (402, [0.0, 0.0]), (403, [nan, 1.0])]
    rows += [(404, [None, 1.0]), (None, v), (405, []), (406, [float("inf"), 0.0]), (7, v), (500, [9.0, 1.0])]
    df = frame(spark, rows)
    got = as_dict(ann.nearest(df, df.filter("vec_id % 50 = 0")).collect())
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[400]] == [i for _, i in brute.nearest(rows, 5, 50)[400]]
    assert set(got) == {*range(0, 401, 50), 500}


def test_few_rows_and_empty_table(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    got = as_dict(ann.nearest(df, df.filter("vec_id = 0")).collect())
    assert [i for i, _ in got[0]] == [2, 1]
    empty = frame(spark, [])
    assert ann.nearest(empty, empty).count() == 0
    alone = frame(spark, [(0, [1.0])])
    assert ann.nearest(alone, alone).count() == 0


def test_ties_among_scaled_copies_go_to_the_smaller_id(spark):
    """Vectors on one ray, in lengths of powers of two, have exactly equal cosines."""
    rng = np.random.default_rng(4)
    rays = rng.normal(size=(6, 8)).astype("float32")
    rows = [(k, (rays[(7 * k) % 6] * np.float32(2.0 ** ((5 * k) % 7 - 3))).tolist()) for k in range(240)]
    rows += [(300, [0.0, 1.0] * 4), (301, [-0.0, 1.0] * 4), (302, [0.0, 2.0] * 4)]
    df = frame(spark, rows)
    for shard_rows in (ann.SHARD_ROWS, 5):
        got = as_dict(ann.nearest(df, df.filter("vec_id % 50 = 0"), 5, shard_rows).collect())
        for q, found in got.items():
            want = brute.nearest(rows, 5, 50)[q]
            assert [i for i, _ in found] == [i for _, i in want] if q < 300 else {301, 302} <= {i for i, _ in found}


def test_callers_columns_are_not_read(spark):
    names = ["key", "largest", "vec", "place", "shard", "dims", "least", "query", "block", "rank"]
    rows = [(k, [float(k % 7 + 1), 1.0], *["x"] * len(names)) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, " + ", ".join(f"`{n}` string" for n in names))
    assert ann.nearest(df, df.filter("vec_id = 0")).count() == 5
