import math
import random

import brute
import pytest

from formulary.llm import mixing, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, source string, size string, key int, target int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, None) for i, t, s in rows], SCHEMA)


def check(got, docs):
    """docs: (doc_id, text, source), ids all different."""
    size = {i: len(brute.SPACE_WORD.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    sums = {}
    for i, s in source.items():
        sums[s] = sums.get(s, 0) + size[i]
    want = brute.targets(sums)
    taken = dict.fromkeys(sums, 0)
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sums[s])
        assert math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        assert abs(r.copies - (r.target / r.source_size if r.source_size else 0)) < 1 + 1e-9
        taken[s] += r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= max((size[i] for i in size if source[i] == s), default=0) / 2 + 1


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op9_pivotal_mixing(spark, SF).collect()
    check(got, docs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op9_pivotal_mixing(spark, SF).collect()))


def test_several_levels_agree_with_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rng = random.Random(0)
    docs = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "b", None, "ü"])) for i in range(900)]
    check(mixing.mixed(frame(spark, docs)).collect(), docs)


def test_nulls_empty_sources_and_one_huge_document(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "x " * 100_000, "b"), (4, "y", None), (5, "z z", "c"), (6, "z z", "c")]
    check(mixing.mixed(frame(spark, docs)).collect(), docs)
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mixed(frame(spark, [(1, None, None)])).collect()] == [0]


def test_repeated_rows_and_mix(spark):
    rows = [(1, "a b", "s")] * 5 + [(None, "c d e", "t")] * 3 + [(2, "f", "s")]
    got = mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == 9
    rows = frame(spark, rows)
    out = mixing.mix(rows)
    assert out.columns == rows.columns
    often = {}
    for r in got:
        often[r.doc_id] = often.get(r.doc_id, 0) + r.copies
    counted = {}
    for r in out.collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
    assert counted == {i: n for i, n in often.items() if n}


def test_pairing_keeps_words_and_means():
    rng = random.Random(1)
    mean = [0.0] * 6
    sizes, parts = [3, 5, 8, 2, 9, 4], [0.3] * 6
    for _ in range(20_000):
        out = mixing.pair_off(sizes, parts, [rng.random() for _ in sizes])
        assert sum(0 < p < 1 for p in out) <= 1
        assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(sum(s * p for s, p in zip(sizes, parts)))
        mean = [m + p / 20_000 for m, p in zip(mean, out)]
    assert all(m == pytest.approx(0.3, abs=0.02) for m in mean)


def test_a_small_source_meets_its_target_beside_one_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 40)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = [(i, "w " * (1 + i % 50), "large") for i in range(900)]
    docs += [(1000 + i, "w " * (1 + i % 9), "small") for i in range(29)] + [(1029, "w " * 997, "small")]
    docs += [(2000 + i, "w " * (1 + i % 7), None) for i in range(36)] + [(2036, "w " * 2003, None)]
    got = mixing.mixed(frame(spark, docs)).collect()
    check(got, docs)
    source = {i: s for i, _, s in docs}
    for name in ("large", "small", None):
        rows = [r for r in got if source[r.doc_id] == name]
        short = sum(r["size"] for r in rows) - max(r["size"] for r in rows)
        last = max(0, max(r["size"] for r in rows) / 2 - short)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= last + 1, name
    assert sorted(got) == sorted(mixing.mixed(frame(spark, docs).repartition(7)).collect())


def test_turning_documents_over_makes_missing_words_good():
    assert mixing.close({100: (1, 0), 7: (9, 9), 1: (5, 5)}, 45.0) == {7: 6, 1: 3}
    assert mixing.close({7: (9, 9), 4: (9, 9), 1: (5, 5)}, -12.0) == {7: -2, 1: 2}
    assert mixing.close({50: (3, 3)}, 20.0) == {} and mixing.close({}, 3.0) == {}


def test_callers_columns_stay(spark):
    names = ["_key", "_n", "_copies", "_i", "key", "row", "rank", "copies", "size", "target", "part", "dup", "col"]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(k, "w " * (k % 9 + 1), "ab"[k % 2], *[f"{n}{k}" for n in names]) for k in range(40)]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(r for r in rows for _ in range(taken[r[0]]))
