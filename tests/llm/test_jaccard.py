import random

import brute
import numpy as np
import pytest

from formulary.llm import jaccard, queries
from formulary.llm.graphs import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, item string, tag string, nodes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def joined(spark, rows):
    return {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, rows)).collect()}


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op7_jaccard_join(spark, SF).collect()}
    assert got == brute.near_duplicates(rows)


def test_large_groups_in_blocks_and_chains(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 8)
    rng = random.Random(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # one group of near copies, most of them different
        words = list(base)
        for k in rng.sample(range(120), rng.randint(0, 2)):
            words[k] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    for i in range(30):  # a chain: neighbours are similar, its ends are not
        rows.append((100 + i, " ".join(f"c{k}" for k in range(5 * i, 5 * i + 90))))
    rows += [(200 + i, "one two three") for i in range(5)] + [(300, "one two four"), (301, "one"), (302, "one")]
    got, want = joined(spark, rows), brute.near_duplicates(rows)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    links = sum(n for _, n in want.values())
    assert sum(n for _, n in got.values()) >= 0.99 * links and all(got[i][1] <= want[i][1] for i in want)


def test_few_long_texts_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 50)
    rows = []
    for g in range(12):  # two near copies each, in about eight chunks of a node, most of them without a text
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words + ["more"]))]
    assert joined(spark, rows) == brute.near_duplicates(rows)


def test_null_empty_and_very_long_texts(spark):
    long = " ".join(str(i) for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " more"), (6, "a"), (7, "a " * 50_000), (8, "a " * 6)]
    assert joined(spark, rows) == brute.near_duplicates(rows)
    assert joined(spark, []) == {}


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (2, "other")]
    got = sorted(map(tuple, jaccard.jaccard_join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, 0)] * 2 + [(1, 1, 2), (2, 1, 2), (2, 1, 2), (2, 2, 0)], key=str)
    df = frame(spark, rows + [(1, "a b c d e f")])
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_per_class(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (2, "other"), (None, "a b c d e f"), (None, None)], key=str)
    assert jaccard.one_per_class(df).columns == df.columns


def test_many_texts_of_one_id_stay_apart(spark):
    rows = [(7, f"t{k} a{k} b{k} c{k} d{k} e{k}") for k in range(900)] + [(9, None), (9, ""), (9, "")]
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_per_class(frame(spark, rows)).collect()), key=str)
    assert kept == sorted(rows[:-1], key=str)


def test_callers_columns_stay(spark):
    names = ["_tag", "tag", "key", "row", "id", "class_id", "n_links", "rank", "a", "b", "node", "place"]
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(k, f"w{k // 2} x y z u v", *[f"{n}{k}" for n in names]) for k in range(6)]
    kept = sorted(map(tuple, jaccard.one_per_class(spark.createDataFrame(rows, schema)).collect()))
    assert kept == [rows[0], rows[2], rows[4]]


def test_prefix_length():
    assert jaccard.prefix_length(0.8, 0.999, 20, 8) == 5
    with pytest.raises(ValueError):
        jaccard.prefix_length(0.1, 0.999, 2, 8)


def test_pairs_at_the_threshold_meet_in_some_tree():
    depth = jaccard.prefix_length(jaccard.THRESHOLD, jaccard.RECALL)
    assert (1 - jaccard.THRESHOLD**depth) ** jaccard.TREES < 1e-6
    forest = jaccard.Forest(jaccard.TREES, depth)
    sets = np.random.default_rng(5).integers(0, 1 << 64, size=(20_000, 10), dtype=np.uint64)
    a, b = forest.nodes(list(sets[:, :9])), forest.nodes(list(sets[:, 1:]))  # 8 of 10 in common
    assert (a == b).any(axis=1).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 600 + i) for i in range(50)] + [(7, 7)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{600 + i: 500 for i in range(50)}}
