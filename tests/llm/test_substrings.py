import random

import brute
import pytest

from formulary.llm import queries, substrings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, a long, place string"


def digests(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = substrings.repeat_digests(df, **kw).collect()
    return sorted(map(tuple, got), key=str)


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op4_substring_dedup(spark, SF).collect()))
    assert got == sorted(brute.without_repeats(rows))


@pytest.mark.parametrize("size, seed", [(13, 4), (3, 2), (5, 5), (1, 1)])
def test_random_texts(spark, size, seed):
    rng = random.Random(size)
    words = ["a", "b", "c", "é", "dd"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 13, 14, 60])))) for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(100 + i, f"{rows[i][1]} {passage[: 20 + 3 * i]} {rows[i + 1][1]}") for i in range(20)]
    rows += [(200, "a " * 500), (201, "a " * 300), (150, "a " * 400 + passage)]
    assert digests(spark, rows, size=size, seed=seed) == sorted(brute.without_repeats(rows, size), key=str)


def test_rows_without_id_repeated_rows_and_repeated_ids(spark):
    one = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(15)) + " " + one
    rows = [(None, one), (None, one), (1, None), (2, one), (2, one), (2, other), (3, one), (4, "\x85".join("xyz")), (5, "")]
    assert digests(spark, rows) == sorted(brute.without_repeats(rows), key=str)


def test_long_text_and_empty_table(spark):
    long = " ".join(str(i) for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 3_000_000 + " " + long[:200])]
    assert digests(spark, rows) == sorted(brute.without_repeats(rows), key=str)
    assert digests(spark, []) == []


def test_refuses_impossible_sizes(spark):
    with pytest.raises(ValueError):
        substrings.repeats(spark.createDataFrame([], "doc_id bigint, text string"), size=3, seed=4)


def test_many_texts_of_one_id(spark):
    """Far more texts than a short tag could tell apart."""
    rng = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(7, " ".join(f"t{k}w{i}" for i in range(rng.randrange(1, 60))) + (" " + shared if k % 3 else "")) for k in range(900)]
    rows += [(3, "first " + shared), (9, None), (9, "")]
    assert digests(spark, rows) == sorted(brute.without_repeats(rows), key=str)
