from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from formulary.operators import sampling


def corpus(spark, sizes):
    rows = [(split, i) for split, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(7 * j + 3, s) for j, (s, _) in enumerate(rows)], "row_id bigint, split string")
    return df.repartition(5).withColumn("fol", F.concat(F.lit("P"), "row_id", F.lit("(x) ∧ Both(x)")))


def test_dense_index(spark):
    df = corpus(spark, {"train": 900, "val": 3, "test": 97})
    got = sampling.dense_index(df, by="split").collect()
    by_split = defaultdict(list)
    for r in got:
        by_split[r.split].append(r)
    for split, rows in by_split.items():
        rows.sort(key=lambda r: r.row_id)
        assert [r.idx for r in rows] == list(range(len(rows)))
        assert {r.n for r in rows} == {len(rows)}
    everything = sorted(sampling.dense_index(df).collect(), key=lambda r: r.row_id)
    assert [r.idx for r in everything] == list(range(1000)) and "_all" not in everything[0].asDict()


def test_batches(spark):
    df = corpus(spark, {"train": 70})
    got = sorted(sampling.assign_batches(df, 32).collect(), key=lambda r: r.idx)
    assert [(r.batch_id, r.batch_start, r.batch_end) for r in got] == [
        (i // 32, i // 32 * 32, min(i // 32 * 32 + 32, 70)) for i in range(70)
    ]
    assert sampling.batch_slice(sampling.assign_batches(df, 32), 2).count() == 6


def test_draws(spark):
    sizes = {"train": 800, "val": 129, "small": 128, "tiny": 3, "one": 1}
    df = corpus(spark, sizes)
    drawn = sampling.noise_rows(df, k=5, seed=1).collect()
    split_of = {r.row_id: r.split for r in df.collect()}
    per_row = defaultdict(list)
    for r in drawn:
        assert split_of[r.peer_id] == split_of[r.row_id]
        assert r.preds == [f"P{r.peer_id}", "Both"]
        per_row[r.row_id].append(r.peer_id)
    assert set(per_row) == set(split_of)
    for row_id, peers in per_row.items():
        assert len(peers) == len(set(peers)) == min(5, sizes[split_of[row_id]])
    # Same seed, same draw; another seed, another draw. All peers come up about equally often.
    again = {(r.row_id, r.peer_id) for r in sampling.noise_rows(df, k=5, seed=1).collect()}
    other = {(r.row_id, r.peer_id) for r in sampling.noise_rows(df, k=5, seed=2).collect()}
    assert again == {(r.row_id, r.peer_id) for r in drawn} != other
    used = Counter(p for r, ps in per_row.items() if split_of[r] == "train" for p in ps)
    assert len(used) > 780 and max(used.values()) < 25


def test_many_draws_per_row(spark):
    df = corpus(spark, {"train": 300})
    for k in [60, 320]:
        counts = sampling.noise_rows(df, k=k).groupBy("row_id").agg(F.countDistinct("peer_id").alias("n")).collect()
        assert {r.n for r in counts} == {min(k, 300)}


def test_noise_set(spark):
    df = corpus(spark, {"train": 50})
    sets = {r.row_id: r.noise for r in sampling.noise_predicate_set(sampling.noise_rows(df)).collect()}
    assert all(v == sorted(v) and "Both" in v and len(v) == 6 for v in sets.values())
    kept = sampling.with_noise(df).collect()
    assert {r.row_id: r.noise for r in kept} == sets


def test_numbering_sorts_keys_only(spark):
    from support import plan_of

    rows = spark.range(500).selectExpr("id AS row_id", "repeat('x', 100) AS wide")
    out = sampling.assign_batches(rows, 32)
    assert sorted((r.row_id, r.batch_id) for r in out.collect()) == [(i, i // 32) for i in range(500)]
    assert "rangepartitioning" not in plan_of(out)  # the sort is done, over row_id alone, and written down
    numbered = [line for line in plan_of(out).splitlines() if "indexed" in line]
    assert not any("wide" in line for line in numbered)


def test_rows_that_share_an_order_value_share_out_its_numbers(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (0, "d")], "row_id int, x string")
    got = sampling.with_index(rows, rows).collect()
    assert sorted(r.idx for r in got if r.row_id == 1) == [1, 2, 3] and {r.n for r in got} == {4}


def test_rows_without_an_order_value_are_numbered_too(spark):
    one = spark.createDataFrame([(2, "a"), (None, "b"), (1, "c")], "row_id int, x string")
    got = sampling.assign_batches(one, 2).collect()
    assert sorted((r.idx, r.x, r.batch_id, r.batch_end) for r in got) == [(0, "b", 0, 2), (1, "c", 0, 2), (2, "a", 1, 3)]
    rows = spark.range(900).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 7, id + 10)) AS row_id", "id AS x").repartition(5)
    got = sorted(sampling.with_index(rows, rows).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(900)) and {r.n for r in got} == {900}
    assert [r.row_id for r in got] == [None] * 300 + [7] * 300 + [i + 10 for i in range(900) if i % 3 == 2]
    assert sorted(r.x for r in got) == list(range(900))


def test_draws_follow_one_rule_for_every_size(spark):
    for n in (1, 2, 4, 5, 6, 128, 129, 10_000):
        df = spark.range(40).withColumn("n", F.lit(n).cast("bigint"))
        got = df.select(sampling.drawn_positions(F.col("id"), F.col("n"), 5, 0).alias("p")).collect()
        for r in got:
            assert len(r.p) == len(set(r.p)) == min(5, n) and all(0 <= p < n for p in r.p)


@pytest.mark.parametrize("shared", ["NULL", "7"])
def test_a_value_that_many_rows_share_is_sorted_by_many_tasks(spark, shared):
    rows = spark.range(30_000).selectExpr(f"IF(id % 3 = 0, {shared}, id + 10) AS row_id", "id AS x").repartition(6)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would become one
    spark.conf.set(merging, "false")
    try:
        placed = sampling.dense_index(rows)
    finally:
        spark.conf.unset(merging)
    tied = placed.filter("row_id IS NULL OR row_id = 7")
    # The rows are read from the table of sorted partitions, a file for each of them.
    per_file = tied.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 2 and max(r["count"] for r in per_file) <= 6_000
    got = placed.orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(30_000))
    keys = [(r.row_id is not None, r.row_id or 0) for r in got]
    assert keys == sorted(keys)


def test_callers_columns_stay(spark):
    helpers = ["n", "g", "tie", "pid", "pos", "c", "first", "all", "k", "k0", "start", "before", "rows", "_pid", "_pos", "_n", "_row"]
    helpers += ["c0", "c1", "of_pid", "shift", "_first", "_all", "preds", "peer_id", "of_idx"]
    made = ["idx", "batch_id", "batch_start", "batch_end"]
    schema = "row_id int, " + ", ".join(f"`{c}` string" for c in helpers + made) + ", split string, fol string, nl string, noise int"
    for ids in (range(5), [1, 1, None, None, 2]):
        data = [(i, *[f"{c}{k}" for c in helpers + made], None, "Cat(x)", f"s{k}", 9) for k, i in enumerate(ids)]
        df = spark.createDataFrame(data, schema)
        batches = sampling.assign_batches(df, 2)
        assert batches.columns == [c for c in df.columns if c not in made] + made
        got = batches.collect()
        assert sorted(r.idx for r in got) == [0, 1, 2, 3, 4] and {r.n for r in got} == {r[1] for r in data}
        assert sorted(r.g for r in sampling.with_index(df, df).collect()) == [f"g{k}" for k in range(5)]
        noisy = sampling.with_noise(df).collect()
        assert sorted((r.nl, r.pid, r.idx) for r in noisy) == [(f"s{k}", f"pid{k}", f"idx{k}") for k in range(5)]
        assert all(r.noise == ["Cat"] for r in noisy)


def test_rows_without_an_id_of_their_own_keep_their_prompts(spark):
    rows = [(None if k % 3 else 5, f"s{k}", f"P{k}(x) ∧ Both(x)", None if k % 2 else "train") for k in range(60)]
    df = spark.createDataFrame(rows, "row_id int, nl string, fol string, split string")
    got = sampling.prompt_noisy_preds(df).collect()
    assert len(got) == 60
    noisy = {r.nl: r.noise for r in sampling.with_noise(df).collect()}
    assert len(noisy) == 60 and all("Both" in v and len(v) == 6 for v in noisy.values())
    # Only rows of the same split, null being one, are drawn.
    assert all({int(p[1:]) % 2 for p in v if p != "Both"} == {int(s[1:]) % 2} for s, v in noisy.items())
    assert sampling.noise_rows(df).count() == 300
