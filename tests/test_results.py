from pyspark.sql import functions as F

from formulary.operators import results, skew
from formulary.sources import writers
from support import plan_of


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pending_counts_null_as_a_key(spark):
    corpus = table(spark, [(1, "a"), (2, "b"), (3, None), (4, "b")], "row_id bigint, nl string")
    ids = lambda done: sorted(
        r.row_id for r in results.pending(corpus, table(spark, done, "nl string")).collect()
    )
    assert ids([("b",), ("b",)]) == [1, 3]
    assert ids([(None,), ("a",)]) == [2, 4]
    assert ids([]) == [1, 2, 3, 4]


def test_pending_with_frequent_sentences(spark):
    """Half of the rows share one sentence, a fifth another; only one of them is done."""
    corpus = spark.range(1000).select(
        F.col("id").alias("row_id"),
        F.expr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 1 THEN 'warm' ELSE concat('s', id) END").alias("nl"),
    )
    done = table(spark, [("hot",), ("s3",), ("s7",)], "nl string")
    want = {r.row_id for r in corpus.collect() if r.nl not in {"hot", "s3", "s7"}}
    for min_heavy_rows in [10, 300, 10_000]:
        got = results.pending(corpus, done, min_heavy_rows).collect()
        assert {r.row_id for r in got} == want and len(got) == len(want)
        assert set(got[0].asDict()) == {"row_id", "nl"}


def test_keys_in_buckets_are_not_shuffled(spark, tmp_path):
    corpus = table(spark, [(1, "a"), (2, "b"), (3, None), (4, "b"), (5, "c")], "row_id bigint, nl string")
    parts = [[("b",), ("b",)], [(None,), ("b",)], []]
    spark.sql("DROP TABLE IF EXISTS done_keys_test")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = []
        for rows in parts:
            keys = writers.write_done_keys(table(spark, rows, "nl string"), "done_keys_test", str(tmp_path / "k"), 8)
            pending = results.pending(corpus, keys)
            left.append(sorted(r.row_id for r in pending.collect()))
        assert left == [[1, 3, 5], [1, 5], [1, 5]] and keys.count() == 2
        lines = plan_of(pending).split("== Physical Plan ==")[1].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
        scans = [k for k, line in enumerate(lines) if "Scan" in line and "Bucketed: true" in line]
        assert scans, lines
        for k in scans:  # from the scan up to its join
            at, above = depth(lines[k]), []
            for line in reversed(lines[:k]):
                if depth(line) < at:
                    at = depth(line)
                    above.append(line)
                if "Join" in above[-1]:
                    break
            assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above), above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.sql("DROP TABLE IF EXISTS done_keys_test")


def test_lookup_join(spark):
    rows = spark.range(600).select(
        "id", F.expr("CASE WHEN id < 300 THEN 'hot' WHEN id < 400 THEN NULL ELSE concat('k', id % 7) END").alias("k")
    )
    lookup = table(spark, [("hot", 1), ("k0", 2), ("k1", 3), ("gone", 4)], "k string, v int")
    want = {"hot": 1, "k0": 2, "k1": 3}
    for min_rows in [1, 50, 1000]:
        got = skew.lookup_join(rows, lookup, "k", "v", ["id"], min_rows).collect()
        assert len(got) == 600 and all(r.v == want.get(r.k) for r in got)


def test_heavy_rows_spread_over_the_shuffle(spark):
    """The stand-in keys of a hot key reach all partitions, and do so the same way every time."""
    rows = spark.range(4000).select("id", F.lit("hot").alias("k"))
    lookup = table(spark, [("hot", 1)], "k string, v int")
    key = lambda: F.concat(F.lit("\x00"), F.xxhash64("id").cast("string"))
    sizes = [r["count"] for r in rows.groupBy(F.pmod(F.hash(key()), F.lit(8))).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700
    assert skew.lookup_join(rows, lookup, "k", "v", ["id"], 10).filter("v = 1").count() == 4000


def test_merge_and_harmonise(spark):
    old = table(spark, [("a", "P(x)", "P(x)")], "`NL` string, `FOL_PRED` string, `FOL_GROUND-TRUTH` string")
    new = table(spark, [("b", "Q(x)", True)], "`NL` string, `PRED` string, `FALLBACK_USED` boolean")
    merged = results.merge_results(results.harmonise_results(old), results.harmonise_results(new))
    got = {r.nl: r for r in merged.collect()}
    assert (got["a"].fol_pred, got["a"].fol_gt, got["a"].fallback_used) == ("P(x)", "P(x)", None)
    assert (got["b"].fol_pred, got["b"].fol_gt, got["b"].fallback_used) == ("Q(x)", None, True)
    two = table(
        spark,
        [(1, None, "h", "A", None), (2, "u", None, None, "B")],
        "row_id int, `FOL_GROUND-TRUTH` string, `FOL-GROUND-TRUTH` string, `PREDICATES-GROUND-TRUTH` string, "
        "`PREDICATES_GROUND-TRUTH` string",
    )
    assert [(r.fol_gt, r.preds_gt) for r in results.harmonise_results(two).orderBy("row_id").collect()] == [
        ("h", "A"),
        ("u", "B"),
    ]
    kept = results.harmonise_results(table(spark, [("m", "x")], "model string, `PROMPT` string")).first()
    assert kept.model == "m" and kept.prompt == "x"
    sparse = results.merge_results(table(spark, [(1,)], "a int"), table(spark, [(2, True)], "a int, b boolean"))
    assert sorted((r.a, r.b) for r in sparse.collect()) == [(1, None), (2, True)]


def test_combine(spark):
    a = table(spark, [(1, "s", "f"), (2, "s", "f"), (3, "t", "g")], "row_id int, nl string, fol string")
    b = table(spark, [(1, "t", "g"), (9, "u", "h")], "row_id int, nl string, fol string")
    assert results.combine_corpora(a, b).count() == 5
    kept = results.combine_corpora(a, b, ("one", "two"), dedup=True).collect()
    assert sorted((r.nl, r.source, r.row_id) for r in kept) == [("s", "one", 1), ("t", "one", 3), ("u", "two", 9)]


def test_progress(spark):
    corpus = spark.range(65)
    done = table(spark, [("m", "s")] * 33, "model string, setting string")
    r = results.progress(corpus, done, 32).first()
    assert (r.total, r.done, r.batches, r.batches_done) == (65, 33, 3, 2)


def test_conclusions(spark):
    df = table(spark, [(1, "c"), (2, ""), (3, None)], "id int, conclusion string")
    assert [r.id for r in results.nonempty_conclusions(df).collect()] == [1]
    assert [r.c for r in df.select(results.blank_if_missing("conclusion").alias("c")).collect()] == ["c", "", ""]
