import pytest
from pyspark.sql import functions as F

from formulary.operators import generation as G
from formulary.operators.prompts import ChatTemplate


def test_batches_are_recut(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100, numPartitions=2).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("prompt"))

        def load():
            return lambda prompts: [f"{p}/{len(prompts)}" for p in prompts]

        rows = G.generate(df, load, 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.row_id for r in rows) == list(range(100))
    assert all(r.fol_pred.startswith(r.prompt + "/") for r in rows)
    sizes = [int(r.fol_pred.split("/")[1]) for r in rows]
    assert sizes.count(16) == 96 and sizes.count(2) == 4  # per task 50 = 3 x 16 + 2


def test_other_columns_pass_untouched(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (9007199254740993, NULL, map('a', 1), array(struct(1, 'x')), timestamp'2024-01-01 00:00:01') "
        "AS t(big, gap, m, l, ts) UNION ALL SELECT NULL, 9007199254740993, NULL, NULL, NULL"
    ).withColumn("prompt", F.lit("p"))
    got = G.generate(df, lambda: lambda prompts: prompts, 8)
    rows = {r.big: r for r in got.collect()}
    assert rows[9007199254740993].m == {"a": 1} and rows[None].gap == 9007199254740993 and rows[None].m is None
    assert rows[9007199254740993].l[0][1] == "x" and rows[9007199254740993].ts.second == 1


def test_wrong_number_of_answers_is_an_error(spark):
    df = spark.range(3, numPartitions=1).select(F.col("id").alias("row_id"), F.lit("p").alias("prompt"))
    with pytest.raises(Exception, match="answers for"):
        G.generate(df, lambda: lambda prompts: prompts[:1], 2).collect()


def asked(spark, nls):
    return spark.createDataFrame([(i, nl, "sys") for i, nl in enumerate(nls)], "row_id int, nl string, system string")


def client_failing(times):
    def make():
        seen = {}

        def call(system, user):
            seen[user] = seen.get(user, 0) + 1
            if seen[user] <= times.get(user, 0):
                raise TimeoutError("slow")
            return G.Reply("" if user == "empty" else f"𝜙={user}", "thoughts")

        return call

    return make


NO_WAIT = G.RetryPolicy(attempts=3, threads=2, sleep=lambda _: None)


def test_no_row_is_lost(spark):
    df = asked(spark, ["fine", "twice", "never", "empty"])
    make = client_failing({"twice": 2, "never": 99})
    got = {r.nl: r for r in G.call_with_retry(df, make, NO_WAIT).collect()}
    assert len(got) == 4
    assert (got["fine"].status, got["fine"].attempts, got["fine"].fol_pred) == ("ok", 1, "𝜙=fine")
    assert (got["twice"].status, got["twice"].attempts) == ("ok", 3)
    assert (got["never"].status, got["never"].fol_pred, got["never"].error) == ("failed", "ERROR", "TimeoutError: slow")
    assert (got["empty"].status, got["empty"].error, got["empty"].fallback_used) == ("failed", "empty answer", False)


def test_fallback_quotes_the_thoughts(spark):
    df = asked(spark, ["fine", "never", "empty"])

    def fallback():
        return lambda system, user: G.Reply(system)

    got = {r.nl: r for r in G.call_with_retry(df, client_failing({"never": 99}), NO_WAIT, fallback, ("<", ">")).collect()}
    assert got["fine"].status == "ok" and not got["fine"].fallback_used
    assert (got["empty"].status, got["empty"].fol_pred) == ("fallback", "<Use your earlier thoughts on this: thoughts>")
    assert (got["never"].status, got["never"].fol_pred, got["never"].attempts) == ("fallback", "<>", 4)


def test_waits_grow():
    waits = []
    policy = G.RetryPolicy(attempts=4, base_wait=4, factor=2, sleep=waits.append)

    def broken(system, user):
        raise OSError("down")

    assert G._try(broken, "s", "u", policy) == (None, 4, "OSError: down")
    assert waits == [4, 8, 16]  # none after the last attempt


def test_chain(spark):
    df = spark.createDataFrame(
        [(1, ["p1", "p2"], "c", "True"), (2, [], "only", None), (3, ["q"], "", None), (4, None, None, None)],
        "example_id int, premises array<string>, conclusion string, label string",
    )
    template = ChatTemplate("<", ">", ";", "")

    def load():
        return lambda prompts: [f"x=y={p.count('𝜙') - 1}{p[p.rindex('<user>') + 6 : -1]} " for p in prompts]

    got = {r.example_id: (r.premises_fol, r.conclusion_fol) for r in G.generate_sequential(df, load, template).collect()}
    # The number is how many earlier formulas the prompt showed.
    assert got == {1: (["0p1", "1p2"], "2c"), 2: ([], "0only"), 3: (["0q"], ""), 4: ([], "")}
    first = G._chain_prompt(template, "t", [], False)
    assert "<assistant>;<user>t;" in first
    assert "<assistant>Previously translated premises in FOL:\n;<user>t;" in G._chain_prompt(template, "t", [], True)
    assert "FOL:\n𝜙1 = A\n𝜙2 = B;<user>t;" in G._chain_prompt(template, "t", ["A", "B"], False)


def test_chain_sees_small_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def model(asked):
            assert len(asked) <= 8
            seen.add(1)
            return ["𝜙=A(x)"] * len(asked)

        return model

    rows = [(i, ["One.", "Two."], "Three.") for i in range(50)]
    df = spark.createDataFrame(rows, "example_id int, premises array<string>, conclusion string").coalesce(1)
    done = G.generate_sequential(df, load, batch_size=8).collect()
    assert all(r.premises_fol == ["A(x)", "A(x)"] and r.conclusion_fol == "A(x)" for r in done) and len(done) == 50
    assert seen.value == 21


def test_no_wait_after_the_last_attempt():
    waits = []
    policy = G.RetryPolicy(attempts=3, sleep=waits.append)

    def client(system, user):
        raise ConnectionError("busy")

    assert G._try(client, "", "", policy) == (None, 3, "ConnectionError: busy")
    assert waits == [4.0, 8.0]


def test_answers_leave_in_small_portions():
    import pyarrow as pa

    parts = list(G._portions(pa.RecordBatch.from_pydict({"a": list(range(10))}), 4))
    assert [p.num_rows for p in parts] == [4, 4, 2]
