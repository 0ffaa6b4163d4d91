import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F

from formulary.operators.generation import Reply, RetryPolicy, generate
from formulary.plans import doubles, flows
from formulary.plans.prompt_spec import MODEL_FAMILIES, model_family
from formulary.sources import ranges


def corpus(spark):
    rows = [(i, f"Sentence {i}.", f"∀x (Cat{i}(x) → Dog(x))", "train") for i in range(12)]
    return spark.createDataFrame(rows, "row_id bigint, nl string, fol string, split string")


@pytest.mark.parametrize("family", ["seq2seq", "chat"])
@pytest.mark.parametrize("setting", ["standard", "gt_predicates", "gt_predicates_noise", "new_tokens", "2step_1"])
def test_training_data(spark, family, setting):
    rows = flows.training_data(corpus(spark), family, setting).collect()
    assert len(rows) == 12 and rows[0].asDict().keys() == (
        {"row_id", "nl", "label"} if family == "seq2seq" else {"row_id", "messages"}
    )


def test_predict(spark):
    rows = flows.predict(corpus(spark), doubles.load_echo, "seq2seq", "gt_predicates_noise").collect()
    assert len(rows) == 12
    for r in rows:
        assert r.fol_pred == "echo: " + r.prompt and f"Cat{r.row_id}" in r.prompt and r.fol_gt.startswith("∀x")


def test_two_steps(spark):
    def first():
        return lambda prompts: ["user\nsome text\nPredicates=[Cat, Dog] " for _ in prompts]

    rows = flows.predict_in_two_steps(corpus(spark), first, doubles.load_echo, "chat").collect()
    assert all("following predicates:Predicates=[Cat, Dog]Start" in r.prompt for r in rows) and len(rows) == 12
    assert {r.row_id: r.preds_gt for r in rows}[3] == "Cat3, Dog"


def test_families(spark):
    paths = [(f"/hf/{m}/standard",) for m in MODEL_FAMILIES] + [(m,) for m in MODEL_FAMILIES] + [("other/model",)]
    got = [r.f for r in spark.createDataFrame(paths, "p string").select(model_family("p", "/hf").alias("f")).collect()]
    assert got == [*MODEL_FAMILIES.values(), *MODEL_FAMILIES.values(), None]


def counting(spark):
    """(loader of a model that echoes, accumulator of its prompts)."""
    asked = spark.sparkContext.accumulator(0)

    def load():
        def model(prompts):
            asked.add(len(prompts))
            return [f"echo: {p}" for p in prompts]

        return model

    return load, asked


def found(df):
    return sorted(map(tuple, df.select("row_id", "nl", "fol_pred").collect()), key=str)


def test_resume_goes_on_where_it_broke(spark, tmp_path):
    out = str(tmp_path / "answers")
    rows = corpus(spark).repartition(2)
    load, asked = counting(spark)
    run = lambda **kw: flows.predict_resumable(rows, load, out, "seq2seq", "standard", batch_rows=2, **kw)
    assert run(stop_after=2).count() == asked.value == 4
    (tmp_path / "answers" / ranges.ATTEMPTS / "x").mkdir(parents=True)
    (tmp_path / "answers" / ranges.ATTEMPTS / "x" / "half.parquet").write_bytes(b"PAR1 half")
    want = found(flows.predict(rows, doubles.load_echo, "seq2seq", "standard"))
    assert found(run()) == want and asked.value == 12
    assert found(run()) == want and asked.value == 12


def test_null_and_repeated_ids_are_asked_once_each(spark, tmp_path):
    out = str(tmp_path / "o")
    rows = [(None if i % 3 else 7, f"Sentence {i % 50}.", "Cat(x)", "train") for i in range(300)]
    load, asked = counting(spark)
    total = 0
    for parts in (4, 7, 3):  # each call finds the rows dealt out another way
        df = spark.createDataFrame(rows, corpus(spark).schema).repartition(parts)
        got = flows.predict_resumable(df, load, out, "seq2seq", "standard", batch_rows=10, stop_after=12)
        total = got.count()
    assert total == asked.value == 300
    assert found(got) == found(flows.predict(df, doubles.load_echo, "seq2seq", "standard"))


def test_a_killed_run_keeps_committed_ranges(spark, tmp_path):
    out, flag = str(tmp_path / "o"), tmp_path / "broken"
    rows = corpus(spark).repartition(1)
    asked = spark.sparkContext.accumulator(0)
    flag.touch()

    def load():
        def model(prompts):
            if any("Sentence 9." in p for p in prompts) and flag.exists():
                raise RuntimeError("lost")
            asked.add(len(prompts))
            return [f"echo: {p}" for p in prompts]

        return model

    run = lambda: flows.predict_resumable(rows, load, out, "seq2seq", "standard", batch_size=1, batch_rows=3)
    with pytest.raises(Exception, match="lost"):
        run()
    kept = len(list((tmp_path / "o" / ranges.ANSWERS).glob("range-*.parquet")))
    flag.unlink()
    assert found(run()) == found(flows.predict(rows, doubles.load_echo, "seq2seq", "standard"))
    assert len(list((tmp_path / "o" / ranges.ANSWERS).glob("range-*.parquet"))) == 4
    # Only rows of ranges that were not committed can have been asked twice.
    assert 0 < kept < 4


def test_a_repeated_task_skips_its_committed_ranges(spark, tmp_path):
    root = str(tmp_path / "r")
    ranges.plan_ranges(spark, corpus(spark).repartition(1), root, 4)
    rows, count = ranges.open_ranges(spark, root)
    dealt = ranges.dealt(rows, 1)
    ranges.write_ranges(dealt.filter(f"{ranges.RANGE} = 1"), root)
    left = ranges.skip_committed(dealt, root)
    assert count == 3 and {r[ranges.RANGE] for r in left.collect()} == {0, 2}
    assert ranges.open_ranges(spark, root)[1] == 2
    # A second commit of a range changes nothing.
    ranges.write_ranges(dealt.withColumn("nl", F.lit("late")), root)
    kept = ranges.answers(spark, root, corpus(spark).schema)
    assert kept.count() == 12 and kept.filter("nl = 'late'").count() == 8


def test_ranges_in_pieces_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], f"{ranges.RANGE} bigint, t string").coalesce(1)
    with pytest.raises(Exception, match="do not follow one another"):
        ranges.write_ranges(rows, str(tmp_path / "x"))


def test_an_unfinished_plan_is_written_again(spark, tmp_path):
    root = str(tmp_path / "p")
    ranges.plan_ranges(spark, corpus(spark), root, 4)
    (tmp_path / "p" / ranges.PLANNED).unlink()
    got = flows.predict_resumable(corpus(spark), doubles.load_echo, root, "seq2seq", "standard", batch_rows=5)
    assert got.count() == 12


def test_requests_in_flight_are_bounded(spark, tmp_path):
    opened = str(tmp_path / "open")
    (tmp_path / "open").mkdir()

    def client():
        import os, time, uuid  # noqa: E401

        def call(system, user):
            mine = f"{opened}/{uuid.uuid4().hex}"
            open(mine, "w").close()
            time.sleep(0.05)
            n = len(os.listdir(opened))
            os.remove(mine)
            return Reply(str(n))

        return call

    rows = spark.range(60).selectExpr("id row_id", "concat('s', id) nl", "'Cat(x)' fol", "'train' split")
    for bound in (1, 3):
        got = flows.predict_remote(
            rows, client, str(tmp_path / f"o{bound}"), "none", RetryPolicy(threads=2), batch_rows=5, in_flight=bound
        )
        assert got.count() == 60 and max(int(r.fol_pred) for r in got.collect()) <= bound


def test_a_profile_reaches_the_stage_of_the_model(spark):
    needs = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", 1)).build
    asked = corpus(spark).select(F.col("nl").alias("prompt"))
    node = generate(asked, doubles.load_echo, profile=needs)._jdf.queryExecution().analyzed()
    assert node.profile().isDefined() and node.profile().get().taskResources().contains("gpu")
    assert generate(asked, doubles.load_echo)._jdf.queryExecution().analyzed().profile().isEmpty()


def test_earlier_results_are_not_asked_again(spark, tmp_path):
    done = spark.createDataFrame([("Sentence 3.", "x")], "nl string, fol_pred string")
    got = flows.predict_resumable(corpus(spark), doubles.load_echo, str(tmp_path / "o"), "seq2seq", "standard", done=done)
    assert got.count() == 11 and "Sentence 3." not in {r.nl for r in got.collect()}


def test_remote_run_keeps_what_was_paid_for(spark, tmp_path):
    out = str(tmp_path / "paid")
    run = lambda **kw: flows.predict_remote(
        corpus(spark), doubles.steady_client, out, "own", doubles.NO_WAIT, batch_rows=4, **kw
    )
    assert run(stop_after=2).count() <= 8
    got = run().collect()
    assert len(got) == 12 and all(r.status == "ok" and r.fol_pred.startswith("fallback ") for r in got)


def test_empty_corpus(spark, tmp_path):
    got = flows.predict_resumable(corpus(spark).limit(0), doubles.load_echo, str(tmp_path / "e"), "seq2seq", "standard")
    assert got.count() == 0 and "fol_pred" in got.columns


def test_a_large_range_is_held_in_small_parts(tmp_path):
    batch = pa.RecordBatch.from_pydict({"fol_pred": [f"{i:04d}" * 256 for i in range(1000)]})
    file = ranges._RangeFile(str(tmp_path), "run", 3)
    most = 0
    for _ in range(30):
        file.add(batch)
        most = max(most, file.bytes)
    file.close()
    assert most < 10 << 20
    back = pq.ParquetFile(ranges.range_file(str(tmp_path), 3))
    assert back.metadata.num_row_groups > 2 and back.read().equals(pa.Table.from_batches([batch] * 30))
