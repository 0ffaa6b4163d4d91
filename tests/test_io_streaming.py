import json
import time

import pytest
from pyspark.sql import functions as F

from formulary import session
from formulary.operators import generation, prompts
from formulary.plans import doubles
from formulary.sources import readers, writers
from formulary.streaming import predictions as stream
from support import plan_of


def test_pairs_json(spark, tmp_path):
    for i in range(2):
        pairs = [{"NL": f"s{i}{j} é", "FOL": "∀x Cat(x)", "extra": 1} for j in range(3)] + [{"NL": "only"}]
        (tmp_path / f"{i}.json").write_text(json.dumps(pairs, indent=4, ensure_ascii=False), encoding="utf-8")
    got = readers.read_pairs_json(spark, str(tmp_path)).collect()
    assert len(got) == 8 and sorted(r.nl for r in got)[-1] == "s12 é"
    assert [r.fol for r in got if r.nl == "only"] == [None, None]


def test_examples_jsonl(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"premises": ["a", "b"], "conclusion": "c", "label": "True"}\n\n{"conclusion": "d"}\n\n{}\n')
    got = sorted(readers.read_examples_jsonl(spark, str(path)).collect(), key=lambda r: r.conclusion)
    assert [(r.premises, r.conclusion, r.label) for r in got] == [([], "", None), (["a", "b"], "c", "True"), ([], "d", None)]
    out = spark.createDataFrame(
        [(["ä"], ["∀x Cat(x)"], "c", "", None)],
        "premises array<string>, premises_fol array<string>, conclusion string, conclusion_fol string, label string",
    )
    writers.write_examples_jsonl(out.coalesce(1), str(tmp_path / "out"))
    [file] = (tmp_path / "out").glob("part-*.json")
    assert file.read_text(encoding="utf-8") == (
        '{"premises":["ä"],"premises-FOL":["∀x Cat(x)"],"conclusion":"c","conclusion-FOL":"","label":null}\n'
    )


def test_split_pruning(spark, tmp_path):

    df = spark.range(20).withColumn("split", F.when(F.col("id") < 5, "val").otherwise("train"))
    df.write.partitionBy("split").parquet(str(tmp_path / "t"))
    got = readers.read_split(spark, str(tmp_path / "t"), "val")
    assert got.count() == 5 and "PartitionFilters: [isnotnull(split" in plan_of(got)


def test_predictions_by_model(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(i, "∀x Cat(x)", "org/model:1" if i % 2 else "m", "standard") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id int, fol_pred string, model string, setting string")
    for _ in range(2):  # a rewrite replaces
        writers.write_predictions(df, path)
    folders = sorted(p.name for p in (tmp_path / "p").iterdir() if p.name.startswith("model="))
    assert folders == ["model=m", "model=orgmodel1"]
    [file] = (tmp_path / "p" / "model=m" / "setting=standard").glob("*.json")
    assert "∀x Cat(x)" in file.read_text(encoding="utf-8")
    assert spark.read.json(path).count() == 40


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "a")
    for batch_id, n in [(0, 3), (1, 4), (1, 4), (0, 3)]:
        writers.append_progress(spark.range(n), path, batch_id)
    assert spark.read.parquet(path).count() == 7


def write_pairs(folder, name, nls):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps([{"NL": n, "FOL": f"F{i}(x)"} for i, n in enumerate(nls)]))


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    src, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    assert stream.stored(spark, out).count() == 0
    write_pairs(src, "1.json", ["a", "b", "a"])
    write_pairs(src, "2.json", ["b", "c"])
    write_pairs(src, "2b.json", ["b", "c"])
    run = lambda **kw: stream.stream_predictions(
        spark, str(src), out, state, doubles.load_echo, files_per_batch=1, **kw
    ).awaitTermination()
    run()
    first = stream.stored(spark, out)
    # A pair of sentence and formula is answered once, wherever it is repeated.
    pairs = lambda rows: sorted((r.nl, r.fol_gt) for r in rows)
    assert pairs(first.collect()) == [("a", "F0(x)"), ("a", "F2(x)"), ("b", "F0(x)"), ("b", "F1(x)"), ("c", "F1(x)")]
    run()
    assert stream.stored(spark, out).count() == 5
    write_pairs(src, "3.json", ["c", "d", "e", "d"])
    run(done=spark.createDataFrame([("e",)], "nl string"))
    rows = stream.stored(spark, out).collect()
    assert pairs(rows)[5:] == [("c", "F1(x)"), ("d", "F1(x)"), ("d", "F3(x)")] and len(rows) == 8
    batch = spark.createDataFrame([(i, n, "F") for i, n in enumerate("abcd")], "row_id int, nl string, fol string")
    asked = prompts.seq2seq_prompt(batch).withColumnRenamed("nl", "prompt")
    want = {(r.prompt, r.fol_pred) for r in generation.generate(asked, doubles.load_echo).collect()}
    assert {(r.prompt, r.fol_pred) for r in rows} == want


def keyed(spark, rows):
    batch = spark.createDataFrame(rows, "row_id string, nl string, fol string")
    return batch.withColumns({"key": stream.pair_key("nl", "fol"), "seen": F.current_timestamp()})


@pytest.mark.parametrize("window", ["7 days", "1 second"])
def test_a_repeated_batch_adds_nothing(spark, tmp_path, window):
    out = str(tmp_path / "out")
    for _ in range(2):
        stream.predict_batch(keyed(spark, [("k1", "a", "F"), ("k2", "b", "G")]), 5, out, doubles.load_echo, window=window)
    assert stream.stored(spark, out).count() == 2


def test_keys_beyond_the_window_are_found_in_the_output(spark, tmp_path):
    out = tmp_path / "out"
    stream.predict_batch(keyed(spark, [("k1", "a", "F"), ("k2", "b", "G")]), 0, str(out), doubles.load_echo)
    again = keyed(spark, [("k1", "a", "F"), ("k2", "b", "H"), ("k3", None, None)])
    # Within the window the query's state would know them; the output is not asked.
    assert stream.older_keys(spark, str(out), "7 days", 1).count() == 0
    (day,) = (out / "batch_id=0").glob("day=*")
    day.rename(day.parent / "day=2001-01-01")
    assert stream.older_keys(spark, str(out), "7 days", 1).count() == 2
    plan = plan_of(stream.older_keys(spark, str(out), "7 days", 1))
    assert "PartitionFilters: [isnotnull(day" in plan
    stream.predict_batch(again, 1, str(out), doubles.load_echo)
    got = sorted(((r.nl, r.fol_gt) for r in stream.stored(spark, str(out)).collect()), key=str)
    assert got == [("a", "F"), ("b", "G"), ("b", "H"), (None, None)]


def test_state_ends_with_the_window(spark, tmp_path):
    src, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    sizes = []
    for k in range(6):
        write_pairs(src, f"{k}.json", [f"s{k}-{i}" for i in range(50)] + ["common"])
        query = stream.stream_predictions(spark, str(src), out, state, doubles.load_echo, window="1 second")
        query.awaitTermination()
        sizes += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        time.sleep(2.5)
    assert max(sizes) <= 210 and sizes[-1] <= 110 and stream.stored(spark, out).count() == 301, sizes


def test_a_cluster_needs_no_settings_for_the_state(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "src", str(tmp_path / "out")
    write_pairs(src, "1.json", ["a", "b", "a"])
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for k in range(2):
        query = stream.stream_predictions(spark, str(src), out, str(tmp_path / "state"), doubles.load_echo)
        query.awaitTermination()
        metrics = [set(p.stateOperators[0].customMetrics) for p in query.recentProgress if p.stateOperators]
        assert k or any("rocksdb" in name for name in metrics[0])
    assert stream.stored(spark, out).count() == 3 and spark.conf.get(stream.PROVIDER, None) is None


class FakeSession:
    def __init__(self, master, conf=None, current=None):
        self.set_to = None
        fake = self

        class Context:
            def getConf(self):
                return conf or {}

            def getCheckpointDir(self):
                return current

            def setCheckpointDir(self, path):
                fake.set_to = path

        self.sparkContext = Context()
        self.sparkContext.master = master
        self.conf = conf or {}


def test_shared_folder_comes_from_the_cluster():
    key = "spark.checkpoint.dir"
    named = FakeSession("spark://host:7077", {key: "hdfs://x/cp"})
    assert session.shared_dir(named) == "hdfs://x/cp" == named.set_to
    assert session.shared_dir(FakeSession("yarn", current="s3a://b/cp")) == "s3a://b/cp"
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert session.shared_dir(local).startswith("/") and local.set_to


def test_stored_table_keeps_only_asked_columns(spark):

    df = session.store(spark.range(5).withColumn("wide", F.lit("w")), "t")
    assert "ReadSchema: struct<id:bigint>" in plan_of(df.select("id")) and df.count() == 5
