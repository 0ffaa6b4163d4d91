import random

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(rows, SCHEMA)


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_are_in_order_and_registered():
    assert [n for n, _ in pipeline.STAGES] == [
        "toxicity",
        "n-gram Jaccard join",
        "substring dedup",
        "mixing sources to target weights",
        "best-fit packing",
    ]
    assert "pipeline" in entry.queries()


def test_every_stage_on_the_whole_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, step) in enumerate(pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()] if "text" in docs.columns else []
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            after = {(r.doc_id, r.text, r.source): r.n_chars for r in docs.collect()}
            assert all(n == len(t) for (_, t, _), n in after.items())
        if k == 0:
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {i for i, _, _ in before} - {i for i, _, _ in after}
            assert sum(labels.get(i) == 0 for i in gone) <= 1 and set(after) <= set(before)
        if k == 1:
            want = {i for i, (c, _) in brute.near_duplicates([(i, t) for i, t, _ in before]).items() if i == c}
            assert set(after) == {row for row in before if row[0] in want}
        if k == 2:
            digests = {d[0]: d for d in brute.without_repeats([(i, t) for i, t, _ in before], 50)}
            for i, t, _ in after:
                assert digests[i][3] == brute.hashlib.sha256(" ".join(brute.SPACE_WORD.findall(t)).encode()).hexdigest()
            lost = {i for i, _, _ in before} - {i for i, _, _ in after}
            assert all(digests[i][1] == digests[i][2] > 0 for i in lost)
        if k == 3:
            assert set(after) <= set(before)
            sums, taken = {}, {}
            for i, t, s in before:
                sums[s] = sums.get(s, 0) + len(brute.SPACE_WORD.findall(t))
            for r in docs.collect():
                taken[r.source] = taken.get(r.source, 0) + len(brute.SPACE_WORD.findall(r.text))
            longest = max(len(brute.SPACE_WORD.findall(t)) for _, t, _ in before)
            want = brute.targets(sums)
            assert all(abs(taken.get(s, 0) - want[s]) <= longest for s in sums)
        if k == 4:
            held = {}
            for r in docs.collect():
                held.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for places in held.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
                assert at <= 1024
            assert {r.doc_id for r in docs.collect()} == {i for i, _, _ in after}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_nulls_repeats_and_empty_tables(spark, name):
    rng = random.Random(0)
    long = " ".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(1, None, None), (2, "", "s"), (None, "x y z", "s"), (None, None, None), (3, long, "s"), (3, long, "s")]
    rows += [(4, f"{long[:600]} tail", "t"), (5, "unlike all others, short", "t")]
    docs = frame(spark, rows)
    out = stage(name)(spark, docs, SF).collect()
    if name == "n-gram Jaccard join":
        assert sum(r.doc_id == 3 for r in out) == 1 and sum(r.doc_id is None for r in out) == 2
    if name == "substring dedup":
        assert {r.doc_id: r.text for r in out}[4] == "tail" and len(out) == len(rows)
    if name == "toxicity":
        assert len(out) == len(rows)
    if name == "best-fit packing":
        assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert stage(name)(spark, docs.limit(0), SF).count() == 0


def test_passages_go_and_what_stays_keeps_its_form(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one  two\n{passage}\tthree", "s"), (2, f"four\n\nfive {passage}  six  seven\n", "s"), (3, passage, "s")]
    rows += [(4, " ".join(f"p{i}" for i in range(49)), "s")]
    got = {r.doc_id: (r.text, r.n_chars) for r in stage("substring dedup")(spark, frame(spark, rows), SF).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("four\n\nfive six  seven", 21), 4: (rows[3][1], len(rows[3][1]))}
