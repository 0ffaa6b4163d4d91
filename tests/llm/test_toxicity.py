import random
import zlib

from formulary.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, score string, toxic string"


def area(scores, labels):
    """Share of (toxic, ordinary) pairs in the right order."""
    ranked = sorted(zip(scores, labels))
    below, wins = 0, 0.0
    n1 = sum(labels)
    for k, (s, y) in enumerate(ranked):
        below += not y
        wins += below if y else 0
    return wins / (n1 * (len(labels) - n1))


def test_held_out_accuracy(spark):
    got = queries.op1_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert area([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.93
    wrong = sum(r.predicted and not labels[r.doc_id] for r in held)
    assert wrong <= 0.02 * len(held)


def small(spark, n=300):
    rng = random.Random(0)
    plain = ["the", "and", "house", "river", "stone", "garden", "window", "paper"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            for k in range(5):
                words[rng.randrange(40)] = "zgrumpf" + rng.choice(["", "el", "ix"])
        rows.append((i, " ".join(words), "s", "t"))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_hard_texts_and_filter(spark):
    rows, labels = small(spark)
    more = [(1000, None, "", ""), (1001, "", "", ""), (None, "zgrumpfel " * 4, "", ""), (1002, "x" * 2_000_000, "", "")]
    more += [(1003, "the zgrumpf and zgrumpfix zgrumpf zgrumpf", "", ""), (1004, "house river", "", ""), (1004, "house river", "", "")]
    docs = spark.createDataFrame(rows + more, DOCS)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(more)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score < 0.5 and by[1003].predicted == 1 and by[1004].predicted == 0
    assert sum(by[i].predicted != (i % 3 == 0) for i in range(300)) <= 3
    kept = toxicity.keep_ordinary(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert 1000 in left and 1003 not in left and left.count(1004) == 2


def test_labels_of_one_kind_none_and_no_rows(spark):
    rows, labels = small(spark, 30)
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.predicted for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
