"""The piece table against string slices, and exact round trips."""

import hashlib
import random

from pyspark.sql import functions as F

from formulary.llm import middle

SCHEMA = "doc_id bigint, text string"


def plain_version(doc_id, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted([h[0] % (len(t) + 1), h[1] % (len(t) + 1)])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return t, "plain", None, None
    if h[3] % 100 < 20:
        return f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", "spm", a, b - a
    return f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "psm", a, b - a


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def texts():
    rng = random.Random(3)
    alphabet = ["a", "ß", "漢", "🙂", "é", "<", "P", ">", "<S", " ", "\n"]
    odd = [None, "", "x", "<P", "<<P>", "a <S> b", "<M>", "S>", "\x00", "🙂" * 3]
    return odd + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]


def test_digests_equal_the_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "no id"), (None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = middle.middle_digests(docs).collect()
    want = []
    for i, t in rows:
        out, form, prefix, mid = plain_version(i, t)
        want.append((i, len(t or ""), form, prefix, mid, sha(out), sha(t or "")))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, made), key=key) == sorted(want, key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_outputs_are_texts_and_come_back(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), SCHEMA)
    made = middle.fill_in_middle(docs)
    back = middle.restore(made).join(docs, "doc_id")
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("restored")).count() == 0
    got = {r.doc_id: (r.output, r.form) for r in made.collect()}
    assert all(got[k] == plain_version(k, t)[:2] for k, t in enumerate(texts()))


def test_very_long_text_and_other_columns(spark):
    long = "wörd 🙂 " * 400_000
    names = "doc_id bigint, text string, output string, form string, n int, restored int, restored_sha256 int"
    docs = spark.createDataFrame([(k, long, "x", "y", 1, 2, 3) for k in range(4)], names)
    rows = middle.middle_digests(docs).collect()
    assert len(rows) == 4 and all(r.n == len(long) and r.restored_sha256 == sha(long) for r in rows)
    assert all(r.output_sha256 == sha(plain_version(r.doc_id, long)[0]) for r in rows)


def test_restore_needs_only_output_and_form(spark):
    rows = [("<P>a<S>c<M>b", "psm"), ("<S>c<P>a<M>b", "spm"), ("<P><S><M>", "psm"), ("abc", None), (None, "plain")]
    rows += [("no marks", "psm"), ("<P>a<M>b", "psm"), ("a", "other")]
    made = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, output string, form string")
    got = [r.restored for r in middle.restore(made).orderBy("k").collect()]
    assert got == ["abc", "abc", "", "abc", "", None, None, None]


def test_empty_table_and_no_shuffle(spark):
    docs = spark.createDataFrame([], SCHEMA)
    made = middle.middle_digests(docs)
    assert made.count() == 0
    assert "Exchange" not in made._jdf.queryExecution().toString()


def test_piece_table_steps():
    table = middle.PieceTable("abcdef", "<P><S><M>")
    cut = table.cut(2).cut(2).cut(5)
    assert [(p.start, p.length) for p in cut.pieces] == [(0, 2), (2, 0), (2, 3), (5, 1)]
    for order in ([3, 1, 0, 2], [0, 1, 2, 3], [2, 3, 1, 0]):
        assert cut.permuted(order).restored(order).pieces == cut.pieces
    assert cut.text() == "abcdef" and cut.sha256() == sha("abcdef")
    assert middle.PieceTable("", "").cut(0).text() == ""
