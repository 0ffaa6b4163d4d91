import pytest
import random
from collections import Counter

from pyspark.sql import functions as F

from formulary.operators import encoding
from formulary.operators.encoding import X, _decode_by_join, _encode_by_join
from formulary.plans import catalog
from support import plan_of


def docs(spark):
    rng = random.Random(5)
    words = ["the"] * 6 + [f"w{i}" for i in range(30)] + ["é", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(200)]
    return spark.createDataFrame([*rows, (200, "   "), (201, None), (202, "the\tthe\n the ")], "row_id bigint, text string")


def test_vocab(spark):
    df = spark.createDataFrame([("b a b c",), ("c a",)], "text string")
    got = [(r.token, r.id) for r in encoding.vocab_build(df, 2).orderBy("id").collect()]
    assert got == [("a", 2), ("b", 3)]  # all twice, so by token
    more = encoding.extend_vocab(encoding.vocab_build(df, 3), ["b", "new", "newer", "new"])
    assert [(r.token, r.id) for r in more.orderBy("id").collect()][3:] == [("new", 5), ("newer", 6)]
    assert more.count() == 5


def test_both_ways_agree(spark):
    df = docs(spark)
    vocab = encoding.vocab_build(df, 20)
    known = {r.token: r.id for r in vocab.collect()}
    text = {r.row_id: (r.text or "").split() for r in df.collect()}
    want = {i: [known.get(w, 1) for w in ws] for i, ws in text.items()}
    tokens = df.select("row_id", F.coalesce(encoding.X.words("text"), F.array().cast("array<string>")).alias("ids"))
    ways = [
        encoding.encode(df, vocab),
        encoding.encode(df, vocab, max_shipped=3),
        _encode_by_join(tokens, vocab, min_heavy_rows=50),
    ]
    for way in ways:
        assert {r.row_id: r.ids for r in way.collect()} == want
    back = {i: " ".join(w for w in ws if w in known) for i, ws in text.items()}
    encoded = ways[0]
    for way in [
        encoding.decode(encoded, vocab),
        encoding.decode(encoded, vocab, max_shipped=3),
        _decode_by_join(encoded, vocab, min_heavy_rows=50),
    ]:
        assert {r.row_id: r.text for r in way.collect()} == back


def test_two_texts_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a b", "b"), (2, None, "c a c"), (3, "", "")], "row_id int, nl string, label string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "token string, id int")
    want = {1: ([2, 3], [3]), 2: ([], [4, 2, 4]), 3: ([], [])}
    for shipped in [10, 0]:
        got = encoding.encode(df, vocab, {"x": "nl", "y": "label"}, max_shipped=shipped).collect()
        assert {r.row_id: (r.x, r.y) for r in got} == want
    r = encoding.training_rows(df, vocab, 3).filter("row_id = 2").first()
    assert (r.input_ids, r.attention_mask, r.labels) == ([0, 0, 0], [0, 0, 0], [4, 2, 4])


def test_decode_undoes_encode(spark):
    df = docs(spark)
    vocab = encoding.vocab_build(df, 1000)
    got = {r.row_id: r.text for r in encoding.decode(encoding.encode(df, vocab), vocab).collect()}
    assert got == {r.row_id: " ".join((r.text or "").split()) for r in df.collect()}


def test_specials_are_skipped(spark):
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 2), ("b", 3)], "token string, id int")
    df = spark.createDataFrame([(1, [0, 2, 3, 9, 2, 0])], "row_id int, ids array<int>")
    assert encoding.decode(df, vocab).first().text == "a b a"
    assert encoding.decode(df, vocab, specials=()).first().text == "<pad> a b a <pad>"


def test_padding(spark):
    df = spark.createDataFrame([(1, 0, [5, 6, 7]), (2, 0, [8]), (3, 1, [])], "row_id int, batch_id int, ids array<int>")
    left = {r.row_id: (r.padded, r.mask) for r in encoding.batch_pad(df).collect()}
    assert left == {1: ([5, 6, 7], [1, 1, 1]), 2: ([0, 0, 8], [0, 0, 1]), 3: ([], [])}
    right = {r.row_id: (r.padded, r.mask) for r in encoding.batch_pad(df, "right", 9).collect()}
    assert right[2] == ([8, 9, 9], [1, 0, 0])
    fixed = encoding.fixed_length(df, 2).orderBy("row_id").collect()
    assert [(r.input_ids, r.attention_mask) for r in fixed] == [([5, 6], [1, 1]), ([8, 0], [1, 0]), ([0, 0], [0, 0])]


def test_rows_that_share_an_id_stay_apart(spark):
    rows = [(1, "a b"), (1, "b c"), (2, "a"), (2, None), (3, "zz")]
    df = spark.createDataFrame(rows, "row_id int, text string")
    vocab = encoding.vocab_build(df)
    shipped, joined = (encoding.encode(df, vocab, max_shipped=n) for n in (100, 0))
    as_list = lambda out: sorted((r.row_id, list(r[1])) for r in out.collect())
    assert as_list(shipped) == as_list(joined) and len(as_list(joined)) == 5
    texts = [sorted(map(tuple, encoding.decode(shipped, vocab, max_shipped=n).collect())) for n in (100, 0)]
    assert texts[0] == texts[1] == sorted((i, t or "") for i, t in rows)


def test_whole_vocabulary(spark):
    df = spark.createDataFrame([(1, "b a a c c c"), (2, "d b")], "row_id int, text string")
    got = [(r.token, r.id) for r in encoding.vocab_build(df).orderBy("id").collect()]
    assert got == [("c", 2), ("a", 3), ("b", 4), ("d", 5)]


def test_extension_is_a_short_list(spark):
    vocab = spark.createDataFrame([("a", 2)], "token string, id int")
    with pytest.raises(ValueError):
        encoding.extend_vocab(vocab, [f"t{i}" for i in range(encoding.MAX_EXTENSION + 1)])


def test_joined_way_in_small_portions(spark, monkeypatch):
    """Portions of few tokens, rows longer than one, null lists and null elements."""
    monkeypatch.setattr(encoding, "PORTION_TOKENS", 7)
    rows = [(1, [5, None, 2, 9]), (2, None), (3, []), (None, [2] * 40), (1, [3]), (4, [0, 0])]
    df = spark.createDataFrame(rows, "row_id int, ids array<int>")
    vocab = spark.createDataFrame([("<pad>", 0), ("a", 2), ("b", 3), (None, 7)], "token string, id int")
    want = sorted([(1, "a"), (2, None), (3, ""), (None, " ".join("a" * 40)), (1, "b"), (4, "")], key=str)
    got = [sorted(map(tuple, encoding.decode(df, vocab, max_shipped=n).collect()), key=str) for n in (100, 0)]
    assert [(i, t or "") for i, t in got[0]] == [(i, t or "") for i, t in got[1]]
    assert sorted(((i, t or "") for i, t in got[1]), key=str) == sorted(((i, t or "") for i, t in want), key=str)


def test_joined_way_explodes_no_token(spark):
    df, vocab = docs(spark), spark.createDataFrame([("the", 2), ("w1", 3)], "token string, id int")
    plan = encoding.encode(df, vocab, max_shipped=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_tokens_are_those_of_the_column_function(spark):
    spaces = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.isspace()]
    odd = ["", " ", "\u00a0a\u3000 b\t", "\x1ca\x1fb\x85", "a\u200bb \u2060", *[f"{c}x{c}{c}y{c}" for c in spaces], None]
    df = spark.createDataFrame(list(enumerate(odd)), "row_id int, text string")
    bad = spark.sql("SELECT -1 AS row_id, CAST(X'61FF6220C3' AS STRING) AS text")
    df = df.union(bad)
    want = {r.row_id: r.w or [] for r in df.select("row_id", X.words("text").alias("w")).collect()}
    vocab = encoding.vocab_build(df)
    counts = Counter(w for ws in want.values() for w in ws)
    ranked = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    ids = {w: i + 2 for i, w in enumerate(ranked)}
    assert {r.token: r.id for r in vocab.collect()} == ids
    for shipped in (100, 0):
        got = {r.row_id: list(r.ids) for r in encoding.encode(df, vocab, max_shipped=shipped).collect()}
        assert got == {k: [ids[w] for w in ws] for k, ws in want.items()}


def test_wide_steps_are_generated_code_and_count_nothing_in_vain(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "row_id int, text string")
    vocab = encoding.vocab_build(df)
    joined = encoding.encode(df, vocab, max_shipped=0)
    assert "_hot" not in plan_of(joined)  # a few portions make no token frequent
    padded = encoding.batch_pad(joined.withColumn("batch_id", F.lit(0)))
    out = padded.select(catalog._joined("padded").alias("padded"), catalog._joined("mask").alias("mask"))
    assert "lambda" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [("0 0 5", "0 0 1"), ("2 3 4", "1 1 1")]
