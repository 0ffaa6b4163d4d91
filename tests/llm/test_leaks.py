"""Winnowing against a plain search for every window."""

import hashlib
import random

import brute
import pytest

from formulary.llm import leaks

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def plain_version(docs, items, size=10):
    known = {}
    for item, text in items:
        words = brute.WORD.findall(brute.lower(text))
        k = min(len(words), size)
        for i in range(len(words) - k + 1 if k else 0):
            known.setdefault(tuple(words[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words = brute.WORD.findall(brute.lower(text))
        hit, met = set(), set()
        for k in {len(w) for w in known}:
            for i in range(len(words) - k + 1):
                found = known.get(tuple(words[i : i + k]))
                if found:
                    hit.update(range(i, i + k))
                    met |= found
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(met), digest, bool(hit)))
    return sorted(out, key=str)


def corpus(seed, vocab, shortest):
    """Random texts, some of which hold pieces of items, whole or cut, with marks and capitals between words."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocab)] + ["É", "é", "漢字", "ı", "K"]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(shortest, 30)))) for k in range(40)]
    docs = []
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choices(words, k=rng.randrange(25))
            item = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(item) + 1)
            parts += item[a : a + rng.randrange(25)]
        docs.append((k, "".join(w.upper() + rng.choice([" ", ", ", "\n-", "  "]) if w.isascii() else w + "." for w in parts)))
    return docs, items


def check(spark, docs, items, **more):
    got = leaks.decontaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == plain_version(docs, items, more.get("size", 10))
    return got


@pytest.mark.parametrize("seed,vocab,shortest,more", [
    (1, 500, 10, {}),
    (2, 500, 1, {}),
    (3, 12, 10, {}),
    (4, 500, 8, {"max_broadcast": 0}),
    (5, 6, 5, {"max_broadcast": 0}),
    (6, 20, 3, {"size": 7, "seed": 7}),
    (7, 20, 3, {"size": 6, "seed": 1}),
])
def test_equals_the_plain_search(spark, seed, vocab, shortest, more):
    got = check(spark, *corpus(seed, vocab, shortest), **more)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("max_broadcast", [leaks.MAX_BROADCAST, 0])
def test_nulls_empties_repeats_and_shared_ids(spark, max_broadcast):
    span = "one two three four five six seven eight nine ten"
    docs = [(1, span), (1, span), (1, "other " + span.upper()), (None, span), (None, None), (2, None), (3, ""), (4, "!?")]
    docs += [(5, span + " " + span), (6, "one two three four five six seven eight nine"), (7, "x"), (0, span), (0, "lone")]
    items = [(1, span), (1, "lone"), (2, span), (None, "one two"), (None, None), (3, ""), (4, "?"), (10, "zero " + span)]
    check(spark, docs, items, max_broadcast=max_broadcast)


@pytest.mark.parametrize("items", [[], [(1, None), (2, "..")]])
def test_nothing_to_find(spark, items):
    check(spark, [(1, "a b c"), (2, None)], items)


def test_empty_documents(spark):
    assert check(spark, [], [(1, "a b")]) == []


def test_text_longer_than_a_block(spark):
    rng = random.Random(9)
    words = [f"v{rng.randrange(3000)}" for _ in range(3 * leaks.BLOCK)]
    spans = [leaks.BLOCK - 5, leaks.BLOCK, 2 * leaks.BLOCK - 9, len(words) - 10, 0]
    items = [(k, " ".join(words[a : a + 10])) for k, a in enumerate(spans)]
    got = check(spark, [(1, " ".join(words)), (2, "v1")], items)
    assert got[0][2] >= 45 and got[0][3] == 5


def test_a_document_repeated_often_and_other_columns(spark):
    span = "a b c d e f g h i j"
    names = "doc_id bigint, text string, n_hit int, id0 int, tkey string, words string, g int, start int, item int, size int"
    docs = spark.createDataFrame([(9, span, 0, 1, "k", "w", 2, 3, 4, 5)] * 500 + [(8, "a b", 0, 1, "k", "w", 2, 3, 4, 5)], names)
    items = spark.createDataFrame([(1, span, "x", 1)], "item_id bigint, text string, item string, size int")
    got = leaks.decontaminated(docs, items).groupBy("doc_id", "n_hit", "contaminated").count().collect()
    assert sorted(map(tuple, got)) == [(8, 0, False, 1), (9, 10, True, 500)]


def test_no_python_in_the_plan(spark):
    docs, items = corpus(1, 50, 1)
    made = leaks.decontaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    plan = made._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InArrow", "InPandas", "CartesianProduct", "NestedLoop"))
