import time

import brute
import pytest

import __spark_entry__ as entry
from formulary.llm import licences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, labels string, source string"


def scan(spark, texts):
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, DOCS)).collect()}


def test_whole_table_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op2_licence_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.base_licences(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_hard_texts(spark):
    texts = [
        None,
        "",
        "mit",
        "MIT--License\nmit license, mit license mit licenses",
        "ÉMIT License mit license",
        "GNU General Public\tLicense general public license",
        "a " * 200_000 + "apache license",
        "SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Apache-2.0",
        "spdx license identifier: GPL-2.0-only WITH Classpath-exception-2.0",
        "License-Expression: foo-1.0 or\nmit license",
    ]
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.base_licences(text), text
    assert got[0].score == got[1].score == 1.0 and got[0].labels == ""
    assert got[7].labels == "apache,gpl,mit" and got[7].expressions == ["mit gpl-2.0+ or apache-2.0 and"]
    assert got[8].labels == "gpl" and got[8].score == pytest.approx(0.4)
    assert got[9].labels == "foo-1.0,mit"


@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT", "mit"),
        ("a or b and c with d", "a b c d with and or"),
        ("(a or b) and c", "a b or c and"),
        ("((a))", "a"),
        ("a and", "a"),
        ("or a", ""),
        ("a) or b", "a"),
        ("(a or b", "a b or"),
        ("a b", "a"),
        ("a and (", "a"),
        ("()", ""),
        ("(" * 3000 + "a" + ")" * 3000 + " or b", "a b or"),
        ("a or (((b and c", "a b c and or"),
        ("a, b", "a"),
    ],
)
def test_postfix(text, want):
    assert " ".join(licences.postfix(text)) == want


def test_or_takes_the_freer_side_and_the_stricter():
    assert licences.evaluate(licences.postfix("mit or gpl-3.0"))[1] == 1.0
    assert licences.evaluate(licences.postfix("mit and gpl-3.0"))[1] == licences.FREEDOM["gpl"]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "mit license"), (None, "mit license"), (1, None)]
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in got) == [(0, 1), (0, 1), (1, 0)]
    assert licences.licence_scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("The license expression is valid", ""),
        ("the general public license expression was printed", "gpl"),
        ("license expression: is what follows", ""),
        ("License-Expression = mit", "mit"),
        ("SPDX-License-Identifier: LicenseRef-Own OR MIT", "licenseref-own,mit"),
        ("SPDX-License-Identifier: mit and nothing else", "mit"),
        ('"license expression": "Apache-2.0 or gpl-3.0", x', "apache,gpl"),
        ("spdx license identifier\n: mit", ""),
    ],
)
def test_tags_need_a_mark_and_names_of_licences(spark, text, labels):
    (row,) = scan(spark, [text]).values()
    assert row.labels == labels


def test_many_tags_on_one_line_take_linear_time():
    phrases = licences.automaton(licences.BASE_PHRASES, licences.NOTICE_PHRASES, licences.TAGS)

    def seconds(n, tail):
        text = ("SPDX-License-Identifier: " + tail) * n
        start = time.perf_counter()
        licences.scan(text, phrases)
        return time.perf_counter() - start

    for tail in ("MIT ", "", "(((", "mit or ", "x " * 20):
        assert seconds(4000, tail) < 0.5, tail
