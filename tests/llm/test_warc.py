import brute
import pytest

from formulary.llm import queries, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, archive string, content string"


def records(spark, rows, **kw):
    df = spark.createDataFrame([(i, "http://e.org/a b", h, "x", None) for i, h in rows], SCHEMA)
    return sorted(map(tuple, warc.archived_pages(df, **kw).collect()), key=str)


def test_whole_table_against_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op6_warc(spark, SF).collect())) == sorted(brute.archived(rows))


@pytest.mark.parametrize("version", [1, 2])
def test_copies_null_empty_and_long_payloads(spark, version):
    rows = [(1, "same"), (7, "same"), (3, "same"), (4, None), (5, ""), (6, "\n\n\r\n"), (8, "é\x00" * 900_000), (9, "HTTP/1.1")]
    assert records(spark, rows, version=version) == sorted(brute.archived(rows), key=str)


def test_small_payloads_stay_responses(spark):
    got = records(spark, [(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")], min_bytes=3)
    assert [(r[0], r[3], r[4]) for r in got] == [
        (1, "response", None),
        (2, "response", None),
        (3, "revisit", 4),
        (4, "response", None),
    ]


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = records(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])
    assert sorted((str(r[0]), r[3], str(r[4])) for r in got) == [
        ("1", "response", "None"),
        ("1", "revisit", "1"),
        ("None", "response", "None"),
        ("None", "revisit", "1"),
        ("None", "revisit", "None"),
    ]
    assert records(spark, []) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    content = warc.arc_archive("n", version, [("http://a/ü x", "text/html", b"1\n2\r\n\r\n"), ("", "t", b"")], "20200102030405")
    about, one, two = warc.read_arc(content)
    assert about.fields["url"] == "filedesc://n" and set(one.fields) == set(warc.ARC_COLUMNS[version])
    assert (one.fields["url"], one.content, two.fields["url"], two.content) == ("http://a/ü%20x", b"1\n2\r\n\r\n", "-", b"")
    fields, block = list(warc.read_warc(warc.warc_archive("n", content, {})))[1]
    assert fields["warc-date"] == "2020-01-02T03:04:05Z" and fields["warc-type"] == "resource" and block == one.content


def test_plain_arc_without_gzip_members_in_one_member():
    about = b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n"
    text = b"filedesc://x 0.0.0.0 20200101000000 text/plain %d\n" % len(about) + about
    text += b"\nhttp://a 1.2.3.4 20200101000000 text/html 3\nabc\nhttp://b 1.2.3.4 20200101000000 text/html 0\n\n"
    got = list(warc.read_arc(warc._member(text)))
    assert [(r.fields["url"], r.content) for r in got[1:]] == [("http://a", b"abc"), ("http://b", b"")]
    with pytest.raises(ValueError):
        list(warc.read_arc(warc._member(text.replace(b"text/html 3", b"text/html 999"))))
    with pytest.raises(ValueError):
        list(warc.read_arc(warc._member(b"hello world 1 2 3\n9 0 x\n")))
