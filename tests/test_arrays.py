"""JSON arrays cut at every byte against the parser of the standard library."""

import io
import json
import random

import pytest

from formulary.sources import arrays, readers

HARD = [
    {"NL": 'brackets ]}[{ and "quotes", commas', "FOL": "∀x (Cat(x) → ¬Dog(x))"},
    {"NL": "back\\slash \\", "FOL": '\\"'},
    {"NL": "\\\\\\", "FOL": "\\\\\"]"},
    {"NL": "漢字 🙂 é", "FOL": "∃x∀y"},
    {"NL": "", "FOL": None},
    {"NL": "line\nbreak\ttab \u0001", "FOL": "{\"a\": [1, 2]}"},
]


def spellings():
    yield json.dumps(HARD, ensure_ascii=False)
    yield json.dumps(HARD, indent=2)
    yield " \n[ ]\n"
    yield "[]"
    yield json.dumps([HARD[1]] * 3, separators=(",", ":"))
    yield json.dumps([[1, [2, {"a": "]"}]], "x,y", None, 3.5, {"deep": {"er": [{}]}}])


def in_ranges(data, size):
    """What the two passes do, without Spark."""
    quotes, depth, out = 0, 0, []
    for start in range(0, max(len(data), 1), size):
        stop = min(start + size, len(data))
        escaped = arrays._escaped_before(io.BytesIO(data), start)
        part = arrays.np.frombuffer(data[start:stop], arrays.np.uint8)
        within = quotes % 2 == 1
        out += [v for v in arrays.Elements(io.BytesIO(data), start, stop, escaped, within, depth) if v.strip()]
        real = arrays.real_quotes(part, escaped)
        inside = (arrays.np.cumsum(real) + within) % 2 == 1
        for c, hidden in zip(bytes(part), inside):
            if not hidden and c in b"[{":
                depth += 1
            if not hidden and c in b"]}":
                depth -= 1
        quotes += int(real.sum())
    return [json.loads(v) for v in out]


@pytest.mark.parametrize("text", spellings())
def test_cut_at_every_byte(text):
    data = text.encode()
    for size in range(1, len(data) + 1):
        assert in_ranges(data, size) == json.loads(text), size


def test_small_steps(monkeypatch):
    monkeypatch.setattr(arrays, "STEP", 3)
    data = json.dumps(HARD, ensure_ascii=False).encode()
    for size in (1, 2, 5, 50, len(data)):
        assert in_ranges(data, size) == HARD


@pytest.mark.parametrize("seed", range(20))
def test_random_texts(seed):
    rng = random.Random(seed)
    letters = ['"', "\\", "[", "]", "{", "}", ",", ":", "a", "é", "🙂", " ", "\n"]
    rows = [{"NL": "".join(rng.choices(letters, k=rng.randrange(12)))} for _ in range(rng.randrange(6))]
    data = json.dumps(rows, ensure_ascii=bool(seed % 2)).encode()
    for size in range(1, 40):
        assert in_ranges(data, size) == rows


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_files_in_folders(spark, tmp_path, size):
    for k, text in enumerate([json.dumps(HARD), json.dumps(HARD[:2], indent=1), "[]", ""]):
        (tmp_path / f"f={k}").mkdir()
        (tmp_path / f"f={k}" / "part.json").write_text(text)
    got = sorted(((r.nl, r.fol) for r in readers.read_pairs_json(spark, str(tmp_path), size).collect()), key=str)
    assert got == sorted(((r["NL"], r["FOL"]) for r in HARD + HARD[:2]), key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"NL": f"row {k} ]}},", "FOL": '"' * (k % 5)} for k in range(20_000)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    df = readers.read_pairs_json(spark, str(tmp_path / "one.json"), 20_000)
    assert df.rdd.getNumPartitions() > 20
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 5_000 and sum(sizes) == 20_000
    assert {(r.nl, r.fol) for r in df.collect()} == {(r["NL"], r["FOL"]) for r in rows}


def test_counts_add_up(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(HARD, ensure_ascii=False))
    ranges = arrays.byte_ranges(spark, str(tmp_path), 50)
    want = sorted(map(tuple, arrays.counted(ranges).collect()))
    assert sum(r[4] for r in want) % 2 == 0 and len(want) > 5
    joined = arrays.byte_ranges(spark, str(tmp_path), 10_000)
    whole = arrays.counted(joined).collect()[0]
    assert whole.quotes == sum(r[4] for r in want) and whole.outside == 0


def test_elements_that_are_no_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('[1, "a", null, {"NL": "n", "FOL": "f", "more": [1]}]')
    got = readers.read_pairs_json(spark, str(tmp_path / "x.json"), 5).collect()
    assert sorted((r.nl or "", r.fol or "") for r in got) == [("", "")] * 3 + [("n", "f")]


def test_own_schema(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"k": 1}, {"k": 2}]')
    from pyspark.sql import types as T

    assert sorted(r.k for r in readers.read_array(spark, str(tmp_path), T._parse_datatype_string("k int")).collect()) == [1, 2]


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text(json.dumps(HARD))
    want = sorted(((r["NL"], r["FOL"]) for r in HARD), key=str)
    monkeypatch.setattr(arrays, "STORES", {"elsewhere"})
    assert arrays.elements(spark, str(tmp_path), 5) is None
    got = readers.read_pairs_json(spark, str(tmp_path), 5)
    assert sorted(((r.nl, r.fol) for r in got.collect()), key=str) == want
