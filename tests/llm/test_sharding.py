import zlib

import brute
import numpy as np

from formulary.llm import queries, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, shard string, key int, slot int"


def check(rows, texts):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == want


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op8_jump_sharding(spark, SF).collect()
    check(rows, texts)
    assert len({r.shard for r in rows}) == 24 and any(r.grown_shard == 24 for r in rows)


def test_jump_against_the_plain_loop():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    for n in (1, 2, 24, 25, 999):
        assert sharding.jump(keys, n).tolist() == [brute.jump(int(k), n) for k in keys]


def test_repeats_nulls_and_empty_table(spark):
    texts = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, "x"), (2, ""), (3, "é" * 500_000)]
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in texts], SCHEMA)
    rows = sharding.sharded(df).collect()
    check(rows, texts)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.sharded(df.limit(0)).count() == 0
