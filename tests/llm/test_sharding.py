import zlib

import pytest

from pixelloom.llm.sharding import byte_shards

from .helpers import SCHEMA, awkward


def check(rows, got, n):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    total, most = sum(w[1] for w in want), max((w[1] for w in want), default=0)
    by_shard = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        by_shard.setdefault(r.shard, []).append(r)
    order = []
    for shard in sorted(by_shard):
        own = sorted(by_shard[shard], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) <= most
        order += [-1 if r.doc_id is None else r.doc_id for r in own]
    assert order == sorted(order)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_contiguous_and_balanced(spark, n):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(rows, byte_shards(docs, n).collect(), n)


def test_one_key_for_most_rows(spark):
    rows = [(7, "same text", None, None, 0, None, None)] * 300 + awkward(n=20)
    check(rows, byte_shards(spark.createDataFrame(rows, SCHEMA)).collect(), 8)


def test_empty_and_bad_count(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_shards(empty).count() == 0
    with pytest.raises(ValueError):
        byte_shards(empty, 0)
