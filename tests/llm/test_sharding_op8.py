import zlib

import xxhash
from pyspark.sql import functions as F

from conftest_odd import ODD
from tidewatch.llm.sharding import ROUNDS, _domain, feistel, shards


def place(number, n, seed):
    """The same network on whole numbers, walked until a row number comes out."""
    a, b = _domain(n)

    def mix(key, value, size):
        first = xxhash.xxh32(b"").intdigest() and 42
        h = xxhash.xxh64((key & 0xFFFFFFFF).to_bytes(4, "little"), seed=first).intdigest()
        h = xxhash.xxh64(value.to_bytes(8, "little"), seed=h).intdigest()
        return (h - (1 << 64) if h >> 63 else h) % size

    while True:
        left, right = number % a, number // a
        for k in range(ROUNDS):
            key = seed * ROUNDS + k
            if k % 2 == 0:
                left = (left + mix(key, right, a)) % a
            else:
                right = (right + mix(key, left, b)) % b
        number = right * a + left
        if number < n:
            return number


def test_permutation(spark):
    for n in (1, 2, 7, 97, 1000):
        a, b = _domain(n)
        cells = [r[0] for r in spark.range(a * b).select(feistel(F.col("id"), n, 3)).collect()]
        assert sorted(cells) == list(range(a * b)) and a * b >= n


def test_shard_and_slot_follow_from_the_row_number(spark):
    ids = [x * 3 for x in range(100)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in shards(docs.repartition(5), 7, seed=2).collect()}
    want = {i: (place(k, 100, 2) % 7, place(k, 100, 2) // 7) for k, i in enumerate(ids)}
    assert got == want
    again = {r.doc_id: (r.shard, r.slot) for r in shards(docs.coalesce(1), 7, seed=2).collect()}
    assert again == want
    assert [got[i] for i in ids] != sorted(got.values())


def test_odd_documents(odd, none):
    rows = shards(odd, 4).collect()
    assert len(rows) == len(ODD) and shards(none).count() == 0
    data = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == data
    for k in range(4):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
