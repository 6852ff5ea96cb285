import zlib
from collections import Counter

from pyspark.sql import functions as F

from headway.llm.sharding import permuted, shard


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        got = [r.id for r in permuted(spark.range(n).select("id"), "id", n, 5).collect()]
        assert sorted(got) == list(range(n))
    first = permuted(spark.range(1000), "id", 1000, 5)
    assert [r.id for r in first.collect()] != list(range(1000))


def test_shards(spark):
    rows = [(i, f"text {i % 7}" * (i % 5), "a") for i in range(101)] + [(None, None, "b"), (None, "é", "b"), (200, None, "b")] + [(300, "same", "c")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard(df.repartition(6)).collect()
    again = shard(df.repartition(2).orderBy(F.desc("doc_id"))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shard(df.limit(0)).count() == 0
