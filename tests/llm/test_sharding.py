import random
import zlib
from collections import defaultdict

from pyspark.sql import types as T

from folioscope.llm import sharding as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType())])


def slow_pack(items, capacity, bins):
    rooms, out = ([capacity] * bins if bins else []), defaultdict(int)
    for size in sorted(items, reverse=True):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= size]
        if not fits and bins is None:
            rooms.append(max(capacity, size))
            fits = [(rooms[-1], len(rooms) - 1)]
        r, b = min(fits) if fits else max((r, b) for b, r in enumerate(rooms))
        rooms[b] -= size
        out[size, b] += 1
    return dict(out)


def test_packing_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))]
        capacity, bins = rng.randrange(20, 60), rng.choice([None, 3, 8])
        got = defaultdict(int)
        for size, b, n in S.best_fit_decreasing([(s, items.count(s)) for s in set(items)], capacity, bins):
            got[size, b] += n
        assert dict(got) == slow_pack(items, capacity, bins)


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    slots, load = defaultdict(list), [0] * shards
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return load


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(200), "x") for i in range(900)] + [(None, None, None), (5, "", "x"), (None, "dup", "x")] + [(2000 + i, "one text that many share", "x") for i in range(300)] + [(9, "y" * 9000, "x")]
    rng.shuffle(rows)
    got = S.shard_by_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    load = check(rows, got)
    assert max(load) - min(load) < 0.01 * sum(load)
    text_of = defaultdict(set)
    shard_of = {r.doc_id: r.shard for r in got}
    for i, t, _ in rows:
        if i not in (None, 5, 9):
            text_of[t].add(shard_of[i])
    assert all(len(x) == 1 for t, x in text_of.items())


def test_group_over_a_share_is_cut(spark):
    rows = [(i, "the same text", "x") for i in range(3000)] + [(5000 + i, f"t{i}", "x") for i in range(300)]
    load = check(rows, S.shard_by_bytes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert max(load) - min(load) < 0.05 * sum(load)


def test_empty(spark):
    assert S.shard_by_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
