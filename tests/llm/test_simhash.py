import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from folioscope.llm import simhash as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def slow_print(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(len(rows)):
                if (prints[x][1] ^ prints[y][1]).bit_count() <= 4 and label[y] < label[x]:
                    label[x], changed = label[y], True
    ids = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            ids[label[x]] = min(i, ids.get(label[x], i))
    return sorted(((i, f"{p:016x}", ids.get(label[x])) for x, (i, p) in enumerate(prints)), key=str)


def test_every_close_pair_meets():
    rng = random.Random(3)
    for first, width in S.BLOCKS:
        for _ in range(300):
            x = rng.getrandbits(width)
            y = x ^ (1 << rng.randrange(width)) if rng.random() < 0.9 else x
            syn = lambda v: sum(((v & c).bit_count() & 1) << i for i, c in enumerate(S._CHECKS))
            home = x ^ S._masks(syn(x), width, 2)[0]
            assert syn(home) == 0 and (home ^ x).bit_count() <= 1
            near = [y ^ m for m in S._masks(syn(y), width, 2)]
            assert home in near and all(syn(n) == 0 and (n ^ y).bit_count() <= 2 for n in near)


@pytest.mark.parametrize("unit_rows", [4096, 64, 8, 2])
def test_links_span_the_same_components(spark, unit_rows):
    rng = random.Random(5)
    fps = []
    for size in (1, 2, 5, 60, 150):
        x = rng.getrandbits(64)
        for _ in range(size):
            fps.append(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps) | {rng.getrandbits(64) for _ in range(300)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {frozenset((r.a, r.b)) for r in S.links(df, unit_rows=unit_rows).collect()}
    true = {frozenset((x, y)) for x in signed for y in signed if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    assert got <= true

    def comps(edges):
        root = {x: x for x in signed}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for e in edges:
            a, b = map(find, e)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    assert comps(got) == comps(true)


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [(None, "a b c"), (900, None), (901, ""), (902, " \n\t"), (903, "Ü ü"), (904, "One"), (905, "oNE"), (906, "one\x0btwo"), (906, "one\x0btwo")], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((i, " ".join(words)))
            i += 1
    rows.append((700, " ".join(rng.choice(vocab) for _ in range(30000))))
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA)
    got = sorted(map(tuple, S.near_duplicate_groups(df).collect()), key=str)
    assert got == slow_groups(rows)
    kept = S.drop_near_duplicates(df)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for i, _, c in got if i is not None and i == c}) and kept.columns == df.columns


def test_empty(spark):
    assert S.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
