import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from folioscope.llm import substrings as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_chars", T.LongType())])


def slow(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(rng, length):
    vocab = ["ab", "é", "zz ", "qrs", "t", "uvw", "x"]
    make = lambda n: "".join(rng.choice(vocab) for _ in range(n))
    shared = [make(rng.randrange(length // 4, length)) for _ in range(6)]
    texts = [None, "", "a" * (length - 1), "a" * (length * 3), "ab" * (2 * length), make(length)]
    for _ in range(60):
        texts.append("".join(rng.choice([make(rng.randrange(1, length)), rng.choice(shared)]) for _ in range(rng.randrange(1, 7))))
    base = make(3 * length)
    for _ in range(12):
        i = rng.randrange(len(base))
        texts.append(base[:i] + rng.choice(vocab) + base[i + 1 :])
    return texts + texts[10:14] + texts[10:12]


@pytest.mark.parametrize("length,q,cell,chunk", [(24, 8, 4, 64), (40, 16, 8, 1 << 19), (30, 10, 16, 100)])
def test_equals_brute_force(spark, length, q, cell, chunk):
    texts = corpus(random.Random(length), length)
    rows = [(i if i % 9 else None, t, "clash", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, S.substring_digests(df, length=length, q=q, cell=cell, chunk=chunk).collect()), key=str)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, slow(texts, length))), key=str)


def test_production_length(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ñ") for _ in range(n))
    shared = make(260)
    texts = [make(rng.randrange(0, 400)) + rng.choice([shared, "", shared[30:215]]) + make(rng.randrange(0, 400)) for _ in range(40)] + [make(60_000)]
    texts.append(texts[-1][100:50_000])
    df = spark.createDataFrame([(i, t, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in S.substring_digests(df).collect()}
    assert [got[i] for i in range(len(texts))] == slow(texts, 200)
    clean = {r.doc_id: r for r in S.drop_substrings(df).collect()}
    assert len(clean) == len(texts) and clean[0].n_chars == len(clean[0].text)
    for i, t in enumerate(texts):
        assert abs(len(clean[i].text.encode()) - (got[i][0] - got[i][1])) <= 2 * got[i][2]


def test_empty(spark):
    assert S.substring_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_column_names(spark):
    rows = [(1, "x" * 300, "a", 5, 6, "s"), (2, "y" + "x" * 299, "b", 7, 8, "t"), (3, None, "c", 9, 10, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 string, _k2 int, _copies int, _spans string")
    out = sorted(S.drop_substrings(df).collect())
    assert [tuple(r) for r in out] == [(1, "", "a", 5, 6, "s"), (2, "y", "b", 7, 8, "t"), (3, None, "c", 9, 10, "u")]
