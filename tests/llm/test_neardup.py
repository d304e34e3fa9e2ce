import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline as C
from folioscope.llm import neardup as N

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(rows):
    sets, label, changed = [grams(t) for _, t in rows], list(range(len(rows))), True
    while changed:
        changed = False
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if label[y] < label[x] and (a == b or a and b and len(a & b) >= 0.8 * len(a | b)):
                    label[x], changed = label[y], True
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[label[x]] = min(i, ids.get(label[x], i))
    return sorted(((i, ids.get(label[x])) for x, (i, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n))
    rows, texts = [], [prose(rng.randrange(20, 200)) for _ in range(40)]
    for i, t in enumerate(texts):
        for _ in range(rng.randrange(4)):
            words = t.split()
            for _ in range(rng.randrange(1, 5)):  # near and somewhat less near copies
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words)) if len(texts) < 150 else None
    frame = prose(60)
    texts += [frame + " " + prose(40) for _ in range(30)] + [frame + " " + prose(2) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, texts[3].upper()), (901, None), (902, ""), (903, "two words"), (904, "Two  Words"), (None, texts[5] + " end"), (None, prose(30)), (7, texts[7])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("unit_rows", [2048, 5])
def test_groups_are_those_of_all_pairs(spark, unit_rows):
    rows = corpus()
    got = N.near_copy_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), unit_rows=unit_rows).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == slow_groups(rows)


def test_stage_drops_copies_that_differ_in_some_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(120)]
    far, near = list(words), list(words)
    near[50] = near[90] = "changed"  # 10 of 116 shingles: similarity 0.84
    for k in (20, 50, 80):  # 0.77
        far[k] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], SCHEMA)
    assert sorted(r.doc_id for r in C.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_stage_links_by_fingerprints_and_by_shingles(spark):
    """Links of both kinds make one group; against all pairs."""
    from .test_simhash import slow_print

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    rows = [(i, t) for i, t in corpus() if i is not None and i < 60]
    # two different one-word sets apart from a frequent shingle: the same fingerprint, few shingles in common
    frame = " ".join(["on"] * 400)
    rows += [(200 + k, frame + " " + " ".join(words[k * 60 : k * 60 + 60])) for k in range(4)]
    rows += [(300, frame + " " + " ".join(words[:59] + ["other"])), (301, None), (302, "")]
    sets, prints = [grams(t) for _, t in rows], [slow_print(t) for _, t in rows]
    by_set = lambda x, y: sets[x] == sets[y] or sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    by_print = lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4
    label, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(len(rows)):
                if label[y] < label[x] and (by_set(x, y) or by_print(x, y)):
                    label[x], changed = label[y], True
    least = {}
    for x, (i, _) in enumerate(rows):
        least[label[x]] = min(i, least.get(label[x], i))
    assert any(by_print(x, y) and not by_set(x, y) for x in range(len(rows)) for y in range(x))
    assert any(by_set(x, y) and not by_print(x, y) for x in range(len(rows)) for y in range(x))
    want = set(least.values())
    assert {r.doc_id for r in C.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()} == want
