import random
import zlib

import pytest
from pyspark.sql import types as T

from folioscope.llm import language as L

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
PARTS = {"en": "the ing tion and er of th re".split(), "de": "sch und ein ich keit ung der ß".split(), "fr": "eau eux ment qu le é oi ç".split()}


def make(lang, rng, words):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words)).capitalize()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, make(lang, rng, rng.choice([5, 40, 200])), lang if rng.random() < 0.9 else None, "x") for i in range(400) for lang in [rng.choice(list(PARTS))]]


def test_held_out_accuracy(spark, rows):
    extra = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 34 ... _ ½ ²", "fr", "x"), (None, "the and tion", "en", "x"), (1003, make("de", random.Random(1), 200_000), None, "x"), (7, rows[7][1], rows[7][2], "x")]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    model = L.fit(df)
    got = L.identify(df, model).collect()
    assert len(got) == len(rows) + len(extra)
    pred = {r.id: r for r in got}
    held = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(pred[i].lang_pred == lang for i, _, lang, _ in held) / len(held) > 0.98
    assert all(pred[i].lang_pred == "und" and pred[i].rejected and pred[i].score == 0 for i in (1000, 1001, 1002))
    assert pred[1003].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    kept = L.drop_rejected(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.rejected for r in got)
    assert sum(r.rejected for r in got if r.id is not None and r.id < 1000) <= 4


def test_long_texts_in_pieces_equal_whole(rows):
    model = L.train([r[1] for r in rows if r[2]], [r[2] for r in rows if r[2]])
    texts = [make("en", random.Random(5), 3000), "é", "the", make("fr", random.Random(6), 50)]
    whole, pieces = model.logits(texts), model.logits(texts, at_once=64)
    assert abs(whole - pieces).max() < 1e-3


def test_empty_and_unlabelled(spark, rows):
    assert L.identify(spark.createDataFrame([], SCHEMA), L.train([], [])).count() == 0
    df = spark.createDataFrame([(1, "the and", None, "x")], SCHEMA)
    assert L.identify(df, L.fit(df)).first().lang_pred == "und"
