"""The pipeline's rows against brute force, on a small corpus with planted cases."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

import corpus_pipeline as C
from folioscope.llm.bpe import parse_ranks

from .test_language import make
from .test_simhash import slow_groups
from .test_substrings import slow

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(21)
    texts = {i: (make(lang, rng, 120), lang) for i in range(80) for lang in [rng.choice(["en", "de", "fr"])]}
    passage = make("en", rng, 90)
    items = [make("en", rng, 30) for _ in range(4)]
    for i in (3, 14, 40):
        texts[i] = (texts[i][0] + "\n" + passage + "\n" + make(texts[i][1], rng, 60), texts[i][1])
    texts[100], texts[101], texts[102] = (texts[5][0], "en"), (texts[5][0], "en"), (texts[6][0] + " ende", texts[6][1])
    texts[110] = (make("en", rng, 80) + "\n" + items[2] + "\n" + make("en", rng, 60), "en")
    texts[120], texts[121], texts[122] = (None, "en"), ("", None), ("12 .. 33 --", "en")
    rows = [(i, t, lang, "src", len(t or "")) for i, (t, lang) in texts.items()]
    rng.shuffle(rows)
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows


def test_pipeline(spark, corpus):
    path, rows = corpus
    got = {r.doc_id: r for r in C.run(spark, path).collect()}
    stay = [(i, t) for i, t, *_ in rows if i not in (120, 121, 122)]
    groups = slow_groups(stay)
    kept = [(i, t) for i, t in stay if any(g == i for d, _, g in groups if d == i)]
    assert not {100, 101} & {i for i, _ in kept}
    removed = dict(zip((i for i, _ in kept), slow([t for _, t in kept], 200)))
    assert sum(x[1] > 0 for x in removed.values()) == 3
    assert set(got) == {i for i, _ in kept} - {110}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    for i, t in kept:
        if i == 110:
            continue
        if not removed[i][1]:
            assert list(got[i].ids) == plain.encode_ordinary(t)
            assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() == removed[i][3]
        else:
            assert plain.decode_bytes(list(got[i].ids)) and abs(len(plain.decode_bytes(list(got[i].ids))) - (removed[i][0] - removed[i][1])) <= 2 * removed[i][2]


def test_stages_keep_the_columns(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(path + "/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), path).count() == 0, name
    assert [n for n, _ in C.STAGES] == ["language", "near duplicates", "substrings", "decontamination", "byte BPE"]
