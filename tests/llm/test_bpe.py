import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from folioscope.llm.bpe import TreeCodec, encode_documents, parse_ranks

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(VOCAB, "rb") as f:
        return parse_ranks(f.read())


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf_chars,leaf_bytes", [(1, 1), (3, 2), (16, 8), (64, 16)])
def test_tree_equals_library(ranks, plain, leaf_chars, leaf_bytes):
    codec = TreeCodec(ranks, P.PATTERN, leaf_chars, leaf_bytes)
    rng = random.Random(7)
    alphabet = ["a", "b", "th", "e ", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "ß", "中", "😀", ".", "!!", " ", " ", "\x1c", "ing", "tion"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))
        assert codec.encode(text) == plain.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    for text in ("a" * 5000, "ab" * 3000, " " * 3000, "\n \t" * 900, "x" * 999 + " " + "y" * 999, "thetion" * 700, "!?" * 800):
        assert codec.encode(text) == plain.encode_ordinary(text)


def test_documents(spark, plain):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    long = " ".join(f"word{i}thth" for i in range(20000)) + "z" * 30000
    rows = [(1, "the the", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (1, "the the", "x"), (4, long, None)]
    got = encode_documents(spark.createDataFrame(rows, schema), VOCAB, P.PATTERN).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert list(r.ids) == plain.encode_ordinary(text) and r.n_tokens == len(r.ids)
    assert encode_documents(spark.createDataFrame([], schema), VOCAB, P.PATTERN).count() == 0
