import base64
import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import warc as W
from folioscope.llm.common import scratch

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("refers_to", T.StringType())])
ROWS = [(i, f"http://x.org/{i}", f"<p>é {i % 7}</p>\r\n\r\n<br>", "x") for i in range(40)] + [
    (100, None, None, "x"), (101, "a\r\nX-Page-Id: 9", "", "x"), (102, "u", "WARC/1.1\r\n\r\n" * 3000, "x"), (103, "", "z" * 3_000_000, None), (None, "u", "alone", "x"), (104, "u", "twice", "x"), (104, "u", "twice", "x"),
]


def test_round_trip(spark):
    got = W.round_trip(spark.createDataFrame(ROWS, SCHEMA), scratch(spark, "warc")).collect()
    holder = {}
    for i, _, h, _ in ROWS:
        if i is not None:
            holder[h or ""] = max(i, holder.get(h or "", -1))
    want = []
    for i, _, h, _ in ROWS:
        raw = (h or "").encode()
        own = holder.get(h or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == own else "revisit", None if i == own else own))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_index_and_selected_bodies(spark):
    path = scratch(spark, "warc")
    W.write_archives(spark.createDataFrame(ROWS, SCHEMA), path)
    index = W.index_archives(spark, path, window=64)
    rows = index.collect()
    assert len(rows) == len(ROWS)
    assert {r.url for r in rows} >= {"urn:page:unknown", "a%20X-Page-Id:%209", "http://x.org/3"}
    for gap, most in ((0, 1), (1 << 20, 1 << 30)):
        got = W.read_records(index.where("kind = 'response' and id in ('39', '102', '103')"), gap=gap, most=most, bodies=True).collect()
        assert {r.id: r.body for r in got} == {str(i): h for i, _, h, _ in ROWS if i in (39, 102, 103)}


def test_empty(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA), scratch(spark, "warc")).count() == 0


def test_base32(spark):
    h = hashlib.sha1(b"abc")
    assert spark.range(1).select(W.base32_of_hex(F.lit(h.hexdigest()))).first()[0] == base64.b32encode(h.digest()).decode()
