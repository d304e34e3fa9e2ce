"""Golden rows of the operators whose semantics SQL cannot express."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import ids as Ids
from folioscope.functions import numbers as N
from folioscope.functions import text as T
from folioscope.operators import associate as A
from folioscope.operators import corroborate as C
from folioscope.operators import diagnostics as D
from folioscope.operators import enrich as En
from folioscope.operators import evaluate as E
from folioscope.operators import glyphs as Gl
from folioscope.operators import grouping as Gr
from folioscope.operators import ink as Ink
from folioscope.operators import intervals as I
from folioscope.operators import project as P
from folioscope.operators import validate as V
from folioscope.streaming import stateful as S

AGREE = [
    ("$3.5mm", "$3.5mm"), ("(1,234)", "-1,234"), ("€1.234,56", "€1.234,56"), ("₹5,00,000", "₹5,00,000"), ("FY2024", "FY 2024"), ("−42", "-42"), ("3 x 4", "3x4"), ("grew 5 %", "grew 5%"),
    ("12/31/2024", "12/31/2024"), ("112.6 billion", "112.6"), ("in 2024", "2024"), ("Cash 1,234 Debt 5,678", "1,234 Debt 5,678"), ("EBITDA 45.6%", "EBlTDA 45.6%"), ("USD 450", "USO 450"), ("1 234 567", "1234567"),
]
CONFLICT = [("$3.5mm", "$3.5m"), ("1 234", "1234"), ("1,234", "1.234"), ("FY2024E", "FY2024F"), ("10.5%", "1O.5%"), ("$5 million", "$5 rnillion"), ("3.5 mm", "3.5 m")]
OBS = "page_id long, ord int, id string, text string, x0 double, y0 double, x1 double, y1 double, font string"
READ = "page_id long, ord int, id string, text string, x0 double, y0 double, x1 double, y1 double, confidence double, recovery_method string"


def natives(spark, rows, page=1, font="F1"):
    return spark.createDataFrame([(page, i, f"n{i}", t, *map(float, b), font) for i, (t, b) in enumerate(rows)], OBS)


def reads(spark, rows, page=1, confidence=0.9, recovery=None):
    return spark.createDataFrame([(page, i, f"o{i}", t, *map(float, b), confidence, recovery) for i, (t, b) in enumerate(rows)], READ)


def test_critical_tokens_agree_and_conflict(spark):
    rows = [(a, b, True) for a, b in AGREE] + [(a, b, False) for a, b in CONFLICT]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumns({"ta": T.critical_tokens(F.col("a")), "tb": T.critical_tokens(F.col("b"))})
    got = df.select("a", "b", "want", T.tokens_agree(F.col("ta"), F.col("tb")).alias("got")).collect()
    assert [(r.a, r.b) for r in got if r.got != r.want] == []


def test_token_extraction(spark):
    rows = [("cash 1,234 debt 5,678", ["1,234|deb", "5,678"]), ("5 units 7", ["5|unit", "7"]), ("5 x 7", ["5", "7"]), ("1,234.5 million", ["1,234.5|million"]), ("no number", []), (None, [])]
    df = spark.createDataFrame([(a, b) for a, b in rows], "a string, b array<string>")
    got = df.withColumn("t", T.critical_tokens(F.col("a"))).select("b", F.transform("t", T.token_text).alias("t")).collect()
    assert all(list(r.t) == list(r.b) for r in got)


def test_similarity(spark):
    rows = [("Revenue", "revenue", 1.0), ("a b", "ab", 1.0), ("Total", "Grand Total", 5 / 10), ("x y z", "x q z", 2 * 2 / 6), ("", "a", 0.0), (None, None, 0.0), ("$ -5", "-$5", 1.0), ("5 %", "5%", 1.0), ("ﬁne", "fine", 1.0), ("a a b", "a b b", 2 * 2 / 6)]
    df = spark.createDataFrame(rows, "a string, b string, want double").withColumns({"fa": T.evidence_text(F.col("a")), "fb": T.evidence_text(F.col("b"))})
    got = df.select("a", "b", "want", T.similarity(F.col("fa"), F.col("fb")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in got if abs(r.got - r.want) > 1e-9] == []


def test_geometry(spark):
    r = spark.range(1).select(
        G.round_half_up(F.lit(1.005)).alias("a"), G.round_half_up(F.lit(-0.125)).alias("b"),
        G.iou((F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)), (F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("iou"),
        G.overlap_over_smaller((F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0)), (F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("over"),
        G.box_key((F.lit(1.0), F.lit(2.5), F.lit(1234.567), F.lit(-0.125))).alias("key"),
        G.polygon_area(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])).alias("poly"),
        F.array(*G.render_box((F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0)), F.array(*map(F.lit, (2.0, 0.0, 0.0, -2.0, 0.0, 200.0))))).alias("box"),
        G.is_conformal(F.array(*map(F.lit, (2.0, 0.0, 0.0, -2.0, 0.0, 200.0)))).alias("ok"), G.is_conformal(F.array(*map(F.lit, (2.0, 0.0, 1.0, -2.0, 0.0, 200.0)))).alias("shear"),
        G.is_valid((F.lit(0.0), F.lit(0.0), F.lit(float("nan")), F.lit(1.0))).alias("nan"),
    ).first()
    assert (r.a, r.b, r.over, r.key, r.poly, r.box, r.ok, r.shear, r.nan) == (1.0, -0.12, 1.0, "1,2.5,1234.57,-0.12", 6.0, [20.0, 120.0, 60.0, 160.0], True, False, False)
    assert abs(r.iou - 1 / 7) < 1e-12


def slow_fnv(s):
    h = 0x811C9DC5
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    return out.rjust(7, "0")


def test_ids(spark):
    texts = ["", "a", "hello", "é|中", "😀", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Ids.fnv1a(F.col("t")).alias("h")).collect()
    assert all(r.h == slow_fnv(r.t) for r in got)
    js = spark.createDataFrame([('{"b": 1.0, "a": [null, {"z": 1.5, "y": "é"}]}',)], "j string").select(Ids.canonical_json(F.col("j")).alias("c")).first().c
    assert js == '{"a":[null,{"y":"é","z":1.5}],"b":1}'


def test_statistics():
    assert N.mcnemar_exact(0, 0) == 1.0 and abs(N.mcnemar_exact(1, 9) - 2 * 11 / 1024) < 1e-12
    low, high = N.clopper_pearson(0, 30)
    assert low == 0 and abs(high - (1 - 0.025 ** (1 / 30))) < 1e-9
    assert abs(N.upper_bound(0, 30) - (1 - 0.05 ** (1 / 30))) < 1e-9
    assert N.clopper_pearson(0, 0) is None and N.nearest_rank([1, 2, 3, 4], 0.5) == 2 and N.floor_rank([1, 2, 3, 4], 0.5) == 3


def verdicts(spark, native, read, **kw):
    n, o = natives(spark, native), reads(spark, read, **kw)
    return A.associate(n, o, Gr.native_lines(n)).collect()


def test_association_goldens(spark):
    box = (100, 20, 400, 40)
    v = verdicts(spark, [("FY2022 revenue 647", box)], [("FY2022 revenue 641", box)])
    assert [r.verdict for r in v] == ["critical-token-disagreement"]
    v = verdicts(spark, [("2023-04-04", (100, 20, 150, 40))], [("2022-04-04", (101, 19, 151, 41))])
    assert [r.verdict for r in v] == ["critical-token-disagreement"]
    assert verdicts(spark, [("2023-04-04", (100, 20, 150, 40))], [("2022-04-04", (111, 20, 161, 40))]) == []
    v = verdicts(spark, [("2023-04-04", (100, 20, 150, 40)), ("2022-04-04", (100, 20, 150, 40))], [("2022-04-04", (100, 20, 150, 40))])
    assert [r.verdict for r in v] == ["match"]
    v = verdicts(spark, [("Revenue grew by", (10, 20, 110, 40)), ("33.4% in 2022", (112, 20, 200, 40))], [("Revenue grew by 33.4% in 2022", (10, 20, 200, 40))])
    assert [(r.verdict, r.kind, sorted(r.native_ids)) for r in v] == [("match", "line", ["n0", "n1"])]
    v = verdicts(spark, [("FY2022 revenue 647", box)], [("FY2022 revenue 641", box)], recovery="zoom-retry-v1")
    assert all(r.verdict == "match" for r in v)


def test_lines_and_rows(spark):
    n = natives(spark, [("b", (50, 10, 60, 20)), ("a", (10, 11, 20, 21)), ("a", (10, 11, 20, 21)), ("next", (10, 40, 30, 50)), ("  ", (0, 0, 5, 5))])
    lines = sorted(Gr.native_lines(n).collect(), key=lambda r: r.line)
    assert [(r.text, len(r.source_ids)) for r in lines] == [("a b", 3), ("next", 1)]
    rows = sorted(Gr.spatial_rows(reads(spark, [("low", (0, 90, 10, 100)), ("top", (0, 10, 10, 20))])).collect(), key=lambda r: r.row)
    assert [r.text for r in rows] == ["top", "low"] and rows[0].confidence == 0.9


def test_scale_invariance(spark):
    rng = random.Random(4)
    boxes = [(f"w{i}", (x, y, x + 30, y + 10)) for i, (x, y) in enumerate((rng.randrange(400), rng.randrange(300)) for _ in range(60))]
    double = [(t, tuple(2 * v for v in b)) for t, b in boxes]
    one = sorted(r.text for r in Gr.native_lines(natives(spark, boxes), scale=1.6).collect())
    two = sorted(r.text for r in Gr.native_lines(natives(spark, double), scale=3.2).collect())
    assert one == two


def test_relations(spark):
    read = [("FY2020", (100, 200, 140, 215)), ("FY2021", (200, 200, 240, 215)), ("FY2022", (300, 200, 340, 215)), ("448", (105, 150, 135, 165)), ("527", (205, 150, 235, 165)), ("647", (305, 150, 335, 165))]
    got = sorted((r.category, r.value) for r in Gr.year_value_relations(reads(spark, read)).collect())
    assert got == [("FY2020", "448"), ("FY2021", "527"), ("FY2022", "647")]
    assert Gr.year_value_relations(reads(spark, read[:2] + read[3:])).count() == 0


def test_fragments(spark):
    rows = [("27", (0, 0, 10, 10)), (",", (11, 0, 12, 10)), ("148,453", (13, 0, 50, 10)), ("147", (0, 30, 20, 40)), (",366,013", (21, 30, 60, 40)), ("word", (61, 30, 80, 40))]
    merged = Gr.coalesce_fragments(natives(spark, rows))
    got = [r.text for r in sorted(merged.collect(), key=lambda r: r.nth)]
    assert got == ["27,148,453", "147,366,013", "word"]
    assert sorted(r.token for r in E.token_counts(merged, ["page_id"]).collect()) == ["147366013", "27148453"]
    # a sign and a currency leave the value open; a wide gap, a step down or a closed end do not join
    more = [("$", (0, 0, 5, 10)), ("5", (6, 0, 10, 10)), ("(", (30, 0, 33, 10)), ("7", (34, 0, 38, 10)), (")", (39, 0, 41, 10)), ("1", (60, 0, 64, 10)), ("2", (65, 0, 69, 10)), ("-", (90, 0, 92, 10)), ("3", (98, 0, 99, 10)), ("4,", (120, 0, 125, 10)), ("5", (126, 6, 130, 16))]
    assert [r.text for r in sorted(Gr.coalesce_fragments(natives(spark, more)).collect(), key=lambda r: r.nth)] == ["$5", "(7)", "1", "2", "-", "3", "4,", "5"]


def test_corroboration_consumes(spark):
    claims = reads(spark, [("Total 5", (0, 0, 1, 1)), ("Total 5", (0, 0, 1, 1)), ("5 and 9", (0, 0, 1, 1)), ("9", (0, 0, 1, 1)), ("Grand", (0, 0, 1, 1)), ("grand", (0, 0, 1, 1)), ("x", (0, 0, 1, 1))])
    pool = reads(spark, [("5", (0, 0, 1, 1)), ("9", (0, 0, 1, 1)), ("the grand hall x", (0, 0, 1, 1))])
    got = {r.id: r.corroborated for r in C.corroborated(claims, pool).collect()}
    assert got == {"o0": True, "o1": False, "o2": False, "o3": True, "o4": True, "o5": False, "o6": False}


def test_starved_page_and_second_reading(spark):
    o = reads(spark, [(f"item {i}00", (10, 10 + 40 * i, 200, 40 + 40 * i)) for i in range(9)], confidence=0.95)
    n = natives(spark, [("unrelated", (300, 300, 380, 320))])
    counts = n.groupBy("page_id").agg(F.count("*").alias("native_count"))
    v = A.associate(n, o)
    d = D.page_diagnostics(o, v, counts).first()
    assert [r.type for r in d.reasons] == ["uncorroborated-ocr"] and d.reasons[0].severity == "blocking" and d.reasons[0]["count"] == 9
    again = D.page_diagnostics(o, v, counts, engaged=C.engaged_by_second_reading(o, o)).first()
    assert list(again.reasons) == [] and not again.escalates


def test_alignment_and_glyphs(spark):
    assert Gl.align("wkh", "the") == ["t", "h", "e"] and Gl.align("abc", "abc") == ["a", "b", "c"] and Gl.align("", "x") == []
    assert Gl.align("ab", "zzzzzzabzzzzzz") == ["a", "b"]
    words = "the people over there see other green trees before evening"
    swapped = words.translate(str.maketrans("eo", "oe"))
    n = natives(spark, [(swapped, (10, 10 + 40 * i, 500, 40 + 40 * i)) for i in range(6)])
    o = reads(spark, [(words, (10, 10 + 40 * i, 500, 40 + 40 * i)) for i in range(6)])
    audit = Gl.font_audit(Gl.letter_pairs(n, o)).first()
    assert audit.withhold and {(x.letter, x.read) for x in audit.letters} == {("e", "o"), ("o", "e")}
    assert Gl.contradicted_observations(Gl.letter_pairs(n, o)).count() == 6
    assert Gl.font_audit(Gl.letter_pairs(natives(spark, [(words, (10, 10, 500, 40))]), reads(spark, [(words, (10, 10, 500, 40))]))).count() == 0


def raster(w, h, marks):
    a = np.full((h, w, 4), 255, np.uint8)
    for x0, y0, x1, y1, shade in marks:
        a[y0:y1, x0:x1, :3] = shade
    return a.tobytes()


def test_unread_ink(spark):
    data = raster(400, 400, [(50, 50, 200, 150, 0), (300, 300, 310, 310, 0)])
    df = spark.createDataFrame([(1, 400, 400, data), (2, 400, 400, raster(400, 400, []))], "page_id long, width int, height int, data binary")
    none = reads(spark, [("x", (390, 0, 395, 5))])
    got = Ink.find_unread_ink(df, none).collect()
    assert [(r.page_id, r.kind) for r in got] == [(1, "structured")] and got[0].x0 <= 50 and got[0].x1 >= 200
    read = reads(spark, [("x", (40, 40, 210, 160))])
    assert Ink.find_unread_ink(df, read).count() == 0
    gray = spark.createDataFrame([(1, 400, 400, raster(400, 400, [(50, 50, 200, 150, 128)]))], "page_id long, width int, height int, data binary")
    assert Ink.find_unread_ink(gray, none).first().kind == "pictorial"
    regions = Ink.find_unread_ink(df, none)
    left = Ink.residue(regions, reads(spark, [("found", (60, 60, 100, 80))], recovery="zoom-retry-v1")).collect()
    assert [r.unread for r in left] == [False]
    assert [r.unread for r in Ink.residue(regions, none).collect()] == [True] and Ink.tiles(regions).count() >= 1


def test_receipts_confirm_once(spark):
    regions = spark.createDataFrame([(1, 0, 0.0, 0.0, 200.0, 100.0, "structured"), (1, 1, 300.0, 0.0, 400.0, 100.0, "structured")], "page_id long, region int, x0 double, y0 double, x1 double, y1 double, kind string")
    known = natives(spark, [("Net sales 42", (10, 10, 100, 30))])
    receipts = spark.createDataFrame(
        [(1, 0, 0, "a", "Net sales 42", 12.0, 10.0, 98.0, 30.0), (1, 0, 1, "b", "Net sales 42", 12.0, 10.0, 98.0, 30.0), (1, 1, 2, "c", "Net sales 42", 12.0, 10.0, 98.0, 30.0), (1, 0, 3, "d", "Net sales 43", 12.0, 10.0, 98.0, 30.0), (1, 0, 4, "e", "Net sales 42", 5.0, 5.0, 5.0, 5.0)],
        "page_id long, region int, ord int, id string, text string, x0 double, y0 double, x1 double, y1 double",
    )
    assert [(r.region, r.id, r.known) for r in Ink.confirmed_counts(regions, receipts, known).collect()] == [(0, "a", "n0")]
    again = A.duplicate_evidence(receipts.where("id in ('a', 'd')"), known).collect()
    assert [(r.id, r.duplicate_of) for r in again] == [("a", 0)]


def test_markdown_defects(spark):
    lines = Gr.native_lines(natives(spark, [("alpha 1,200 30", (0, 0, 100, 10)), ("beta 4,500 60", (0, 40, 100, 50))]))
    md = spark.createDataFrame([(1, "| name | a | b |\n| --- | --- | --- |\n| alpha | 1,200 | 60 |")], "page_id long, markdown string")
    bad = P.markdown_defects(md, lines).first()
    assert bad.misbound_rows == 1 and bad.defective
    ok = spark.createDataFrame([(1, "| alpha | 1,200 | 30 |\n| beta | 4,500 | 60 |")], "page_id long, markdown string")
    assert not P.markdown_defects(ok, lines).first().defective


def test_validation_catches_tampering(spark):
    n, o = natives(spark, [("a 5", (0, 0, 10, 10))]), reads(spark, [("a 5", (0, 0, 10, 10))])
    v = A.associate(n, o)
    d = D.page_diagnostics(o, v, n.groupBy("page_id").agg(F.count("*").alias("native_count")))
    assert V.page_violations(n, o, v, d).count() == 0
    V.assert_valid(V.page_violations(n, o, v, d))
    forged = d.withColumn("match_count", F.lit(7).cast("long"))
    assert [r.path for r in V.page_violations(n, o, v, forged).collect()] == ["diagnostics.match_count"]
    assert V.page_violations(n, o.withColumn("x1", F.lit(-1.0)), v).count() >= 1
    assert V.page_violations(n, o.withColumn("id", F.lit("other")), v).count() >= 1
    with pytest.raises(ValueError):
        V.assert_valid(V.page_violations(n, o, v, forged))


def test_enrichment(spark):
    conflicts = spark.createDataFrame([(1, f"c{i}") for i in range(6)], "page_id long, conflict_id string")
    answers = '```json\n[{"index":0,"verdict":"native"},{"index":1,"verdict":"ocr"},{"index":1,"verdict":"native"},{"index":9,"verdict":"ocr"},{"index":2,"verdict":"both-wrong","inkText":" 42 "},{"index":3,"verdict":"neither"},{"index":4,"verdict":"native"},{"index":4,"verdict":"odd"},{"index":0.5,"verdict":"ocr"}]\n```'
    got = {r.conflict_id: (r.verdict, r.unanswered, r.ink_text) for r in En.parse_rulings(spark.createDataFrame([(1, answers)], "page_id long, answers string"), conflicts).collect()}
    # repeated answers, unknown verdicts and omissions never pick a side
    assert got == {"c0": ("native", False, None), "c1": ("unsure", True, None), "c2": ("both-wrong", False, "42"), "c3": ("unsure", True, None), "c4": ("unsure", True, None), "c5": ("unsure", True, None)}
    payload = spark.createDataFrame([(1, '{"tokens":[{"text":" a ","box_2d":[0,0,10,10]},{"text":""},{"text":"b","box_2d":[5,5,1]},{"text":"c","box":[1,2,3,4]}]}')], "page_id long, payload string")
    tokens = sorted(En.parse_tokens(payload).collect(), key=lambda r: r.ord)
    assert [(t.text, t.box) for t in tokens] == [("a", [0.0, 0.0, 10.0, 10.0]), ("b", None), ("c", None)]
    plan = spark.createDataFrame([(1, p, n) for p, n in ((1, 10), (2, 10), (3, 10), (4, 30), (5, 1))], "job_id long, page_id long, entries int")
    assert [r.chunk for r in sorted(En.chunk_requests(plan).collect(), key=lambda r: r.page_id)] == [0, 0, 1, 2, 3]
    kind = "page_id long, reasons array<struct<type:string,severity:string>>"
    pages = spark.createDataFrame([(1, [("uncorroborated-ocr", "blocking"), ("unread-ink-region", "blocking")]), (2, [("unread-ink-region", "blocking")]), (3, [("unread-ink-region", "blocking"), ("critical-token-omission", "blocking")]), (4, [("low-ocr-confidence", "advisory")])], kind)
    crops = spark.createDataFrame([(1,), (2,)], "page_id long")
    asked = {r.page_id: tuple(r)[1:] for r in En.request_plan(pages, spark.createDataFrame([(3,)], "page_id long"), crops).collect()}
    # a whole page holds its regions, so crops are never asked for beside it
    assert asked == {1: (False, True, False, False), 2: (False, False, True, False), 3: (True, False, False, True)}


def test_conflict_boxes_fail_closed(spark):
    ocr = reads(spark, [("x", (10, 20, 110, 40))])
    geometry = spark.createDataFrame([(1, 200.0, 400.0)], "page_id long, width double, height double")
    c = lambda i: spark.createDataFrame([(1, i)], "page_id long, ocr_id string")
    assert En.conflict_boxes(c("o0"), ocr, geometry).first().normalized_box == [50, 50, 100, 550]
    with pytest.raises(Exception, match="unknown reading"):
        En.conflict_boxes(c("o7"), ocr, geometry).collect()


def test_evaluation_tokens(spark):
    rows = [("Net (1,234) and $5.5% or −42 up 3PPT", ["-1234", "$5.5%", "-42", "3ppt"]), ("€(12) 7x 1.2.3", ["€(12)", "7x", "1.2.3"]), ("(5", ["(5"]), (None, []), ("12\u212a", ["12k"]), ("$ 5", ["5"])]
    df = spark.createDataFrame(rows, "t string, want array<string>").select("want", T.evaluation_tokens(F.col("t")).alias("got"))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


def test_detached_currency(spark):
    """A detached sign is forgiven, a contradicting one never; percent and sign are never relaxed."""
    cases = [("$100", "100", 1), ("100", "€100", 1), ("$100", "€100", 0), ("28.9%", "28.9", 0), ("-150,672", "150,672", 0), ("$100", "$100", 1), ("$684,663", "684,663", 1)]
    for gold, found, want in cases:
        g, f = reads(spark, [(gold, (0, 0, 1, 1))]), reads(spark, [(found, (0, 0, 1, 1))])
        assert C.consume_matches(g, f, tolerant=True).first().matched == want, (gold, found)
    assert C.consume_matches(reads(spark, [("$100", (0, 0, 1, 1))]), reads(spark, [("100", (0, 0, 1, 1))])).first().matched == 0


def test_gold_recall_strict_before_tolerant(spark):
    gold = reads(spark, [("$5", (0, 0, 1, 1)), ("5", (0, 0, 1, 1)), ("9", (0, 0, 1, 1))]).withColumn("tier", F.when(F.col("ord") < 2, "human").otherwise("silver"))
    got = {r.tier: tuple(r)[2:] for r in C.gold_recall(gold, reads(spark, [("5", (0, 0, 1, 1))]), reads(spark, [("$5 9 5", (0, 0, 1, 1))])).collect()}
    # tokens, strict native, ocr, union, then with detached signs forgiven
    assert got == {"human": (2, 1, 2, 2, 1, 2, 2), "silver": (1, 0, 1, 1, 0, 1, 1)}


def test_located_corroboration(spark):
    native = natives(spark, [("5 9", (0, 0, 50, 10)), ("5", (100, 0, 150, 10))])
    claims = reads(spark, [("5", (90, 0, 120, 10)), ("5", (200, 0, 210, 10)), ("5 9", (0, 0, 20, 10)), ("9", (0, 0, 20, 10)), ("word", (0, 0, 20, 10))])
    assert {r.id: r.corroborated for r in C.located_corroboration(claims, native).collect()} == {"o0": True, "o1": False, "o2": True, "o3": False, "o4": False}


def test_cross_family_bounds(spark):
    ocr = reads(spark, [("7 8", (0, 0, 1, 1)), ("7", (0, 0, 1, 1)), ("Total", (0, 0, 1, 1)), ("3", (0, 0, 1, 1))])
    second = reads(spark, [("7 8", (0, 0, 1, 1)), ("total 7", (0, 0, 1, 1))])
    r = C.cross_family_bounds(ocr, second, reads(spark, [("7", (0, 0, 1, 1))]), spark.createDataFrame([(1,)], "page_id long")).first()
    assert (r.pages, r.observations, r.agreed, r.confirmed, r.plain, r.lower_bound, r.upper_bound) == (1, 2, 3, 1, 1, 0.3333, 1.0)
    p = C.pool_recall(reads(spark, [("7", (0, 0, 1, 1)), ("11", (0, 0, 1, 1))]), ocr).first()
    assert (p.tokens, p.found) == (2, 1)


def test_page_geometry(spark):
    one = spark.range(1)
    m = F.array(*map(F.lit, (2.0, 0.0, 0.0, -2.0, 0.0, 200.0)))
    none = F.lit(None).cast("array<double>")
    bounds = F.array(*map(F.lit, (0.0, 0.0, 50.0, 100.0)))
    r = one.select(
        G.pixels_per_point(m, F.lit(100.0), bounds, F.lit(90)).alias("by_matrix"), G.pixels_per_point(none, F.lit(100.0), bounds, F.lit(180)).alias("upright"),
        G.pixels_per_point(none, F.lit(100.0), bounds, F.lit(270)).alias("turned"), G.pixels_per_point(none, F.lit(100.0), none, F.lit(0)).alias("bare"),
        G.fits_page(m, bounds, F.lit(100.0), F.lit(201.0)).alias("fits"), G.fits_page(m, bounds, F.lit(120.0), F.lit(200.0)).alias("off"),
        F.array(*G.crop_window((F.lit(1.0), F.lit(160.0), F.lit(81.0), F.lit(240.0)), F.lit(1.6), 144.0, 8.0)).alias("crop"),
        F.array(*G.to_normalized((F.lit(-10.0), F.lit(0.0), F.lit(110.0), F.lit(200.0)), F.lit(100.0), F.lit(200.0))).alias("norm"),
        F.array(*G.reading_key((F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(37.0)))).alias("key"), T.xml_escape(F.lit("a'b<\x01")).alias("xml"),
    ).first()
    assert (r.by_matrix, r.upright, r.turned, r.bare, r.fits, r.off) == (2.0, 2.0, 1.0, 1.6, True, False)
    assert r.crop == [0, 184, 132, 132] and r.norm == [0, -100, 1000, 1100] and r.key == [2.0, 5.0] and r.xml == "a'b&lt;\\x01"


def test_trusted_text(spark):
    n = natives(spark, [("Revenue $1,200", (0, 0, 90, 10)), ("Cost 30", (0, 20, 90, 30)), ("Tax 7", (0, 40, 90, 50))])
    o = reads(spark, [("Revenue $1,300", (0, 0, 90, 10)), ("Cost 31", (0, 20, 90, 30)), ("tax 7", (0, 40, 90, 50)), ("faint", (0, 60, 90, 70)), ("  ", (0, 80, 9, 90))]).withColumn("confidence", F.when(F.col("ord") == 3, 0.2).otherwise(0.9))
    v = spark.createDataFrame([(1, "o0", "critical-token-disagreement", ["n0"]), (1, "o1", "critical-token-disagreement", ["n1"])], "page_id long, ocr_id string, verdict string, native_ids array<string>")
    rulings = spark.createDataFrame([(1, "o0", "ocr", "Revenue $1,300")], "page_id long, ocr_id string, verdict string, ink_text string")
    proposals = spark.createDataFrame([(1, 0, "p0", "Note 5")], "page_id long, ord int, id string, text string")
    from folioscope.operators import retrieval as Rt

    texts = lambda df: sorted((r.source, r.text.strip()) for r in df.collect())
    # nobody ruled on the second dispute, so both of its sides go; "tax 7" is embedded, "faint" under the floor
    assert texts(Rt.trusted_text(n, o, v, rulings)) == [("native", "Tax 7"), ("ocr", ""), ("ocr", "Revenue $1,300")]
    assert texts(Rt.trusted_text(n, o, v, rulings, proposals)) == [("ink", "Revenue $1,300"), ("native", "Tax 7"), ("ocr", ""), ("ocr", "Revenue $1,300"), ("proposal", "Note 5")]
    assert texts(Rt.deduplicated_text(n, o))[3:] == [("ocr", ""), ("ocr", "Cost 31"), ("ocr", "Revenue $1,300"), ("ocr", "faint")]


def test_answers(spark):
    rows = [("costs $684,663 in all", "$684,663", True), ("1,684,663", "684,663", False), ("€100", "$100", False), ("100", "$100", True), ("100.5", "100", False), ("x中100中", "100", True), ("A100", "100", False), ("any", "$", True)]
    got = [spark.createDataFrame([(t,)], "t string").select(T.holds_answer(F.col("t"), a).alias("x")).first().x for t, a, _ in rows]
    assert got == [w for *_, w in rows]


def test_intervals(spark):
    a = spark.createDataFrame([("k", 0, 10), ("k", 5, 15), ("k", 20, 30)], "k string, start long, stop long")
    b = spark.createDataFrame([("k", 8, 9), ("k", 14, 22)], "k string, start long, stop long")
    assert sorted((r.start, r.stop) for r in I.subtract(a, b, ["k"]).collect()) == [(0, 8), (9, 14), (22, 30)]
    assert sorted((r.start, r.stop) for r in I.intersections(a, b, ["k"], width=7).collect()) == [(8, 9), (8, 9), (14, 15), (20, 22)]
    children = spark.createDataFrame([("k", 1, 2, 3), ("k", 2, 40, 41)], "k string, child_id long, start long, stop long")
    parents = spark.createDataFrame([("k", 10, 0, 50), ("k", 11, 1, 5), ("k", 12, 60, 70)], "k string, parent_id long, start long, stop long")
    assert {r.child_id: r.parent_id for r in I.smallest_container(children, parents, ["k"], width=8).collect()} == {1: 11, 2: 10}


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(100)], "id long, g string")
    quotas = E.largest_remainder(df.groupBy("g").agg(F.count("*").alias("size")), 10)
    assert {r.g: r.quota for r in quotas.collect()} == {"a": 7, "b": 3}
    assert E.quota_sample(df, quotas, "g", "id", "seed").count() == 10


def test_stale_and_resume(spark):
    pages = spark.createDataFrame([(1, "d1"), (2, "d2")], "page_id long, digest string")
    res = spark.createDataFrame([(1, "d1"), (2, "old"), (3, "x")], "page_id long, base_digest string")
    fresh, stale = S.stale_results(res, pages)
    assert [r.page_id for r in fresh.collect()] == [1] and sorted(r.page_id for r in stale.collect()) == [2, 3]
    assert S.resume(pages, res, ["page_id"]).count() == 0


def test_nfkc(spark):
    got = spark.createDataFrame([("ﬁ½ ",), (None,)], "t string").select(T.nfkc(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [unicodedata.normalize("NFKC", "ﬁ½ "), None]


def test_fold_over_a_union_of_partitioned_sides(spark):
    """Both sides are already partitioned by page; their rows must still meet."""
    from folioscope.operators.pages import fold_pages

    pages = spark.range(40).select(F.col("id").alias("page_id"))
    side = lambda n: spark.range(400).select((F.col("id") % 40).alias("page_id"), F.lit(n).alias("side")).join(pages.distinct(), "page_id", "left_semi")
    got = fold_pages(side(0).unionByName(side(1)), ["page_id"], ["side"], lambda rows: [(rows[0]["page_id"], len(rows))], "page_id long, n int").collect()
    assert sorted((r.page_id, r.n) for r in got) == [(i, 20) for i in range(40)]
