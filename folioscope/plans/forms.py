"""Queries that put single functions and small joins through the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import ids as Ids
from folioscope.functions import numbers as N
from folioscope.functions import text as T
from folioscope.operators import associate as A
from folioscope.operators import compare as Cm
from folioscope.operators import corroborate as C
from folioscope.operators import enrich as En
from folioscope.operators import evaluate as E
from folioscope.operators import intervals as I
from folioscope.operators import retrieval as Rt
from folioscope.operators import runs as R
from folioscope.operators import second_pass as Sp
from folioscope.sources import ledger as L


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Texts for the functions, chosen by part number: markup, currencies, numbers that go on, scripts, tables, odd characters.
TEXTS = ("a < b & \"c\" 'd'", "$1,200 and €5", "1,684,663 A100", "x 684,663 y", "  ", "Ⅳ or ½", "漢字 text", "привет", "bad  mark", "| a | b |\n| --- | :-: |\n| 1 < 2 | 3 |", "plain words here here")
ANSWER = "684,663"


def text_forms(spark, d):
    """Escapes, currency, guards, scripts, odd characters, tables and bags of a text for each part."""
    s = F.concat(F.element_at(F.array(*[F.lit(x) for x in TEXTS]), (F.col("p_partkey") % len(TEXTS) + 1).cast("int")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.lit("")))
    df = _t(spark, d, "part").select("p_partkey", s.alias("s"))
    c = F.col("s")
    return df.select(
        "p_partkey", T.xml_escape(c).alias("xml"), T.strip_currency(c).alias("bare"), T.currency_compatible(c, F.lit("$9")).alias("dollars_fit"), T.answer_form(c).alias("answer"), F.array_join(T.answer_parts(c), "|").alias("parts"),
        T.guarded_contains(F.lower(c), ANSWER).alias("holds"), T.text_key(c).alias("key"), T.is_blank(c).alias("blank"), T.is_numeric(c).alias("is_numeric"), T.is_suspicious(c).alias("suspicious"), T.script_of(F.substring(F.trim(c), 1, 1)).alias("script"),
        F.size(T.word_bag(c)).cast("long").alias("words"), T.token_contained(c, F.lit("$1,2")).alias("strict"), T.token_contained(c, F.lit("€1,2"), without_currency=True).alias("loose"),
        F.array_join(F.transform(T.table_rows(c), lambda r: F.array_join(r, "/")), ";").alias("cells"), T.html_tables(c).alias("html"),
    )


def token_forms(spark, d):
    """Encoded tokens taken apart and compared, exactly, as multisets and with optional tails."""
    tails = ("", "|m", "|mm", "|m")
    enc = lambda k: F.concat((k % 3).cast("string"), F.element_at(F.array(*[F.lit(x) for x in tails]), (F.floor(k / 3) % 4 + 1).cast("int")))
    df = _t(spark, d, "part").select("p_partkey", enc(F.col("p_partkey")).alias("a"), enc(F.floor(F.col("p_partkey") / 12)).alias("b"), enc(F.col("p_size")).alias("c"))
    t = lambda n: T.split_token(F.col(n))
    return df.select("p_partkey", t("a")["core"].alias("core"), t("a")["tail"].alias("tail"), T.token_text(t("a")).alias("whole"), T.tokens_compatible(t("a"), t("b")).alias("fits"), T.same_multiset(F.array("a", "b", "c"), F.array("c", "a", "b")).alias("rotated"), T.same_multiset(F.array("a", "b"), F.array("a", "c")).alias("equal_sets"), T.tokens_agree(F.array(t("a"), t("b")), F.array(t("b"), t("c"))).alias("agree"))


def geometry_forms(spark, d):
    """Boxes of line items through every box function."""
    q, k = F.col("q"), F.col("l_linenumber").cast("double")
    one = _t(spark, d, "lineitem").withColumnRenamed("l_quantity", "q").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "q", (q * 3 + 0.125).alias("x0"), (k * 20).alias("y0"), (q * 3 + k * 10).alias("x1"), (k * 20 + q / 2).alias("y1"))
    b, m = G.box(), F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(-2.0), F.lit(0.0), F.lit(400.0))
    o = (F.lit(30.0), F.lit(30.0), F.lit(90.0), F.lit(70.0))
    poly = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))])
    bounds = G.point_bounds(F.when(F.col("l_suppkey") % 3 == 0, F.array(*map(F.lit, (0.0, 0.0, 150.0, 200.0)))), F.when(F.col("l_suppkey") % 2 == 0, 75.0), F.lit(100.0))
    own = F.when(F.col("l_partkey") % 2 == 0, m)
    r6 = lambda c: F.round(c, 6)
    merged = G.merge_geometry({"width": F.lit(1.0), "rotation": F.lit(90)}, {"width": F.col("q"), "height": F.lit(2.0), "rotation": F.when(F.col("l_partkey") % 2 == 0, 180)})
    key = G.reading_key(b)
    env = G.box_of_polygon(poly)
    tx, ty = G.transform_point(b[0], b[1], m)
    rb, cr, nz, fc = G.render_box(b, m), G.crop_window(b, F.lit(1.6), 144.0), G.to_normalized(b, F.lit(200.0), F.lit(200.0)), G.from_crop(b, (F.lit(5.0), F.lit(7.0)), F.lit(4.0))
    return one.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", r6(b[0]).alias("x"), G.round_half_up(b[0]).alias("r2"), G.is_valid(b).alias("valid"), G.is_within(b, F.lit(150.0), F.lit(150.0)).alias("inside"), r6(G.area(b)).alias("size"), r6(G.centre_distance(b, o)).alias("far"),
        r6(tx).alias("tx"), r6(ty).alias("ty"), r6(rb[1]).alias("render_y0"), r6(rb[2]).alias("render_x1"), cr[0].alias("crop_x"), cr[3].alias("crop_h"), nz[0].alias("ymin"), nz[3].alias("xmax"), r6(fc[0]).alias("back_x"), r6(fc[3]).alias("back_y"),
        bounds[2].alias("bound"), r6(G.pixels_per_point(own, F.lit(300.0), bounds, F.col("l_linenumber") * 90)).alias("ppp"), G.fits_page(own, bounds, F.lit(300.0), F.lit(400.0)).alias("fits"), r6(G.polygon_area(poly)).alias("poly"), G.polygon_fits(poly, b).alias("poly_fits"), r6(env[2]).alias("env_x1"),
        G.box_key(b).alias("key"), key[0].cast("long").alias("row"), r6(key[1]).alias("col"), r6(G.luminance(q, q * 2, q * 3)).alias("light"), merged["rotation"].alias("rotation"), r6(merged["width"]).alias("merged_width"),
    )


def id_forms(spark, d):
    """Hashes, ids and digests of parts."""
    name = F.col("p_name")
    js = F.concat(F.lit('{"b": '), F.col("p_size").cast("string"), F.lit('.0, "a": [null, "'), F.col("p_brand"), F.lit('"]}'))
    sha = F.sha2(name, 256)
    return _t(spark, d, "part").select("p_partkey", Ids.fnv1a(name).alias("hash"), Ids.page_id(sha, F.col("p_size")).alias("page"), Ids.derived_id(F.lit("ps:x"), "relation", F.array("p_type", "p_brand")).alias("derived"), Ids.canonical_json(js).alias("canonical"), Ids.record_digest(js).alias("digest"), Ids.text_digest(name).alias("sha"))


def number_forms(spark, d):
    """Clamped, rated and priced numbers of line items."""
    li = _t(spark, d, "lineitem")
    share = F.col("l_discount") * 15 - 0.2
    return li.groupBy("l_suppkey").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))), 6).alias("clamped"), F.sum(F.round(En.token_cost(F.col("l_partkey"), F.col("l_orderkey"), 3.0, 25.0) * 1000000).cast("long")).alias("cost"), F.round(F.max(En.arm_cost(F.col("l_extendedprice"), 1.8, F.col("l_linenumber") - 3)), 6).alias("arm"), N.rate(F.count_if(F.col("l_linenumber") > 90), F.count_if(F.col("l_linenumber") > 99)).alias("never"))


def _lines(spark, d):
    """Ledger readings with two boxes for joins: the mixed pages' items and readings."""
    rows = L.lines(spark, d)
    return L.mixed_native(rows), L.mixed_ocr(rows)


def region_owner(spark, d):
    """Each reading with the band of forty pixels that it overlaps most."""
    _, ocr = _lines(spark, d)
    regions = ocr.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region")).select("page_id", "region", F.lit(0.0).alias("x0"), (F.col("region") * 40.0).alias("y0"), F.lit(400.0).alias("x1"), (F.col("region") * 40.0 + 40).alias("y1"))
    return A.attribute_to_regions(ocr, regions).select("page_id", "id", F.col("region").cast("long").alias("region"), F.round("shared", 6).alias("shared"))


def reading_coverage(spark, d):
    """How much of each embedded item the readings cover."""
    native, ocr = _lines(spark, d)
    return A.coverage(native, ocr).select("page_id", "id", F.round("covered", 6).alias("covered"))


def repeated_recoveries(spark, d):
    """Recovered readings that repeat a first-pass one of the same page."""
    _, ocr = _lines(spark, d)
    moved = ocr.where("recovery_method is not null").withColumns({"x0": F.col("x0") + 2, "x1": F.col("x1") + 2, "y0": F.col("y0") - 12, "y1": F.col("y1") - 12})
    return A.duplicate_evidence(moved, ocr.where("recovery_method is null")).select("page_id", "id", F.col("duplicate_of").cast("long").alias("duplicate_of"))


def best_overlaps(spark, d):
    """For each item the reading of the same text that overlaps it best, and pairs in which each is used once."""
    native, ocr = _lines(spark, d)
    return E.best_iou(native, ocr).select("page_id", "id", "other", F.round("iou", 6).alias("iou"))


def greedy_pairs(spark, d):
    """Items and readings of equal text paired from the best overlap down."""
    native, ocr = _lines(spark, d)
    o = ocr.select("page_id", "text", F.col("ord").alias("right"), *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = native.withColumn("left", F.col("ord")).join(o, ["page_id", "text"])
    return C.greedy_pairs(pairs, F.round(G.iou(G.box(), G.box("r_")), 6)).groupBy("page_id").agg(F.count("*").alias("pairs"), F.round(F.sum("score"), 6).alias("score"))


def unique_texts(spark, d):
    """Items whose text is alone on its page, with the box of the reading whose text is alone there."""
    native, ocr = _lines(spark, d)
    return A.unique_key_join(native.select("page_id", "id", "text"), ocr.select("page_id", "text", F.col("x0").alias("read_x0")), "text")


def overlays(spark, d):
    """Pages on which two items coincide: every fifth page prints its lines twice."""
    native, _ = _lines(spark, d)
    twice = native.unionByName(native.where("page_id % 5 = 0 and ord % 4 = 0"))
    return Sp.coincident_overlays(twice)


def gold_join(spark, d):
    """Gold, proposals and records of the same pages and bytes."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"), "o_orderstatus", "o_totalprice")
    return Sp.gold_pages(o.drop("o_totalprice", "o_orderstatus"), o.drop("o_totalprice"), o.drop("o_orderstatus"), ["page"])


def text_differences(spark, d):
    """Documents against themselves with every third line changed and the last one gone: lines by position."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    other = F.array_join(F.slice(F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("!"))).otherwise(x)), F.lit(1), F.greatest(F.lit(1), F.size(lines) - 1)), "\n")
    return E.positional_difference(docs, docs.withColumn("text", other), ["doc_id"])


def run_presence(spark, d):
    """Orders of two runs: what one lacks, and what differs."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("digest"))
    other = o.where("page % 7 <> 0").withColumn("digest", F.when(F.col("page") % 5 == 0, "x").otherwise(F.col("digest")))
    return E.page_presence(o.where("page % 11 <> 0"), other, ["page"], "digest").groupBy("state").agg(F.count("*").alias("pages"))


def containers(spark, d):
    """Each event of a user within the smallest span of the same user's that holds it; what of the spans no event covers."""
    from folioscope.plans.relational import _spans

    s = _spans(spark, d)
    parents = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("parent_id"), "start", (F.col("stop") + 3_600_000).alias("stop"))
    children = s.where("event_type = 'click'").select("user_id", F.col("event_id").alias("child_id"), "start", "stop")
    return I.smallest_container(children, parents, ["user_id"], width=3_600_000).select("user_id", "child_id", "parent_id")


def subtracted(spark, d):
    """Time of a user's views that no click covers."""
    from folioscope.plans.relational import _spans

    s = _spans(spark, d)
    wide = s.where("event_type = 'view'").withColumn("stop", F.col("stop") + 3_600_000)
    return I.subtract(wide, s.where("event_type = 'click'"), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("pieces"), F.sum(F.expr("stop - start")).alias("left_over"))


def stage_shares(spark, d):
    """Occupied time of the event types of a user within the user's spans of any type."""
    from folioscope.plans.relational import _spans

    s = _spans(spark, d).select(F.col("user_id").alias("role"), F.col("event_type").alias("stage"), "start", "stop")
    return Cm.stage_occupancy(s, s, width=3_600_000).select("role", "stage", "calls", "service", "occupied", "exclusive", "share")


def arm_gate(spark, d):
    """Differences between two arms, put together from line items, and whether the candidate passes."""
    li = _t(spark, d, "lineitem")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("correct", "incorrect", "missing", "unsure", "pending")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    diff = li.select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_suppkey") % 2 == 0, "candidate").otherwise("control").alias("side"), verdict.alias("verdict"), (F.col("l_linenumber") % 2 == 0).alias("caught"))
    pages = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 3 == 0).alias("candidate_trusted"), (F.col("o_orderkey") % 19 != 0).alias("deterministic_same"), (F.col("o_orderkey") % 23 == 0).cast("long").alias("cleared_blocking"))
    return Cm.gate_verdict(diff, pages)


def arm_strata(spark, d):
    """Values that only one arm has, by order priority."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_suppkey") % 2 == 0, "candidate").otherwise("control").alias("side"))
    return Cm.arm_strata(li, _t(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), "o_orderpriority"), ["o_orderpriority"])


def repeat_medians(spark, d):
    """Median, least and greatest price of the completed repeats of a supplier."""
    li = _t(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"), F.col("l_extendedprice").alias("ms"))
    return Cm.repeat_summary(li, ["l_suppkey"], ["ms"])


def box_origins(spark, d):
    """Tokens by where their box comes from."""
    o = _t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "model").when(F.col("o_orderstatus") == "F", "ocr").alias("box_source"))
    return R.box_provenance(o)


def stage_dominance(spark, d):
    """Share of each event type in the whole of a user, and what follows from it."""
    e = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("covered"))
    total = e.groupBy("user_id").agg(F.sum("covered").alias("total"))
    return R.stage_decision(e.join(total, "user_id"), "total").groupBy("decision").agg(F.count("*").alias("stages"))


def label_pages(spark, d):
    """Documents by label, and pages drawn for a second label by class."""
    pages = _t(spark, d, "documents").select(F.col("source").alias("objectId"), F.array("lang", F.when(F.col("doc_id") % 4 == 0, "chart").otherwise("text")).alias("labels"))
    return R.manifest_distributions(pages)


def page_classes(spark, d):
    li = _t(spark, d, "orders")
    return li.groupBy(R.page_class(F.col("o_orderkey") % 7, F.col("o_orderkey") % 2 == 0).alias("class")).agg(F.count("*").alias("pages"))


def near_words(spark, d):
    """The five embedded words of a page next to the place of its first reading."""
    native, ocr = _lines(spark, d)
    words = native.select("page_id", "ord", F.col("text").alias("word"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    target = ocr.where("ord = 0").select("page_id", F.lit(0).alias("target"), ((F.col("x0") + F.col("x1")) / 2).alias("tx"), ((F.col("y0") + F.col("y1")) / 2).alias("ty"))
    return Rt.nearest_words(words, target, limit=5).select("page_id", F.array_join("words", "|").alias("words"))


def spaced_rows(spark, d):
    """Evenly spaced line items of an order, three at most."""
    rows = L.lines(spark, d)
    return Rt.spaced_picks(rows, ["page_id"], ["ord"]).select("page_id", F.col("ord").cast("long").alias("ord"))


def ranking_duel(spark, d):
    """Queries that one ranking answers earlier than another."""
    a = _t(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("query"), (F.col("c_nationkey") % 4 + 1).alias("first_rank"))
    b = _t(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("query"), (F.col("c_custkey") % 4 + 1).alias("first_rank"))
    return Rt.pairwise_wins(a, b)


QUERIES = {f.__name__: f for f in (
    text_forms, token_forms, geometry_forms, id_forms, number_forms, region_owner, reading_coverage, repeated_recoveries, best_overlaps, greedy_pairs, unique_texts, overlays, gold_join, text_differences, run_presence, containers, subtracted,
    stage_shares, arm_gate, arm_strata, repeat_medians, box_origins, stage_dominance, label_pages, page_classes, near_words, spaced_rows, ranking_duel,
)}

_SQL_TEXTS = "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in TEXTS) + "]"
_IOU = "greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
_INTER = _IOU.format(a="n", b="o")
_UNION = f"((n.x1 - n.x0) * (n.y1 - n.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - {_INTER})"
_S = """s AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + CAST(floor(abs(value) * 1000) AS BIGINT) + 1 AS b FROM events)"""


def _union_of(source: str, keys: str, name: str) -> str:
    """Islands of a table with columns a and b."""
    return f"""{name}_f AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_g AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM {name}_f), {name} AS (SELECT {keys}, min(a) AS a, max(b) AS b FROM {name}_g GROUP BY {keys}, isle)"""


SQL = {
    "text_forms": rf"""WITH p AS (SELECT p_partkey, p_partkey % {len(TEXTS)} AS k, {_SQL_TEXTS}[p_partkey % {len(TEXTS)} + 1] || CASE WHEN p_size % 3 = 0 THEN ' ' || p_size ELSE '' END AS s, p_size % 3 = 0 AS more FROM part)
SELECT p_partkey, replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml, regexp_replace(s, '\p{{Sc}}', '', 'g') AS bare, NOT contains(s, '€') AS dollars_fit,
replace(trim(regexp_replace(lower(regexp_replace(s, '\p{{Sc}}', '', 'g')), '\s+', ' ', 'g')), ',', '') AS answer, array_to_string(list_filter(string_split_regex(lower(s), '\s+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), '|') AS parts,
k = 3 AS holds, CASE WHEN k = 5 THEN replace(replace(replace(replace(s, 'Ⅳ', 'IV'), '½', '1⁄2'), ' ', ''), chr(10), '') ELSE replace(replace(s, ' ', ''), chr(10), '') END AS key,
k = 4 AND NOT more AS blank, regexp_matches(s, '\p{{N}}') AS is_numeric, k = 8 AS suspicious, CASE WHEN k IN (0, 3, 5, 8, 10) THEN 'Latin' WHEN k = 6 THEN 'Han' WHEN k = 7 THEN 'Cyrillic' ELSE 'Other' END AS script,
len(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'))::BIGINT AS words, contains(s, '$1,2') AS strict, contains(regexp_replace(s, '\p{{Sc}}', '', 'g'), '1,2') AS loose,
CASE WHEN k = 9 THEN 'a/b;1 < 2/3' || CASE WHEN more THEN (SELECT '/' || any_value(q.p_size) FROM part q WHERE q.p_partkey = p.p_partkey) ELSE '' END ELSE '' END AS cells,
CASE WHEN k = 9 THEN '<table><tr><th>a</th><th>b</th></tr>' || chr(10) || '<tr><td>1 &lt; 2</td><td>3</td>' || CASE WHEN more THEN (SELECT '<td>' || any_value(q.p_size) || '</td>' FROM part q WHERE q.p_partkey = p.p_partkey) ELSE '' END || '</tr></table>' ELSE s END AS html FROM p""",
    "token_forms": """WITH p AS (SELECT p_partkey, (p_partkey % 3)::VARCHAR AS ac, ['', 'm', 'mm', 'm'][(p_partkey // 3) % 4 + 1] AS atl, ((p_partkey // 12) % 3)::VARCHAR AS bc, ['', 'm', 'mm', 'm'][(p_partkey // 36) % 4 + 1] AS bt, (p_size % 3)::VARCHAR AS cc, ['', 'm', 'mm', 'm'][(p_size // 3) % 4 + 1] AS ct FROM part),
e AS (SELECT *, ac || CASE WHEN atl = '' THEN '' ELSE '|' || atl END AS a, bc || CASE WHEN bt = '' THEN '' ELSE '|' || bt END AS b, cc || CASE WHEN ct = '' THEN '' ELSE '|' || ct END AS c FROM p)
SELECT p_partkey, ac AS core, nullif(atl, '') AS tail, a AS whole, ac = bc AND (atl = '' OR bt = '' OR atl = bt) AS fits, TRUE AS rotated, b = c AS equal_sets, ac = cc AND (atl = '' OR ct = '' OR atl = ct) AND (ac <> bc OR (atl = ct OR
  -- of two equal cores on either side the one that is the same on both cancels; what is left must lack a tail
  atl = '' OR ct = '')) AS agree FROM e""",
    "geometry_forms": """WITH p AS (SELECT *, l_quantity AS q, l_quantity * 3 + 0.125 AS x0, l_linenumber * 20.0::DOUBLE AS y0, l_quantity * 3 + l_linenumber * 10.0::DOUBLE AS x1, l_linenumber * 20.0::DOUBLE + l_quantity / 2 AS y1, l_partkey % 2 = 0 AS even,
  CASE WHEN l_suppkey % 3 = 0 THEN 150.0 WHEN l_suppkey % 2 = 0 THEN 75.0 END::DOUBLE AS bound, CASE WHEN l_suppkey % 3 = 0 THEN 200.0 WHEN l_suppkey % 2 = 0 THEN 100.0 END::DOUBLE AS tall FROM lineitem),
g AS (SELECT *, floor(x0 / 1.6 * 2 + 0.5) AS cx0, floor(y0 / 1.6 * 2 + 0.5) AS cy0, floor(y1 / 1.6 * 2 + 0.5) AS cy1 FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(x0, 6) AS x, floor(x0 * 100 + 0.5) / 100 AS r2, x1 > x0 AND y1 > y0 AS valid, x0 >= 0 AND y0 >= 0 AND x1 <= 150 AND y1 <= 150 AND x1 > x0 AND y1 > y0 AS inside, round(greatest(0, x1 - x0) * greatest(0, y1 - y0), 6) AS size,
round(sqrt(pow((x0 + x1) / 2 - 60, 2) + pow((y0 + y1) / 2 - 50, 2)), 6) AS far, round(2 * x0, 6) AS tx, round(400 - 2 * y0, 6) AS ty, round(400 - 2 * y1, 6) AS render_y0, round(2 * x1, 6) AS render_x1,
CAST(greatest(0, cx0 - 16) AS BIGINT) AS crop_x, CAST(cy1 - cy0 + 32 AS BIGINT) AS crop_h, CAST(floor(y0 * 5 + 0.5) AS BIGINT) AS ymin, CAST(floor(x1 / 200 * 1000 + 0.5) AS BIGINT) AS xmax, round(x0 / 4 + 5, 6) AS back_x, round(y1 / 4 + 7, 6) AS back_y,
bound, round(CASE WHEN even THEN 2.0 WHEN bound IS NULL THEN 1.6 WHEN (l_linenumber * 90) % 180 = 0 THEN 300 / bound ELSE 300 / tall END, 6)::DOUBLE AS ppp, CASE WHEN even THEN coalesce(bound = 150, FALSE) ELSE TRUE END AS fits,
round(abs((x1 - x0) * (y1 - y0)), 6) AS poly, x1 - x0 >= -0.01 AND y1 > y0 AND x1 <> x0 AS poly_fits, round(greatest(x0, x1), 6) AS env_x1,
array_to_string(list_transform([x0, y0, x1, y1], lambda v: regexp_replace(printf('%.2f', floor(v * 100 + 0.5) / 100), '\\.?0+$', '')), ',') AS key, CAST(floor((y0 + y1) / 2 / 12 + 0.5) AS BIGINT) AS row, round((x0 + x1) / 2, 6) AS col,
round((0.299 * q + 0.587 * (q * 2) + 0.114 * (q * 3)) / 255, 6) AS light, CASE WHEN even THEN 180 ELSE 90 END AS rotation, round(q, 6) AS merged_width FROM g""",
    "id_forms": """WITH f AS (SELECT *, 'relation|' || least(p_type, p_brand) || '|' || greatest(p_type, p_brand) AS dk, '{"a":[null,"' || p_brand || '"],"b":' || p_size || '}' AS js FROM part)
SELECT p_partkey, lower(to_base(list_reduce([2166136261::BIGINT] || list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36, 7)) AS hash, 'ps:' || sha256(p_name)[1:12] || ':p' || p_size AS page,
'ps:x:d:' || lower(to_base(list_reduce([2166136261::BIGINT] || list_transform(string_split(dk, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36, 7)) AS derived, js AS canonical, sha256(js) AS digest, sha256(p_name) AS sha FROM f""",
    "number_forms": "SELECT l_suppkey, round(sum(greatest(0.0, least(1.0, l_discount * 15 - 0.2))), 6) AS clamped, CAST(sum(CAST(round(round((l_partkey * 3.0::DOUBLE + l_orderkey * 25.0::DOUBLE) / 1e6, 6) * 1000000) AS BIGINT)) AS BIGINT) AS cost, round(max(CASE WHEN l_linenumber > 3 THEN l_extendedprice / 3600 * 1.8 / (l_linenumber - 3) END), 6) AS arm, CAST(NULL AS DOUBLE) AS never FROM lineitem GROUP BY l_suppkey",
    "region_owner": f"WITH {L.MIXED}, r AS (SELECT unnest(range(4)) AS region), x AS (SELECT page_id, concat('o:', page_id, ':', ord) AS id, region, (x1 - x0) * greatest(0.0, least(y1, region * 40.0 + 40) - greatest(y0, region * 40.0)) AS shared FROM ocr CROSS JOIN r), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY shared DESC, region) AS n FROM x WHERE shared > 0) SELECT page_id, id, region, round(shared, 6)::DOUBLE AS shared FROM k WHERE n = 1",
    "reading_coverage": f"WITH {L.MIXED} SELECT n.page_id, concat('n:', n.page_id, ':', n.row, ':', n.ord % 2) AS id, round(least(1.0, sum({_INTER}) / any_value((n.x1 - n.x0) * (n.y1 - n.y0))), 6)::DOUBLE AS covered FROM nat n JOIN ocr o ON o.page_id = n.page_id AND o.recovery_method IS NULL AND {_INTER} > 0 GROUP BY n.page_id, n.row, n.ord",
    "repeated_recoveries": f"""WITH {L.MIXED}, m AS (SELECT page_id, ord, text, tokens, x0 + 2 AS x0, y0 - 12 AS y0, x1 + 2 AS x1, y1 - 12 AS y1 FROM ocr WHERE recovery_method IS NOT NULL), pr AS (SELECT n.page_id, n.ord, o.ord AS k, n.tokens AS nt, o.tokens AS ot, string_split(trim(regexp_replace(lower(n.text), '[^a-z0-9%£€$+.-]+', ' ', 'g')), ' ') AS wa, string_split(trim(regexp_replace(lower(o.text), '[^a-z0-9%£€$+.-]+', ' ', 'g')), ' ') AS wb FROM m n JOIN ocr o ON o.page_id = n.page_id AND o.recovery_method IS NULL AND {_INTER} / ((n.x1 - n.x0) * (n.y1 - n.y0)) >= 0.5),
si AS (SELECT *, array_to_string(wa, '') AS ca, array_to_string(wb, '') AS cb FROM pr), t AS (SELECT *, CASE WHEN ca = cb THEN 1.0 WHEN contains(ca, cb) OR contains(cb, ca) THEN least(len(ca), len(cb)) / greatest(len(ca), len(cb)) ELSE 2.0 * len(list_intersect(wa, wb)) / (len(wa) + len(wb)) END AS textual FROM si)
SELECT page_id, concat('o:', page_id, ':', ord) AS id, min(k) AS duplicate_of FROM t WHERE textual >= 0.72 AND list_sort(nt) = list_sort(ot) GROUP BY page_id, ord""",
    "best_overlaps": f"WITH {L.MIXED}, x AS (SELECT n.page_id, concat('n:', n.page_id, ':', n.row, ':', n.ord % 2) AS id, concat('o:', o.page_id, ':', o.ord) AS other, {_INTER} / {_UNION} AS iou FROM nat n JOIN ocr o ON o.page_id = n.page_id AND o.text = n.text), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY iou DESC, other DESC) AS n FROM x) SELECT page_id, id, other, round(iou, 6)::DOUBLE AS iou FROM k WHERE n = 1",
    "greedy_pairs": f"""WITH RECURSIVE {L.MIXED}, x AS (SELECT n.page_id, n.ord AS l, o.ord AS r, round({_INTER} / {_UNION}, 6) AS score FROM nat n JOIN ocr o ON o.page_id = n.page_id AND o.text = n.text),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, l, r) AS i FROM x),
w AS (SELECT page_id, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS ul, CAST([] AS BIGINT[]) AS ur, 0.0::DOUBLE AS s FROM (SELECT DISTINCT page_id FROM k)
  UNION ALL SELECT k.page_id, k.i, CASE WHEN list_contains(ul, k.l) OR list_contains(ur, k.r) THEN ul ELSE list_append(ul, k.l) END, CASE WHEN list_contains(ul, k.l) OR list_contains(ur, k.r) THEN ur ELSE list_append(ur, k.r) END, s + CASE WHEN list_contains(ul, k.l) OR list_contains(ur, k.r) THEN 0 ELSE k.score END FROM w JOIN k ON k.page_id = w.page_id AND k.i = w.i + 1)
SELECT page_id, len(arg_max(ul, i))::BIGINT AS pairs, round(arg_max(s, i), 6) AS score FROM w GROUP BY page_id""",
    "unique_texts": f"WITH {L.MIXED}, o1 AS (SELECT page_id, text, min(x0) AS read_x0 FROM ocr GROUP BY ALL HAVING count(*) = 1), n1 AS (SELECT *, count(*) OVER (PARTITION BY page_id, text) AS c FROM nat) SELECT n1.page_id, concat('n:', n1.page_id, ':', n1.row, ':', n1.ord % 2) AS id, n1.text, CASE WHEN c = 1 THEN read_x0 END AS read_x0 FROM n1 LEFT JOIN o1 ON o1.page_id = n1.page_id AND o1.text = n1.text",
    "overlays": f"WITH {L.MIXED} SELECT page_id, page_id % 5 = 0 AND count(*) FILTER (WHERE ord % 4 = 0) > 0 AS overlay FROM nat GROUP BY page_id",
    "gold_join": "SELECT o_orderkey AS page, sha256(o_custkey::VARCHAR) AS sha256, o_orderstatus, o_totalprice FROM orders",
    "text_differences": "WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, n::BIGINT AS lines, (CASE WHEN n > 1 THEN 1 ELSE 0 END + CASE WHEN n > 1 THEN (n - 1) // 3 ELSE 0 END)::BIGINT AS different FROM p",
    "run_presence": "WITH a AS (SELECT o_orderkey AS p FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS p FROM orders WHERE o_orderkey % 7 <> 0) SELECT CASE WHEN a.p IS NULL THEN 'only_right' WHEN b.p IS NULL THEN 'only_left' WHEN a.p % 5 = 0 THEN 'different' ELSE 'same' END AS state, count(*) AS pages FROM a FULL JOIN b ON a.p = b.p GROUP BY 1",
    "containers": f"WITH {_S}, k AS (SELECT c.user_id, c.event_id AS child_id, p.event_id AS parent_id, row_number() OVER (PARTITION BY c.event_id ORDER BY p.b - p.a, p.event_id) AS n FROM s c LEFT JOIN (SELECT event_id, user_id, a, b + 3600000 AS b FROM s WHERE event_type = 'view') p ON p.user_id = c.user_id AND p.a <= c.a AND c.b <= p.b WHERE c.event_type = 'click') SELECT user_id, child_id, parent_id FROM k WHERE n = 1",
    "subtracted": f"""WITH {_S}, v AS (SELECT user_id, a, b + 3600000 AS b FROM s WHERE event_type = 'view'), c AS (SELECT user_id, a, b FROM s WHERE event_type = 'click'), {_union_of('v', 'user_id', 'mv')}, {_union_of('c', 'user_id', 'mc')},
i AS (SELECT mv.user_id, mv.a AS va, mv.b AS vb, greatest(mv.a, mc.a) AS a, least(mv.b, mc.b) AS b FROM mv JOIN mc ON mc.user_id = mv.user_id AND mc.a < mv.b AND mv.a < mc.b),
x AS (SELECT user_id, a, b, lag(b, 1, va) OVER (PARTITION BY user_id, va ORDER BY a) AS before, lead(a) OVER (PARTITION BY user_id, va ORDER BY a) AS after, vb FROM i),
g AS (SELECT user_id, before AS a, a AS b FROM x WHERE a > before UNION ALL SELECT user_id, b, vb FROM x WHERE after IS NULL AND vb > b UNION ALL SELECT user_id, a, b FROM mv WHERE NOT EXISTS (SELECT 1 FROM mc WHERE mc.user_id = mv.user_id AND mc.a < mv.b AND mv.a < mc.b))
SELECT user_id, count(*) AS pieces, CAST(sum(b - a) AS BIGINT) AS left_over FROM g GROUP BY user_id""",
    "stage_shares": f"""WITH {_S}, {_union_of('s', 'user_id, event_type', 'st')}, {_union_of('s', 'user_id', 'ro')}, r AS (SELECT user_id, sum(b - a) AS t FROM ro GROUP BY user_id), o AS (SELECT user_id, event_type, CAST(sum(b - a) AS BIGINT) AS occupied FROM st GROUP BY ALL),
c AS (SELECT user_id, event_type, count(*) AS calls, CAST(sum(b - a) AS BIGINT) AS service FROM s GROUP BY ALL) SELECT user_id AS role, event_type AS stage, calls, service, occupied, occupied AS exclusive, round(occupied / t, 6) AS share FROM c JOIN o USING (user_id, event_type) JOIN r USING (user_id)""",
    "arm_gate": """WITH d AS (SELECT l_orderkey % 3 = 0 AS t, l_suppkey % 2 = 0 AS mine, ['correct', 'incorrect', 'missing', 'unsure', 'pending'][l_partkey % 5 + 1] AS v, l_linenumber % 2 = 0 AS caught FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
c AS (SELECT count(*) FILTER (WHERE t AND mine AND v = 'incorrect') AS newly_incorrect, count(*) FILTER (WHERE t AND NOT mine AND v = 'missing') AS missing, count(*) FILTER (WHERE t AND v IN ('unsure', 'pending')) AS unresolved, count(*) FILTER (WHERE v = 'pending') AS pending, count(*) FILTER (WHERE mine AND v = 'incorrect' AND NOT caught) AS uncaught, count(*) FILTER (WHERE mine) AS candidate_only, count(*) FILTER (WHERE NOT mine) AS control_only FROM d)
SELECT c.*, (SELECT count(*) FROM orders WHERE o_orderkey % 19 = 0) AS deterministic_differ, (SELECT count(*) FROM orders WHERE o_orderkey % 23 = 0) AS cleared_routes, FALSE AS "pass" FROM c""",
    "arm_strata": "WITH d AS (SELECT o_orderkey, o_orderpriority, count(l_suppkey) FILTER (WHERE l_suppkey % 2 = 0) AS a, count(l_suppkey) FILTER (WHERE l_suppkey % 2 = 1) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderpriority, count(*) AS pages, count(*) FILTER (WHERE a + b > 0) AS differing_pages, CAST(sum(a) AS BIGINT) AS candidate_only, CAST(sum(b) AS BIGINT) AS control_only FROM d GROUP BY 1",
    "repeat_medians": "SELECT l_suppkey, count(*) AS repeats, median(l_extendedprice) AS median_ms, min(l_extendedprice) AS min_ms, max(l_extendedprice) AS max_ms FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey",
    "box_origins": "SELECT CASE o_orderstatus WHEN 'O' THEN 'model' WHEN 'F' THEN 'ocr' ELSE 'none' END AS box_source, count(*) AS tokens FROM orders GROUP BY 1",
    "stage_dominance": "WITH e AS (SELECT user_id, event_type, sum(value) AS c FROM events GROUP BY ALL), s AS (SELECT c / sum(c) OVER (PARTITION BY user_id) AS x FROM e) SELECT CASE WHEN x >= 0.7 THEN 'dominant' WHEN x >= 0.2 THEN 'candidate' ELSE 'minor' END AS decision, count(*) AS stages FROM s GROUP BY 1",
    "label_pages": "WITH p AS (SELECT source, unnest([lang, CASE WHEN doc_id % 4 = 0 THEN 'chart' ELSE 'text' END]) AS label FROM documents) SELECT label, count(*) AS pages, count(DISTINCT source) AS documents FROM p GROUP BY label",
    "page_classes": "SELECT CASE WHEN o_orderkey % 7 > 0 THEN 'conflict' WHEN o_orderkey % 2 = 0 THEN 'escalated' ELSE 'clean' END AS class, count(*) AS pages FROM orders GROUP BY 1",
    "near_words": f"WITH {L.MIXED}, t AS (SELECT page_id, (x0 + x1) / 2 AS tx, (y0 + y1) / 2 AS ty FROM ocr WHERE ord = 0), k AS (SELECT n.page_id, text, row_number() OVER (PARTITION BY n.page_id ORDER BY pow((x0 + x1) / 2 - tx, 2) + pow((y0 + y1) / 2 - ty, 2), ord) AS i FROM nat n JOIN t USING (page_id)) SELECT page_id, string_agg(text, '|' ORDER BY i) AS words FROM k WHERE i <= 5 GROUP BY page_id",
    "spaced_rows": f"WITH {L.LINES}, n AS (SELECT page_id, ord, greatest(1, count(*) OVER (PARTITION BY page_id) // 3) AS step FROM l) SELECT page_id, ord FROM n WHERE ord % step = 0 AND ord // step < 3",
    "ranking_duel": "WITH a AS (SELECT c_custkey AS q, c_nationkey % 4 + 1 AS r FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS q, c_custkey % 4 + 1 AS r FROM customer WHERE c_custkey % 7 <> 0), j AS (SELECT coalesce(a.r, 1000) AS x, coalesce(b.r, 1000) AS y FROM a FULL JOIN b ON a.q = b.q) SELECT count(*) FILTER (WHERE x < y) AS wins, count(*) FILTER (WHERE x > y) AS losses, count(*) FILTER (WHERE x = y) AS ties FROM j",
}
