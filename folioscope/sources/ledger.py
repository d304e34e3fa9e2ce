"""Observation tables from the star schema: an order is a page, a line item a printed line.

The embedded text and the reading differ where the rules say so, which gives pages with
agreements, disputes, omissions and recoveries (FIXTURES.md 2.1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"]


#: Line items of a slice, about.
SLICE_ROWS = 2_000_000


def page_slices(spark: SparkSession, sf_dir: str, rows: int = SLICE_ROWS) -> list[F.Column]:
    """Conditions on ``l_orderkey`` that share out all pages, null included, each to one slice of about ``rows`` line
    items. Ranges, so a slice skips the row groups of others; that their ends are approximate decides sizes only."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = -(-items.count() // rows)
    cuts = sorted(set(int(c) for c in items.approxQuantile("l_orderkey", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    key = F.col("l_orderkey")
    if not cuts:
        return [F.lit(True)]
    return [key.isNull() | (key < cuts[0]), *[(key >= a) & (key < b) for a, b in zip(cuts, cuts[1:])], key >= cuts[-1]]


def lines(spark: SparkSession, sf_dir: str, pages: F.Column | None = None) -> DataFrame:
    """Line items with their position on the page and the amount in cents; ``pages`` is one of ``page_slices``."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (items if pages is None else items.where(pages)).select(
        F.col("l_orderkey").alias("page_id"),
        (F.row_number().over(w) - 1).alias("ord"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


def _text(cents) -> F.Column:
    return F.concat(F.lit("qty "), F.col("qty").cast("string"), F.lit(" total $"), cents.cast("string"))


def _box(shift: float) -> list:
    top = (F.col("ord") * 20).cast("double") + shift
    return [F.lit(10.0 + shift).alias("x0"), top.alias("y0"), F.lit(300.0 + shift).alias("x1"), (top + 16).alias("y1")]


def _id(kind: str):
    return F.concat_ws(":", F.lit(kind), F.col("page_id"), F.col("ord"))


def native(rows: DataFrame) -> DataFrame:
    """The embedded text."""
    return rows.where("part % 11 <> 0").select("page_id", "ord", _id("n").alias("id"), _text(F.col("cents")).alias("text"), *_box(0.0), F.lit("F1").alias("font"))


def ocr(rows: DataFrame) -> DataFrame:
    """The reading: some lines missed, some digits misread, some from a recovery pass."""
    misread = F.when(F.col("part") % 7 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    return rows.where("part % 13 <> 0").select(
        "page_id", "ord", _id("o").alias("id"), _text(misread).alias("text"), *_box(1.0),
        ((F.col("part") % 100) / 100.0).alias("confidence"),
        F.when(F.col("supp") % 17 == 0, "zoom-retry-v1").alias("recovery_method"),
    )


def second_reading(rows: DataFrame) -> DataFrame:
    """What an engine of another family read."""
    return rows.where("supp % 3 = 0").select("page_id", "ord", _id("s").alias("id"), _text(F.col("cents")).alias("text"), *_box(0.0), F.when(F.col("supp") % 5 != 0, 0.9).alias("confidence"))


def mixed_native(rows: DataFrame) -> DataFrame:
    """Embedded text of pages on which lines cross: every twelve pixels a line of sixteen, by part number a
    whole line, a bare number, a line in two pieces, or a note."""
    kind, top = F.col("part") % 6, (F.col("ord") * 12).cast("double")
    text, cents = _text(F.col("cents")), F.col("cents").cast("string")
    piece = lambda n, t, x0, x1: F.struct(F.lit(n).alias("n"), t.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    left, right = F.concat(F.lit("qty "), F.col("qty").cast("string")), F.concat(F.lit("total $"), cents)
    pieces = (
        F.when(kind.isin(0, 3), F.array(piece(0, text, 10, 300)))
        .when(kind == 2, F.array(piece(0, left, 10, 140), piece(1, right, 150, 300)))
        .when(kind == 4, F.array(piece(0, F.concat(F.lit("note "), F.col("qty").cast("string")), 10, 150)))
        .otherwise(F.array(piece(0, cents, 10, 110)))
    )
    df = rows.where("part % 11 <> 0").select("page_id", "ord", top.alias("y0"), F.explode(pieces).alias("p"))
    return df.select("page_id", (F.col("ord") * 2 + F.col("p.n")).alias("ord"), F.concat_ws(":", F.lit("n"), "page_id", "ord", "p.n").alias("id"), "p.text", "p.x0", "y0", "p.x1", (F.col("y0") + 16).alias("y1"), F.lit("F1").alias("font"))


def mixed_ocr(rows: DataFrame) -> DataFrame:
    """The reading of the same pages: digits misread, amounts left out, boxes that touch or miss."""
    kind, top = F.col("part") % 6, (F.col("ord") * 12).cast("double")
    cents = F.when(F.col("part") % 7 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    text = F.when(kind.isin(0, 2), _text(cents)).when(kind == 3, "qty total").when(kind == 4, F.concat(F.lit("note "), F.col("qty").cast("string"))).otherwise(cents.cast("string"))
    x0 = F.when(kind == 4, 200.0).when(kind == 5, 70.0).otherwise(11.0)
    width = F.when(kind == 4, 130.0).when(kind.isin(1, 5), 100.0).otherwise(290.0)
    return rows.where("part % 13 <> 0").select(
        "page_id", "ord", _id("o").alias("id"), text.alias("text"), x0.alias("x0"), (top + 1).alias("y0"), (x0 + width).alias("x1"), (top + 17).alias("y1"),
        ((F.col("part") % 100) / 100.0).alias("confidence"), F.when(F.col("supp") % 17 == 0, "zoom-retry-v1").alias("recovery_method"),
    )


#: The ledger's rows in SQL, and the embedded items and readings of either kind of page: ``row`` is the
#: printed line, ``tokens`` the cores of the critical tokens.
LINES = """l AS (SELECT l_orderkey AS page_id,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS ord,
             l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
      FROM lineitem)"""
PLAIN = f"""{LINES},
nat AS (SELECT page_id, ord, ord AS "row", qty, cents, concat('qty ', qty, ' total $', cents) AS text, [qty::VARCHAR, concat('$', cents)] AS tokens,
               10.0::DOUBLE AS x0, 20.0::DOUBLE * ord AS y0, 300.0::DOUBLE AS x1, 20.0::DOUBLE * ord + 16 AS y1 FROM l WHERE part % 11 <> 0),
read AS (SELECT *, CASE WHEN part % 7 = 0 THEN cents + 1 ELSE cents END AS c FROM l WHERE part % 13 <> 0),
ocr AS (SELECT page_id, ord, qty, c AS cents, concat('qty ', qty, ' total $', c) AS text, [qty::VARCHAR, concat('$', c)] AS tokens, (part % 100) / 100.0 AS confidence,
               CASE WHEN supp % 17 = 0 THEN 'zoom-retry-v1' END AS recovery_method, 11.0::DOUBLE AS x0, 20.0::DOUBLE * ord + 1 AS y0, 301.0::DOUBLE AS x1, 20.0::DOUBLE * ord + 17 AS y1 FROM read)"""
MIXED = f"""{LINES},
kinds AS (SELECT *, part % 6 AS k, concat('qty ', qty, ' total $', cents) AS whole, CASE WHEN part % 7 = 0 THEN cents + 1 ELSE cents END AS c FROM l),
nat AS (SELECT page_id, ord * 2 AS ord, ord AS "row", CASE WHEN k IN (0, 3) THEN whole WHEN k = 2 THEN concat('qty ', qty) WHEN k = 4 THEN concat('note ', qty) ELSE cents::VARCHAR END AS text,
               CASE WHEN k IN (0, 3) THEN [qty::VARCHAR, concat('$', cents)] WHEN k IN (2, 4) THEN [qty::VARCHAR] ELSE [cents::VARCHAR] END AS tokens,
               10.0::DOUBLE AS x0, 12.0::DOUBLE * ord AS y0, CASE k WHEN 0 THEN 300.0 WHEN 3 THEN 300.0 WHEN 2 THEN 140.0 WHEN 4 THEN 150.0 ELSE 110.0 END::DOUBLE AS x1, 12.0::DOUBLE * ord + 16 AS y1
        FROM kinds WHERE part % 11 <> 0
        UNION ALL SELECT page_id, ord * 2 + 1, ord, concat('total $', cents), [concat('$', cents)], 150.0, 12.0 * ord, 300.0, 12.0 * ord + 16 FROM kinds WHERE part % 11 <> 0 AND k = 2),
ocr AS (SELECT page_id, ord, CASE WHEN k IN (0, 2) THEN concat('qty ', qty, ' total $', c) WHEN k = 3 THEN 'qty total' WHEN k = 4 THEN concat('note ', qty) ELSE c::VARCHAR END AS text,
               CASE WHEN k IN (0, 2) THEN [qty::VARCHAR, concat('$', c)] WHEN k = 3 THEN CAST([] AS VARCHAR[]) WHEN k = 4 THEN [qty::VARCHAR] ELSE [c::VARCHAR] END AS tokens,
               (part % 100) / 100.0 AS confidence, CASE WHEN supp % 17 = 0 THEN 'zoom-retry-v1' END AS recovery_method,
               CASE k WHEN 4 THEN 200.0 WHEN 5 THEN 70.0 ELSE 11.0 END::DOUBLE AS x0, 12.0::DOUBLE * ord + 1 AS y0,
               CASE k WHEN 4 THEN 330.0 WHEN 5 THEN 170.0 WHEN 1 THEN 111.0 ELSE 301.0 END::DOUBLE AS x1, 12.0::DOUBLE * ord + 17 AS y1 FROM kinds WHERE part % 13 <> 0)"""
#: Association from its definition: every candidate in reach of a reading is scored, none is left out beforehand.
#: Texts here are plain ASCII, printed lines stand apart, and no two tokens have different unit words.
SCORED = """li AS (SELECT page_id, "row", string_agg(text, ' ' ORDER BY x0) AS text, flatten(list(tokens ORDER BY x0)) AS tokens, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
             list([x0, y0, x1, y1] ORDER BY x0) AS boxes, list(ord ORDER BY x0) AS sources FROM nat GROUP BY page_id, "row"),
cand AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY "row") - 1 AS candidate, text, tokens, y0, y1, boxes, len(sources) AS sources FROM li
         UNION ALL SELECT page_id, 10000000000 + ord, text, tokens, y0, y1, [[x0, y0, x1, y1]], 1 FROM nat),
f AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9%£€$+.-]+', ' ', 'g')) AS form FROM cand),
o AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9%£€$+.-]+', ' ', 'g')) AS form FROM ocr),
pairs AS (SELECT o.page_id, o.ord AS ocr_ord, o.recovery_method, o.tokens AS ot, f.tokens AS nt, f.candidate, f.sources, o.form AS a, f.form AS b, replace(o.form, ' ', '') AS ca, replace(f.form, ' ', '') AS cb,
                 string_split(o.form, ' ') AS wa, string_split(f.form, ' ') AS wb, regexp_matches(o.text, '[a-zA-Z]') AS ol, regexp_matches(f.text, '[a-zA-Z]') AS nl,
                 greatest(floor(f.y0 / 64), floor(o.y0 / 64) - 1) AS band, [o.x0, o.y0, o.x1, o.y1] AS ob, f.boxes
          FROM o JOIN f ON f.page_id = o.page_id AND greatest(floor(f.y0 / 64), floor(o.y0 / 64) - 1) <= least(floor(f.y1 / 64), floor(o.y1 / 64) + 1)),
sim AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b OR ca = cb THEN 1.0 WHEN contains(ca, cb) OR contains(cb, ca) THEN least(len(ca), len(cb)) / greatest(len(ca), len(cb))
                       ELSE 2.0 * list_sum(list_transform(list_distinct(wa), lambda w: least(len(list_filter(wa, lambda x: x = w)), len(list_filter(wb, lambda x: x = w))))) / (len(wa) + len(wb)) END::DOUBLE AS textual,
               list_max(list_transform(boxes, lambda m: greatest(0.0, least(m[3], ob[3]) - greatest(m[1], ob[1])) * greatest(0.0, least(m[4], ob[4]) - greatest(m[2], ob[2]))
                                                        / least((m[3] - m[1]) * (m[4] - m[2]), (ob[3] - ob[1]) * (ob[4] - ob[2]))))::DOUBLE AS geometric FROM pairs),
sc AS (SELECT *, textual * 0.78 + geometric * 0.22 AS score, geometric >= 0.45 AND textual >= 0.5 AS texted, NOT ol AND len(ot) > 0 AND geometric >= 0.8 AND len(nt) = len(ot) AND NOT nl AS numbered FROM sim),
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id, ocr_ord ORDER BY round(score, 9) DESC, band, candidate) AS best_rank,
              CASE WHEN texted OR numbered THEN row_number() OVER (PARTITION BY page_id, ocr_ord ORDER BY CASE WHEN texted THEN 0 WHEN numbered THEN 1 ELSE 2 END, CASE WHEN texted THEN round(textual, 9) END DESC, round(geometric, 9) DESC, band, candidate) END AS local_rank FROM sc),
lo AS (SELECT page_id, ocr_ord, textual, geometric, sources, CASE WHEN recovery_method IS NOT NULL OR len(nt) + len(ot) = 0 OR list_sort(nt) = list_sort(ot) THEN NULL
              WHEN len(nt) > 0 AND len(ot) > 0 THEN 'critical-token-disagreement' ELSE 'critical-token-omission' END AS verdict FROM rk WHERE local_rank = 1),
be AS (SELECT page_id, ocr_ord, textual, geometric, sources, CASE WHEN textual >= 0.72 AND geometric >= 0.12 THEN 'match' END AS verdict FROM rk WHERE best_rank = 1),
assoc AS (SELECT be.page_id, be.ocr_ord, coalesce(lo.verdict, be.verdict) AS verdict, CASE WHEN lo.verdict IS NOT NULL THEN lo.textual ELSE be.textual END AS textual,
                 CASE WHEN lo.verdict IS NOT NULL THEN lo.geometric ELSE be.geometric END AS geometric, CASE WHEN lo.verdict IS NOT NULL THEN lo.sources ELSE be.sources END AS sources
          FROM be LEFT JOIN lo ON lo.page_id = be.page_id AND lo.ocr_ord = be.ocr_ord),
verdicts AS (SELECT o.page_id, o.ord AS ocr_ord, o.confidence, o.recovery_method, s.verdict, s.textual, s.geometric, s.sources FROM ocr o LEFT JOIN assoc s ON s.page_id = o.page_id AND s.ocr_ord = o.ord)"""
SQL = f"{PLAIN},\n{SCORED}"
MIXED_SQL = f"{MIXED},\n{SCORED}"
