"""Page records: normalisation of observations, one nested record per page, and derived envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import ids as Ids
from folioscope.functions import text as T

BOX = ["x0", "y0", "x1", "y1"]


def normalize_observations(raw: DataFrame, source: str, *, matrix: Column | None = None, confidence: bool = False) -> DataFrame:
    """Observations with rounded boxes, trimmed texts and stable ids (REC1, REC2, FLT1, NUM1).

    ``raw``: document_sha256, page_number, ord, text, a box (in points if ``matrix`` is given).
    Blank texts go. The id is made from the text before trimming and counts equal ones.
    """
    df = raw.where(~T.is_blank(F.col("text")))
    b = G.render_box(G.box(), matrix) if matrix is not None else G.box()
    df = df.withColumns(dict(zip(BOX, map(G.round_half_up, b))))
    df = Ids.occurrence(df, ["document_sha256", "page_number", "text", *BOX], ["ord"])
    df = Ids.with_observation_ids(df, F.col("document_sha256"), F.col("page_number"), source, G.box(), "id")
    df = df.withColumns({"page_id": Ids.page_id(F.col("document_sha256"), F.col("page_number")), "text": F.regexp_replace("text", rf"^[{T.SPACES}]+|[{T.SPACES}]+$", "")})
    if confidence:
        df = df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    return df.drop("occurrence")


def _nested(df: DataFrame, name: str, order: str, fields: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))))
    return df.groupBy("page_id").agg(F.transform(rows, lambda x: x["v"]).alias(name))


def page_records(native: DataFrame, ocr: DataFrame, verdicts: DataFrame, diagnostics: DataFrame, markdown: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """One nested record per page of ``diagnostics`` (REC3).

    ``unread_ink`` is null where a page was never analysed and empty where it is clean, so
    ``regions`` has a row per analysed page, with a null region where it is clean.
    """
    parts = [
        _nested(native, "native", "ord", ["id", "text", *BOX]),
        _nested(ocr, "ocr", "ord", ["id", "text", *BOX, "confidence", "recovery_method"]),
        _nested(verdicts.where("verdict = 'match'"), "matches", "ocr_ord", ["ocr_id", "native_ids", "kind", "textual", "geometric", "confidence"]),
        _nested(verdicts.where("verdict <> 'match'"), "conflicts", "ocr_ord", ["ocr_id", "native_ids", "verdict", "native_text", "ocr_text", "native_tokens", "ocr_tokens", "geometric"]),
    ]
    out = diagnostics
    for p in parts:
        out = out.join(p, "page_id", "left")
    if markdown is not None:
        out = out.join(markdown.select("page_id", "markdown"), "page_id", "left")
    if regions is not None:
        own = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("region").isNotNull(), F.struct("region", *BOX, "kind")))).alias("unread_ink"))
        out = out.join(own, "page_id", "left")
    return out


def page_digests(records: DataFrame) -> DataFrame:
    """Digest of each record's canonical JSON (ID6)."""
    return records.select("page_id", Ids.record_digest(F.to_json(F.struct(*records.columns))).alias("digest"))


def identity_violations(native_pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """Pages whose witnesses do not belong together (REC4, REC5): other page number or digest, or
    bounds that differ by more than a millionth."""
    r = rendered.select("page_id", F.col("document_sha256").alias("r_sha"), F.col("page_number").alias("r_page"), F.col("point_width").alias("r_w"), F.col("point_height").alias("r_h"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6 * F.greatest(F.abs(a), F.abs(b))
    df = native_pages.join(r, "page_id", "full_outer")
    why = F.when(F.col("r_sha").isNull() | F.col("document_sha256").isNull(), "missing witness").when(F.col("document_sha256") != F.col("r_sha"), "other document").when(F.col("page_number") != F.col("r_page"), "other page").when(~(near("point_width", "r_w") & near("point_height", "r_h")), "other bounds")
    return df.select("page_id", why.alias("violation")).where("violation is not null")


def enrichment_records(proposals: DataFrame, status: DataFrame, digests: DataFrame) -> DataFrame:
    """What an engine proposed for a page, bound to the page's digest (REC9). ``status`` comes from
    ``proposal_status``."""
    rows = proposals.join(status.select("page_id", "id", "status"), ["page_id", "id"])
    body = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("id", "text", "status").alias("v")))), lambda x: x["v"]).alias("proposals"), *[F.count_if(F.col("status") == s).alias(s) for s in ("both", "native", "ocr", "novel")])
    return body.join(digests.withColumnRenamed("digest", "base_digest"), "page_id")


def public_envelopes(records: DataFrame, document: str, page: str = "page_number") -> DataFrame:
    """Evidence and compact envelope of each document (REC10): two JSON texts with pages in order."""
    compact = [c for c in (page, "page_id", "markdown", "escalates") if c in records.columns]
    ordered = lambda cols: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("_o"), F.to_json(F.struct(*cols)).alias("j")))), lambda x: x["j"]))
    return records.groupBy(document).agg(F.count("*").alias("pages"), ordered([c for c in records.columns if c != document]).alias("evidence"), ordered(compact).alias("compact"))


def stable_projection(records: DataFrame, volatile: tuple[str, ...] = ("timings", "created_at", "backend")) -> DataFrame:
    """What must be equal between runs (REC12): everything but what depends on when and where."""
    return records.drop(*[c for c in volatile if c in records.columns])


def admit_second_opinion(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Readings of a second engine that may be kept (FLT15): on a known page, not blank, inside it,
    with a confidence in 0 to 1 or none, judged on the rounded box."""
    df = readings.withColumns(dict(zip(BOX, map(G.round_half_up, G.box())))).join(pages.select("page_id", "width", "height"), "page_id")
    sure = F.col("confidence").isNull() | F.col("confidence").between(0, 1)
    return df.where(~T.is_blank(F.col("text")) & G.is_within(G.box(), F.col("width"), F.col("height")) & sure).drop("width", "height")


def chart_matches(gold: DataFrame, found: DataFrame, *, fold: bool = True) -> DataFrame:
    """Chart tuples found, each detection used once (JOIN23, AGG19): all tokens of category and value
    compatible one by one. Both have page_id, category, value; gold goes in the order of its text."""
    from folioscope.functions.numbers import rate
    from folioscope.operators.pages import fold_pages

    def side(df: DataFrame, n: int) -> DataFrame:
        text = F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("value", F.lit("")))
        return df.select("page_id", F.lit(n).alias("side"), text.alias("text"), T.critical_tokens(text, fold=fold).alias("tokens"))

    def run(rows: list[dict]) -> list[tuple]:
        left = [r["tokens"] for r in rows if r["side"] == 0]
        n_found, n_gold, hit = len(left), 0, 0
        fits = lambda a, b: len(a) == len(b) and all(x["core"] == y["core"] and (x["tail"] is None or y["tail"] is None or x["tail"] == y["tail"]) for x, y in zip(a, b))
        for r in (r for r in rows if r["side"]):
            n_gold += 1
            k = next((k for k, x in enumerate(left) if fits(x, r["tokens"])), None)
            if k is not None:
                left.pop(k)
                hit += 1
        return [(rows[0]["page_id"], n_gold, n_found, hit)]

    kind = gold.schema["page_id"].dataType.simpleString()
    sums = fold_pages(side(found, 0).unionByName(side(gold, 1)), ["page_id"], ["side", "text"], run, f"page_id {kind}, gold long, found long, matched long")
    return sums.withColumns({"recall": rate(F.col("matched"), F.col("gold")), "precision": rate(F.col("matched"), F.col("found"))})


def difference_to_conflict(differences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Token differences that a recorded conflict explains (JOIN33): the token is in the conflict's
    tokens of its side. ``differences``: page_id, token, side (native or ocr)."""
    c = verdicts.where("verdict <> 'match'").select("page_id", "ocr_id", F.explode(F.array(F.struct(F.lit("native").alias("side"), F.col("native_tokens").alias("t")), F.struct(F.lit("ocr").alias("side"), F.col("ocr_tokens").alias("t")))).alias("x"))
    c = c.select("page_id", "ocr_id", "x.side", F.explode("x.t").alias("token"))
    tied = differences.join(c, ["page_id", "side", "token"], "left").groupBy("page_id", "side", "token").agg(F.min("ocr_id").alias("conflict"))
    return tied


def adjudication_lookup(differences: DataFrame, rulings: DataFrame) -> DataFrame:
    """The ruling on each occurrence of a differing token (JOIN34), null where there is none."""
    w = Window.partitionBy("page_id", "side", "token").orderBy("ord")
    return differences.withColumn("occurrence", F.row_number().over(w) - 1).join(rulings.select("page_id", "side", "token", "occurrence", "ruling"), ["page_id", "side", "token", "occurrence"], "left")
