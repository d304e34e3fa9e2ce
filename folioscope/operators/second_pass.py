"""Second readings of pages: tiles of unread regions, starved pages read again, gold samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import geometry as G
from folioscope.functions import text as T
from folioscope.operators import corroborate as C
from folioscope.operators import diagnostics as D
from folioscope.operators.associate import repeated_readings
from folioscope.operators.records import admit_second_opinion

METHOD = "zoom-retry-v1"


def recovered_readings(tile_readings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New readings of a tiled second pass and receipts of what it confirms (FOLD11, FLT16).

    ``tile_readings``: page_id, ord (order of the tiles, then in the tile), id, text, a box in the
    tile, origin_x, origin_y, zoom, confidence. Boxes go back to the first rendering. Blank
    readings go; what repeats known evidence is a receipt; what overlapping tiles read twice is
    kept once, the first. ``known``: page_id, ord, text and box of all evidence of the page.
    """
    box = G.from_crop(G.box(), (F.col("origin_x"), F.col("origin_y")), F.col("zoom"))
    df = tile_readings.where(~T.is_blank(F.col("text"))).withColumns(dict(zip(("x0", "y0", "x1", "y1"), map(G.round_half_up, box)))).drop("origin_x", "origin_y", "zoom")
    repeats = repeated_readings(df, known).select("page_id", "id").distinct()
    first = lambda own: own.join(_later_copies(own), ["page_id", "id"], "left_anti")
    fresh = first(df.join(repeats, ["page_id", "id"], "left_anti")).withColumn("recovery_method", F.lit(METHOD))
    return fresh, first(df.join(repeats, ["page_id", "id"], "left_semi"))


def _later_copies(own: DataFrame) -> DataFrame:
    """Readings that repeat an earlier one of the same pass."""
    pairs = repeated_readings(own, own).join(own.select("page_id", "id", F.col("ord").alias("_o")), ["page_id", "id"])
    return pairs.where("k_ord < _o").select("page_id", "id").distinct()


def second_opinion_pass(diagnostics: DataFrame, ocr: DataFrame, verdicts: DataFrame, native_counts: DataFrame, recognize: Callable[[DataFrame], DataFrame], pages: DataFrame, *, policy: D.Policy = D.Policy(), fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """Only pages that are starved are read by another engine and judged again (STR5): the diagnostics
    of all pages, and the readings that were admitted.

    ``recognize`` gets the starved page_ids and gives readings (page_id, ord, id, text, box,
    confidence); a page that it fails on simply has none and keeps its alarm. ``pages``:
    page_id, width, height. Reasons from relations, ink or glyphs are kept from before.
    """
    starved = diagnostics.where(F.exists("reasons", lambda r: (r["type"] == "uncorroborated-ocr") & (r["severity"] == "blocking"))).select("page_id")
    admitted = admit_second_opinion(recognize(starved).join(starved, "page_id", "left_semi"), pages)
    read = admitted.select("page_id").distinct()
    mine = lambda df: df.join(read, "page_id", "left_semi")
    engaged = C.engaged_by_second_reading(mine(ocr), admitted, floor=policy.low_confidence, fold=fold)
    again = D.page_diagnostics(mine(ocr), mine(verdicts), mine(native_counts), engaged=engaged, policy=policy)
    # only the starvation reason depends on the second reading
    alarm = again.select("page_id", F.filter("reasons", lambda r: r["type"] == "uncorroborated-ocr").alias("_alarm"))
    df = diagnostics.join(alarm, "page_id", "left")
    others = F.filter("reasons", lambda r: r["type"] != "uncorroborated-ocr")
    reasons = F.when(F.col("_alarm").isNull(), F.col("reasons")).otherwise(F.concat(others, "_alarm"))
    return df.withColumn("reasons", reasons).withColumn("escalates", F.size("reasons") > 0).drop("_alarm"), admitted


def gold_pages(verdicts: DataFrame, proposals: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Gold verdicts with the proposal and the run record of their page (JOIN13), failing closed.

    Each table has the keys and ``sha256``. A page without a proposal or record is an error, and
    so is one whose digests differ: gold must describe the bytes that were parsed.
    """
    p = proposals.select(*keys, F.col("sha256").alias("_ps"), *[c for c in proposals.columns if c not in (*keys, "sha256")], F.lit(True).alias("_p"))
    r = records.select(*keys, F.col("sha256").alias("_rs"), *[c for c in records.columns if c not in (*keys, "sha256")], F.lit(True).alias("_r"))
    df = verdicts.join(p, keys, "left").join(r, keys, "left")
    name = F.concat_ws("#", *keys)
    digests = F.array_distinct(F.array_compact(F.array("sha256", "_ps", "_rs")))
    checked = F.when(F.col("_p").isNull() | F.col("_r").isNull(), F.raise_error(F.concat(F.lit("missing proposal or run record for "), name)).cast("string")).when(F.size(digests) != 1, F.raise_error(F.concat(F.lit("digests differ for "), name)).cast("string")).otherwise(F.get(digests, 0))
    return df.withColumn("sha256", checked).drop("_ps", "_rs", "_p", "_r")


def coincident_overlays(native: DataFrame) -> DataFrame:
    """Pages on which two observations have the same folded text and box (SET3): ``page_id``, ``overlay``."""
    keyed = native.select("page_id", T.nfkc(F.col("text")).alias("_t"), "x0", "y0", "x1", "y1")
    return keyed.groupBy("page_id", "_t", "x0", "y0", "x1", "y1").agg(F.count("*").alias("n")).groupBy("page_id").agg((F.max("n") > 1).alias("overlay"))


def defect_sentences(defects: DataFrame) -> DataFrame:
    """What is wrong with each page's Markdown, in words (TXT25); from ``markdown_defects``. The sentences."""
    rows = F.when(F.col("misbound_rows") > 0, F.concat(F.col("misbound_rows").cast("string"), F.lit(" table row(s) put values printed on different lines into one row, attaching values to the wrong labels.")))
    words = F.when(F.col("missing_share") > K.MISSING_SHARE, F.concat(F.floor(F.col("missing_share") * 100 + 0.5).cast("string"), F.lit("% of its words do not occur in the PDF text (letters of neighbouring lines interleaved).")))
    cell = F.when(F.col("longest_cell") > K.CELL_WORDS, F.concat(F.lit("A table cell holds "), F.col("longest_cell").cast("string"), F.lit(" words: running text was swallowed into a table.")))
    return defects.select("page_id", F.array_compact(F.array(rows, words, cell)).alias("sentences"))


def tiered_sample(candidates: DataFrame, tiers: list[tuple[str, Column, list[Column], int]], size: int, fill: list[Column], *, per_document: int, per_document_fill: int, per_family: int) -> DataFrame:
    """A sample by tiers with caps by document and family, then filled up (SRT8): the rows with ``tier``.

    Each tier is (name, membership, order, quota). Who is taken depends on who was before, so the
    choice is a walk on the driver, over no more rows than it can need, whatever the table
    holds. Of a document, ``cap + size`` rows do: at most ``size`` are passed over since they were
    taken before. Of a family, those of ``per_family + size`` documents: each gives a row unless an
    earlier tier has used it up. In all, those of ``2 * size`` families. ``candidates``: key (unique),
    document, family.
    """
    picked: list[tuple] = []
    keys: set = set()
    documents: dict = {}
    families: dict = {}
    for name, member, order, quota in [*tiers, ("fill", F.lit(True), fill, size)]:
        cap = per_document_fill if name == "fill" else per_document
        of_document = cap + size
        of_family = (per_family + size) * of_document
        w = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order, "key"))  # noqa: B023, E731
        own = candidates.where(member).withColumn("_d", w("document")).where(F.col("_d") <= of_document).withColumn("_f", w("family")).where(F.col("_f") <= of_family)
        rows = own.orderBy(*order, "key").select("key", "document", "family").limit(2 * size * of_family).collect()
        taken = 0
        for r in rows:
            if taken >= quota or len(picked) >= size:
                break
            if r.key in keys or documents.get(r.document, 0) >= cap or families.get(r.family, 0) >= per_family:
                continue
            picked.append((r.key, name))
            keys.add(r.key)
            documents[r.document] = documents.get(r.document, 0) + 1
            families[r.family] = families.get(r.family, 0) + 1
            taken += 1
    kind = candidates.schema["key"].dataType.simpleString()
    chosen = candidates.sparkSession.createDataFrame(picked, f"key {kind}, tier string")
    return candidates.join(F.broadcast(chosen), "key")
