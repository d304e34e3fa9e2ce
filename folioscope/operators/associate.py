"""Association of embedded text with read text: a bucketed range join per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import geometry as G
from folioscope.functions import text as T


def _buckets(low: Column, high: Column, size: float, more: int = 0) -> Column:
    return F.sequence(F.floor(low / size) - more, F.floor(high / size) + more)


def candidates(native: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """What a reading may match: lines first, then single observations.

    ``candidate`` numbers them in that order within a page. An observation that is alone on its
    line would score as the line does and come after it, so it is left out. ``lines`` comes
    from ``native_lines``, whose members save a join.
    """
    member = lambda m: F.struct(m["x0"].alias("x0"), m["y0"].alias("y0"), m["x1"].alias("x1"), m["y1"].alias("y1"))
    item = lambda m: F.struct((m["ord"].cast("long") + ITEMS).alias("candidate"), F.lit("item").alias("kind"), F.array(m["id"]).alias("native_ids"), m["text"].alias("text"), m["x0"].alias("x0"), m["y0"].alias("y0"), m["x1"].alias("x1"), m["y1"].alias("y1"), F.array(member(m)).alias("members"))
    if lines is None:
        row = F.struct("ord", "id", "text", "x0", "y0", "x1", "y1")
        return native.select("page_id", row.alias("m")).select("page_id", item(F.col("m")).alias("c")).select("page_id", "c.*")
    line = F.struct(F.col("line").cast("long").alias("candidate"), F.lit("line").alias("kind"), F.col("source_ids").alias("native_ids"), F.col("text").alias("text"), "x0", "y0", "x1", "y1", F.transform("members", member).alias("members"))
    own = F.when(F.size("members") > 1, F.concat(F.array(line), F.transform("members", item))).otherwise(F.array(line))
    return lines.select("page_id", F.explode(own).alias("c")).select("page_id", "c.*")


#: Numbers of single observations begin here, those of lines at 0.
ITEMS = 10**10


def _prepared(df: DataFrame, prefix: str, text: str, fold: bool) -> DataFrame:
    """Adds all that comparisons need of a text, once a row: form, compact form, bag, tokens, letters."""
    df = df.withColumns({f"{prefix}form": T.evidence_text(F.col(text), fold=fold), f"{prefix}tokens": T.critical_tokens(F.col(text), fold=fold), f"{prefix}lettered": T.has_letter(F.col(text))})
    return df.withColumns({f"{prefix}{k}": c for k, c in T.similarity_forms(F.col(f"{prefix}form")).items()})


_O_BOX = {"x0": "o_x0", "y0": "o_y0", "x1": "o_x1", "y1": "o_y1"}
#: Bands that share a join key.
SPAN = 4


def scored_pairs(cands: DataFrame, ocr: DataFrame, *, scale: float = K.REFERENCE_SCALE, bucket: float | None = None, fold: bool = True) -> DataFrame:
    """Every reading with the candidates near it, and their scores (JOIN2).

    Near are those that share a horizontal band, the reading's side one band wider. Both sides
    are spread over spans of ``SPAN`` bands and meet by page and span: an equi join whose size
    follows the text, not pages squared, with little more than a row each. A pair is kept in the
    span of its first common band, which is ``band``. All that is made of one text is made
    before the join, and no text goes through it.
    """
    size = bucket or K.BUCKET_PT * scale
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / SPAN), F.floor(F.col(hi) / SPAN)))
    many = F.when(F.size("members") > 1, F.col("members")).alias("members")
    left = _prepared(cands.select("page_id", "candidate", "text", "x0", "y0", "x1", "y1", many), "n_", "text", fold).drop("text", "n_form")
    left = left.withColumns({"first": F.floor(F.col("y0") / size), "last": F.floor(F.col("y1") / size)}).withColumn("span", spans("first", "last"))
    right = ocr.select("page_id", F.col("id").alias("ocr_id"), F.col("ord").alias("ocr_ord"), "text", *[F.col(c).alias(n) for c, n in _O_BOX.items()], F.col("recovery_method").isNotNull().alias("recovered"))
    right = _prepared(right, "o_", "text", fold).drop("text", "o_form").withColumns({"o_first": F.floor(F.col("o_y0") / size) - 1, "o_last": F.floor(F.col("o_y1") / size) + 1}).withColumn("span", spans("o_first", "o_last"))
    band = F.greatest("first", "o_first")
    pairs = left.join(right, ["page_id", "span"]).where((band <= F.least("last", "o_last")) & (F.floor(band / SPAN) == F.col("span"))).withColumn("band", band)
    o = G.box("o_")
    of_many = F.array_max(F.transform("members", lambda m: G.overlap_over_smaller((m["x0"], m["y0"], m["x1"], m["y1"]), o)))
    geometric = F.when(F.col("members").isNotNull(), of_many).otherwise(G.overlap_over_smaller(G.box(), o))
    textual = T.similarity_of(*[F.col(f"{p}{k}") for k in ("compact", "bag") for p in ("n_", "o_")])
    pairs = pairs.withColumns({"geometric": geometric, "textual": textual})
    return pairs.withColumn("score", F.col("textual") * K.TEXT_WEIGHT + F.col("geometric") * K.GEOMETRY_WEIGHT)


def _packed(*parts: tuple[Column, int]) -> Column:
    """Numbers of so many digits each as one decimal, the first the weightiest: an order that fits
    into the fixed-width buffer of a hash aggregation, as a struct does not."""
    digits, out = 0, None
    for value, width in reversed(parts):
        part = F.floor(value).cast("decimal(18,0)")
        part = (part * F.lit(str(10**digits)).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)") if digits else part.cast("decimal(38,0)")
        out = part if out is None else (out + part).cast("decimal(38,0)")
        digits += width
    return out


_PLACE = 10**15 - 1


def verdicts(native: DataFrame, ocr: DataFrame, lines: DataFrame | None = None, *, scale: float = K.REFERENCE_SCALE, bucket: float | None = None, fold: bool = True) -> DataFrame:
    """One row per reading that matches or conflicts, by numbers only: ``page_id``, ``ocr_id``,
    ``ocr_ord``, ``verdict``, ``candidate``, ``textual``, ``geometric``, ``confidence``
    (JOIN2, JOIN3, WIN1, FLT4-FLT6).

    ``verdict`` is ``match``, ``critical-token-disagreement`` or ``critical-token-omission``. A
    conflict takes the place of the match; readings of a recovery pass never conflict. Scores
    that agree to nine digits are a tie; ties go to the candidate met first, by band, then in
    candidate order. A pair that can be neither a match nor a conflict goes before the
    aggregation, which carries fixed-width numbers only: partial hash aggregates, no sort.
    """
    pairs = scored_pairs(candidates(native, lines), ocr, scale=scale, bucket=bucket, fold=fold)
    digits = (F.size("o_tokens") > 0) & ~F.col("o_lettered")
    texted = (F.col("geometric") >= K.CONFLICT_GEOMETRY) & (F.col("textual") >= K.CONFLICT_TEXT)
    numbered = digits & (F.col("geometric") >= K.NUMERIC_GEOMETRY) & (F.size("n_tokens") == F.size("o_tokens")) & ~F.col("n_lettered")
    # the least score of a match; what scores less neither matches nor hides one that does
    useful = F.col("score") >= K.TEXT_WEIGHT * K.MATCH_TEXT + K.GEOMETRY_WEIGHT * K.MATCH_GEOMETRY - 1e-9
    pairs = pairs.withColumns({"texted": texted, "numbered": numbered}).where(useful | F.col("texted") | F.col("numbered"))
    place = F.lit(_PLACE) - ((F.col("band") - F.col("o_first")) * 10**11 + F.col("candidate"))
    share = lambda c, n: F.round(F.col(c) * 10.0**n)
    best = F.when(useful, _packed((share("score", 9), 10), (place, 15)))
    local = F.when(F.col("texted"), _packed((share("textual", 9), 10), (share("geometric", 9), 10), (place, 15))).when(F.col("numbered"), _packed((share("geometric", 9), 10), (place, 15)))
    some = (F.size("n_tokens") > 0) & (F.size("o_tokens") > 0)
    none = (F.size("n_tokens") == 0) & (F.size("o_tokens") == 0)
    # 0: the tokens agree, 1: they differ, 2: one side has none
    dispute = F.when(~(F.col("texted") | F.col("numbered")) | F.col("recovered") | none, 0).when(T.tokens_agree(F.col("n_tokens"), F.col("o_tokens")), 0).when(some, 1).otherwise(2)
    narrow = pairs.select("page_id", "ocr_id", "ocr_ord", "textual", "geometric", "score", best.alias("best"), local.alias("local"), dispute.alias("dispute"), "candidate")
    by = lambda c, key: F.max_by(c, key).alias(f"{key}_{c}")
    chosen = narrow.groupBy("page_id", "ocr_id").agg(F.max("ocr_ord").alias("ocr_ord"), *[by(c, k) for k in ("best", "local") for c in ("textual", "geometric", "score", "candidate")], by("dispute", "local"))
    conflict = F.coalesce(F.col("local_dispute"), F.lit(0)) > 0
    matched = (F.col("best_textual") >= K.MATCH_TEXT) & (F.col("best_geometric") >= K.MATCH_GEOMETRY)
    verdict = F.when(conflict, F.when(F.col("local_dispute") == 1, "critical-token-disagreement").otherwise("critical-token-omission")).when(matched, "match")
    side = lambda c: F.when(conflict, F.col(f"local_{c}")).otherwise(F.col(f"best_{c}")).alias(c)
    return chosen.withColumn("verdict", verdict).where("verdict is not null").select("page_id", "ocr_id", "ocr_ord", "verdict", side("candidate"), side("textual"), side("geometric"), side("score")).withColumn("confidence", F.least(F.lit(1.0), F.col("score"))).drop("score")


def associate(native: DataFrame, ocr: DataFrame, lines: DataFrame | None = None, *, scale: float = K.REFERENCE_SCALE, bucket: float | None = None, fold: bool = True, texts: bool = True) -> DataFrame:
    """``verdicts`` with the chosen candidate's kind and sources and, with ``texts``, both sides' texts
    and critical tokens, which are joined back to the chosen rows only."""
    v = verdicts(native, ocr, lines, scale=scale, bucket=bucket, fold=fold)
    keep = ["kind", "native_ids", *(["text"] if texts else [])]
    df = v.join(candidates(native, lines).select("page_id", "candidate", *keep), ["page_id", "candidate"])
    if not texts:
        return df.select("page_id", "ocr_id", "ocr_ord", "verdict", "kind", "native_ids", "textual", "geometric", "confidence")
    df = df.join(ocr.select("page_id", F.col("id").alias("ocr_id"), F.col("text").alias("ocr_text")), ["page_id", "ocr_id"])
    shown = lambda c: F.transform(T.critical_tokens(F.col(c), fold=fold), T.token_text)
    return df.select(
        "page_id", "ocr_id", "ocr_ord", "verdict", "kind", "native_ids", F.col("text").alias("native_text"), "ocr_text",
        shown("text").alias("native_tokens"), shown("ocr_text").alias("ocr_tokens"), "textual", "geometric", "confidence",
    )


def unique_key_join(left: DataFrame, right: DataFrame, key: str, page: str = "page_id") -> DataFrame:
    """Left join on a text key that must be unique on both sides of a page (JOIN1)."""
    w = Window.partitionBy(page, key)
    l = left.withColumn("_n", F.count("*").over(w))
    r = right.withColumn("_m", F.count("*").over(w)).where("_m = 1").drop("_m")
    return l.join(r.withColumn("_r", F.lit(1)), [page, key], "left").transform(lambda d: d.select(*[F.when((F.col("_n") == 1) | F.lit(c in left.columns), F.col(c)).alias(c) for c in d.columns if c not in ("_n", "_r")]))


def attribute_to_regions(readings: DataFrame, regions: DataFrame) -> DataFrame:
    """Each reading to the region it overlaps most; the first region wins ties (JOIN7).

    Regions of a page are few; both sides meet by page.
    """
    r = regions.select("page_id", "region", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = readings.select("page_id", "id", "x0", "y0", "x1", "y1").join(r, "page_id").withColumn("shared", G.intersection(G.box(), G.box("r_"))).where("shared > 0")
    return pairs.groupBy("page_id", "id").agg(F.min_by("region", F.struct(-F.col("shared"), F.col("region"))).alias("region"), F.max("shared").alias("shared"))


def coverage(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """How much of each observation's box first-pass readings cover, 1 at most, and what they
    read there in order (JOIN9)."""
    o = ocr.where("recovery_method is null").select("page_id", F.col("id").alias("ocr_id"), F.col("text").alias("ocr_text"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    size = K.BUCKET_PT * K.REFERENCE_SCALE
    n = native.withColumn("band", F.explode(_buckets(F.col("y0"), F.col("y1"), size)))
    o = o.withColumn("o_band", F.floor(F.col("o_y0") / size)).withColumn("band", F.explode(_buckets(F.col("o_y0"), F.col("o_y1"), size)))
    pairs = n.join(o, ["page_id", "band"]).where(F.col("band") == F.greatest(F.floor(F.col("y0") / size), F.col("o_band"))).withColumn("shared", G.intersection(G.box(), G.box("o_"))).where("shared > 0")
    read = F.array_sort(F.collect_list(F.struct("o_y0", "o_x0", "ocr_id", "ocr_text")))
    return pairs.groupBy("page_id", "id").agg(F.least(F.lit(1.0), F.sum("shared") / F.first(G.area(G.box()))).alias("covered"), F.array_join(F.transform(read, lambda x: x["ocr_text"]), "").alias("read"))


def duplicate_evidence(recovered: DataFrame, known: DataFrame, *, overlap: float = K.DUPLICATE_OVERLAP, similar: float = K.MATCH_TEXT) -> DataFrame:
    """First known reading that a recovered one repeats (JOIN8, WIN3): half of its own box is
    shared, the texts are similar, the tokens agree."""
    return repeated_readings(recovered, known, overlap=overlap, similar=similar).groupBy("page_id", "id").agg(F.min("k_ord").alias("duplicate_of"))


def repeated_readings(recovered: DataFrame, known: DataFrame, *, overlap: float = K.DUPLICATE_OVERLAP, similar: float = K.MATCH_TEXT) -> DataFrame:
    """Every known reading that a recovered one may repeat: ``page_id``, ``id``, ``k_ord``."""
    forms = lambda p: {f"{p}form": T.evidence_text(F.col("text")), f"{p}tokens": T.critical_tokens(F.col("text"))}
    k = known.withColumns(forms("k_")).select("page_id", F.col("ord").alias("k_ord"), "k_form", "k_tokens", *[F.col(c).alias(f"k_{c}") for c in ("x0", "y0", "x1", "y1")])
    own = G.area(G.box())
    pairs = recovered.withColumns(forms("r_")).join(k, "page_id").where((own > 0) & (G.intersection(G.box(), G.box("k_")) / own >= overlap))
    return pairs.where((T.similarity(F.col("r_form"), F.col("k_form")) >= similar) & T.tokens_agree(F.col("r_tokens"), F.col("k_tokens"))).select("page_id", "id", "k_ord")
