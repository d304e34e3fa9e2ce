"""Reports over runs: outcomes, latencies, routing decisions, comparisons of plans and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import numbers as N
from folioscope.functions import text as T


def _disc(c: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p05 to p95 by nearest rank (NUM5)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[_disc(value, q).alias(f"p{int(100 * q):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)])


def baseline_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes, sums and latency of a run (AGG13). ``pages``: status, failure_class, ms, and the
    counters ``native``, ``ocr``, ``matches``, ``conflicts``."""
    ok = F.col("status") == "success"
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        *[F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("long").alias(c) for c in ("native", "ocr", "matches", "conflicts")],
        _disc("CASE WHEN status = 'success' THEN ms END", 0.5).alias("p50_ms"), _disc("CASE WHEN status = 'success' THEN ms END", 0.95).alias("p95_ms"),
        F.round(F.sum(F.when(ok, F.col("matches"))) / F.sum(F.when(ok, F.col("ocr"))), 6).alias("coverage"),
    )


def failure_groups(pages: DataFrame) -> DataFrame:
    """Failed pages by class, with the first example (AGG13, FLT18)."""
    from folioscope.operators.evaluate import failure_class

    return pages.where("status <> 'success'").withColumn("class", failure_class(F.col("message"), F.col("status"), F.col("stage"))).groupBy("class").agg(F.count("*").alias("pages"), F.min("message").alias("example"))


def run_reconciliation(expected: DataFrame, captures: DataFrame) -> DataFrame:
    """One row per request of the manifest or the captures (AGG27): ``state`` is missing, unexpected,
    duplicate or ok, with the number of terminal outputs.

    ``captures``: request_id, kind (result or exception). Both sides are counted in one
    aggregation, so a request that was tried often is no larger row.
    """
    both = expected.select("request_id", F.lit(1).alias("_e"), F.lit(0).alias("_c"), F.lit(None).cast("string").alias("kind")).unionByName(captures.select("request_id", F.lit(0).alias("_e"), F.lit(1).alias("_c"), "kind"))
    sums = both.groupBy("request_id").agg(F.max("_e").alias("wanted"), F.sum("_c").alias("outputs"), F.count_if(F.col("kind") == "result").alias("results"), F.count_if(F.col("kind") == "exception").alias("exceptions"))
    state = F.when(F.col("outputs") == 0, "missing").when(F.col("wanted") == 0, "unexpected").when(F.col("outputs") > 1, "duplicate").otherwise("ok")
    return sums.select("request_id", state.alias("state"), F.col("outputs").cast("long").alias("outputs"), "results", "exceptions")


def run_totals(captures: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row (AGG27): captures by outcome, requests missing, unexpected or repeated, pages, completion
    times by linear interpolation and pages a second over the window of the run.

    ``captures``: request_id, kind, status (completed or failed), error, pages_ok,
    pages_failed, spawned_ms, result_ms.
    """
    result = F.col("kind") == "result"
    rejected = (F.col("kind") == "exception") & F.col("error").rlike("InputRejected|rejected")
    wall = F.when(F.col("spawned_ms").isNotNull() & F.col("result_ms").isNotNull(), F.col("result_ms") - F.col("spawned_ms"))
    done = F.when(result, F.coalesce("pages_ok", F.lit(0)) + F.coalesce("pages_failed", F.lit(0)))
    sums = captures.agg(
        F.count("*").alias("captured"), F.count_if(result & (F.col("status") == "completed")).alias("completed"), F.count_if(result & (F.col("status") == "failed")).alias("failed"),
        F.count_if(rejected).alias("rejected"), F.count_if((F.col("kind") == "exception") & ~rejected).alias("other_exceptions"),
        F.coalesce(F.sum(F.when(result, F.col("pages_ok"))), F.lit(0)).cast("long").alias("pages_ok"), F.coalesce(F.sum(done), F.lit(0)).cast("long").alias("_pages"),
        N.percentile_linear(wall, 0.5).alias("p50_ms"), N.percentile_linear(wall, 0.95).alias("p95_ms"),
        (F.max("result_ms") - F.min("spawned_ms")).alias("window_ms"),
    )
    ids = reconciled.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("missing", "unexpected")], F.count_if(F.col("outputs") > 1).alias("duplicates"))
    return sums.join(F.broadcast(ids)).withColumn("pages_per_second", F.when(F.col("window_ms") > 0, F.round(F.col("_pages") / (F.col("window_ms") / 1000), 6))).drop("_pages")


def failure_classes(captures: DataFrame) -> DataFrame:
    """Failed results by the class they give (AGG27)."""
    return captures.where("kind = 'result' and status = 'failed'").groupBy(F.coalesce("failure_class", F.lit("unknown")).alias("failure_class")).agg(F.count("*").alias("results"))


def start_latency(captures: DataFrame) -> DataFrame:
    """Method time of results from cold and from warm containers (AGG27)."""
    timed = captures.where("kind = 'result' and total_method_ms is not null")
    start = F.when(F.col("container_cold"), "cold").otherwise("warm")
    return timed.groupBy(start.alias("start")).agg(F.count("*").alias("results"), F.round(N.percentile_linear(F.col("total_method_ms"), 0.5), 6).alias("p50_ms"), F.round(N.percentile_linear(F.col("total_method_ms"), 0.95), 6).alias("p95_ms"), F.max("total_method_ms").alias("max_ms"))


def container_spans(events: DataFrame, key: str, at: str) -> DataFrame:
    """First and last event of each container (WIN7)."""
    return events.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))


def manifest_distributions(pages: DataFrame) -> DataFrame:
    """Pages by label (AGG28); ``pages`` has objectId and labels."""
    return pages.select("objectId", F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("pages"), F.count_distinct("objectId").alias("documents"))


#: Characters of embedded text from which a page counts as having a native layer.
LEAST_NATIVE_CHARS = 200


def selective_decision(observations: DataFrame, least_covered: float = 0.6) -> DataFrame:
    """Whether a reading may be skipped and why not (FLT12), the first reason that holds.

    ``covered``: share of its box under embedded text; ``native_text``: what touches the box,
    whole lines; ``native_chars``: embedded text of the page; ``recovery_method``. The last two
    may be absent. Fixed values: the reasons.
    """
    recovered = F.col("recovery_method").isNotNull() if "recovery_method" in observations.columns else F.lit(False)
    bare = F.col("native_chars") < LEAST_NATIVE_CHARS if "native_chars" in observations.columns else F.lit(False)
    why = F.when(recovered, "recovery-pass").when(bare, "no-native-layer").when(F.col("covered") < least_covered, "not-native-covered").when(T.is_numeric(F.col("native_text")), "native-has-digit").when(T.is_suspicious(F.col("native_text")), "native-suspicious").otherwise("skip")
    return observations.withColumn("decision", why)


def skip_shares(decided: DataFrame, text: str = "native_text") -> DataFrame:
    """Share of each decision, by count and by length (AGG35)."""
    sums = decided.groupBy("decision").agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    total = sums.agg(F.sum("n").alias("_n"), F.sum("chars").alias("_c"))
    return sums.join(F.broadcast(total)).select("decision", "n", "chars", N.rate(F.col("n"), F.col("_n")).alias("share"), N.rate(F.col("chars"), F.col("_c")).alias("char_share"))


def route_recognizer(score: Column, text: Column, least: float = 0.9) -> Column:
    """Which recogniser's reading to take (FLT13): the reference's for low scores, CJK and digits."""
    return F.when((score < least) | text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}0-9]"), "reference").otherwise("fast")


def stratum(reasons: Column) -> Column:
    """clean, conflict or escalated-other (FLT17), from an array of ``struct(type, severity)``; advisory
    reasons don't count."""
    blocking = F.filter(reasons, lambda r: r["severity"] == "blocking")
    return F.when(F.size(blocking) == 0, "clean").when(F.exists(blocking, lambda r: r["type"].isin("critical-token-conflict", "critical-token-omission")), "conflict").otherwise("escalated-other")


def page_class(conflicts: Column, escalates: Column) -> Column:
    """Class by which pages are drawn for a second label (SRT10)."""
    return F.when(conflicts > 0, "conflict").when(escalates, "escalated").otherwise("clean")


def tier_report(scored: DataFrame) -> DataFrame:
    """Recall by label tier (AGG16): ``tier``, ``tokens``, ``matched``; a tier without tokens has no rate."""
    return scored.groupBy("tier").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("matched").cast("long").alias("matched")).withColumn("recall", N.rate(F.col("matched"), F.col("tokens")))


def verdict_composition(verdicts: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """How often each verdict was given, and its share of the key (AGG17, AGG18)."""
    n = verdicts.groupBy(*keys, verdict).agg(F.count("*").alias("n"))
    return n.withColumn("share", N.rate(F.col("n"), F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))))


def stage_decision(stages: DataFrame, total: str, part: str = "covered", least: float = 0.2, most: float = 0.7) -> DataFrame:
    """Share of a stage in the whole and what follows (AGG37)."""
    share = F.try_divide(F.col(part).cast("double"), F.col(total))
    return stages.withColumn("share", F.round(share, 6)).withColumn("decision", F.when(share >= most, "dominant").when(share >= least, "candidate").otherwise("minor"))


def box_provenance(tokens: DataFrame) -> DataFrame:
    """Tokens by where their box comes from (AGG38)."""
    return tokens.groupBy(F.coalesce("box_source", F.lit("none")).alias("box_source")).agg(F.count("*").alias("tokens"))


def plan_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages whose plans differ (JOIN35): sets of rungs in any order, and pages of one side only."""
    l, r = a.select("page_id", F.array_sort("rungs").alias("ra")), b.select("page_id", F.array_sort("rungs").alias("rb"))
    state = F.when(F.col("ra").isNull(), "only_right").when(F.col("rb").isNull(), "only_left").when(F.col("ra") == F.col("rb"), "same").otherwise("different")
    return l.join(r, "page_id", "full_outer").select("page_id", state.alias("state"))


def repeat_pairs(captures: DataFrame) -> DataFrame:
    """The first two captures of each request, side by side (JOIN36); requests with one have a null."""
    w = Window.partitionBy("request_id").orderBy("result_ms")
    n = captures.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    return n.groupBy("request_id").agg(F.max(F.when(F.col("_n") == 1, F.col("digest"))).alias("first"), F.max(F.when(F.col("_n") == 2, F.col("digest"))).alias("second"))


def attempts_of_jobs(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Jobs with their attempts, jobs without one too (JOIN25, JOIN26)."""
    return jobs.select("job_id", "tenant", F.col("state").alias("job_state")).join(attempts, "job_id", "left")


# Labels that a note's words give, as (label, expression).
WORD_LABELS = (
    ("dense-table", r"\btables?\b|\bfinancial statements?\b|\bfinancial data\b|\bforms?\b|\bfields?\b"),
    ("chart", r"\bcharts?\b|\bgraphs?\b|\bfigures?\b|\bkpi\b|\bvisuali[sz]ations?\b"),
    ("multi-column", r"\bmulti-column\b|\btwo-column\b|\bacademic paper\b|\bannual report\b|\bintegrated report\b"),
    ("form", r"\bforms?\b|\bcheckbox(?:es)?\b|\bfields?\b"),
    ("multilingual", r"\bbilingual\b|\bmultilingual\b|\bjapanese\b|\bpolish\b|\bindonesian\b"),
)


def corpus_labels(notes: Column, path: Column, page_count: Column, images: Column, image_only: Column, *, multilingual: Column | None = None, sibling: Column | None = None) -> Column:
    """Labels of a document from its notes and counts (FLT19), in the vocabulary's order.

    ``multilingual`` marks documents known to be so, ``sibling`` gives the label of a family
    member or null. ``notes`` are expected in compatibility form.
    """
    text = F.lower(F.coalesce(notes, F.lit("")))
    only, no = F.coalesce(image_only, F.lit(False)), F.lit(False)
    by_word = {label: text.rlike(words) for label, words in WORD_LABELS}
    by_word["multilingual"] = by_word["multilingual"] | F.coalesce(multilingual if multilingual is not None else no, no)
    rules = [
        ("native-text", ~only), ("image-only", only), ("mixed-raster-native", ~only & (F.coalesce(images, F.lit(0)) > 0)),
        *[(label, by_word[label]) for label in ("dense-table", "chart", "multi-column", "form", "multilingual")],
        ("slides", F.concat_ws(" ", F.lower(path), text).rlike("presentation|slide|deck")),
        ("long-document", F.coalesce(page_count >= 100, no)), ("landscape", F.contains(text, F.lit("landscape"))), ("sparse-overlay", text.rlike("sparse overlay|near-image-only|image-dominant")),
    ]
    return F.array_compact(F.array(*[F.when(holds, label) for label, holds in rules], sibling if sibling is not None else F.lit(None).cast("string")))
