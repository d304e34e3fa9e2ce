"""Queries over the driver's tables and the same in SQL.

Each entry of ``QUERIES`` takes (spark, folder) and returns a DataFrame; ``SQL`` holds the
equivalent for DuckDB. Names of result columns are equal in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import numbers as N
from folioscope.functions import text as T
from folioscope.operators import associate as A
from folioscope.operators import diagnostics as D
from folioscope.operators import evaluate as E
from folioscope.operators import glyphs as Gl
from folioscope.operators import grouping as Gr
from folioscope.operators import intervals as I
from folioscope.operators import jobs as J
from folioscope.operators import retrieval as R
from folioscope.sources import ledger as L
from folioscope.streaming import stateful as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark, d, mixed=False):
    rows = L.lines(spark, d)
    return rows, *((L.mixed_native(rows), L.mixed_ocr(rows)) if mixed else (L.native(rows), L.ocr(rows)))


def _verdicts(spark, d, mixed=False):
    """Embedded text, readings, and what they are to each other, by numbers and sources only."""
    _, native, ocr = _pages(spark, d, mixed)
    return native, ocr, A.associate(native, ocr, Gr.native_lines(native).persist(), fold=False, texts=False)


def _diagnostics(spark, d, mixed=False):
    native, ocr, verdicts = _verdicts(spark, d, mixed)
    counts = native.groupBy("page_id").agg(F.count("*").alias("native_count"))
    pages = ocr.select("page_id").distinct().join(counts, "page_id", "full_outer").withColumn("native_count", F.coalesce("native_count", F.lit(0).cast("long")))
    return D.page_diagnostics(ocr, verdicts, pages)


def association(spark, d, mixed=False):
    _, native, ocr = _pages(spark, d, mixed)
    v = A.verdicts(native, ocr, Gr.native_lines(native), fold=False)
    return v.select("page_id", "ocr_ord", "verdict", F.round("textual", 6).alias("textual"), F.round("geometric", 6).alias("geometric"))


def mixed_association(spark, d):
    """The same on pages whose lines cross, are cut, or hold bare numbers."""
    return association(spark, d, True)


def page_conflicts(spark, d):
    _, native, ocr = _pages(spark, d)
    v = A.verdicts(native, ocr, Gr.native_lines(native), fold=False)
    return v.where("verdict like 'critical-%'").groupBy("page_id").agg(F.count("*").alias("conflicts"))


def page_diagnostics(spark, d, mixed=False):
    return _diagnostics(spark, d, mixed).select("page_id", "native_count", "ocr_count", "recovered_count", "match_count", "unmatched_count", "conflict_count", "omission_count", "low_count", F.round("coverage", 6).alias("coverage"), "escalates")


def mixed_diagnostics(spark, d):
    return page_diagnostics(spark, d, True)


def escalation_reasons(spark, d, mixed=False):
    return D.escalation_reasons(_diagnostics(spark, d, mixed)).select("page_id", "type", "severity", "count", F.round("share", 6).alias("share"), F.size("source_ids").cast("long").alias("sources"))


def mixed_reasons(spark, d):
    return escalation_reasons(spark, d, True)


def document_diagnostics(spark, d):
    pages = _diagnostics(spark, d).withColumn("document_id", F.floor(F.col("page_id") / 100))
    return D.document_diagnostics(pages).select("document_id", "pages", "ocr_count", "match_count", "conflict_count", "low_count", "escalating_pages", "blocking_pages")


def native_lines(spark, d):
    _, native, _ = _pages(spark, d)
    return Gr.native_lines(native).select("page_id", F.col("line").cast("long").alias("line"), "text", "y0")


def spatial_rows(spark, d):
    _, _, ocr = _pages(spark, d)
    return Gr.spatial_rows(ocr).select("page_id", F.col("row").cast("long").alias("row"), "text", F.round("confidence", 6).alias("confidence"))


def _crossed(spark, d):
    """Every embedded item of a mixed page beside every reading within sixteen pixels of its top."""
    _, native, ocr = _pages(spark, d, True)
    o = ocr.select("page_id", F.col("ord").alias("o_ord"), F.col("text").alias("read"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    return native.join(o, "page_id").where(F.abs(F.col("y0") - F.col("o_y0")) <= 16)


def geometry_scores(spark, d):
    return _crossed(spark, d).select("page_id", F.col("ord").cast("long").alias("ord"), F.col("o_ord").cast("long").alias("o_ord"), F.round(G.iou(G.box(), G.box("o_")), 6).alias("iou"), F.round(G.overlap_over_smaller(G.box(), G.box("o_")), 6).alias("overlap"))


def similarity(spark, d):
    pair = _crossed(spark, d).withColumns({c: T.evidence_text(F.col(c), fold=False) for c in ("text", "read")})
    return pair.select("page_id", F.col("ord").cast("long").alias("ord"), F.col("o_ord").cast("long").alias("o_ord"), F.round(T.similarity(F.col("text"), F.col("read")), 6).alias("similarity"))


def occurrence_index(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


def token_counts(spark, d):
    return E.token_counts(_t(spark, d, "documents"), ["doc_id"])


def _page_tokens(spark, d):
    _, native, ocr = _pages(spark, d)
    return E.token_difference(E.token_counts(native, ["page_id"]), E.token_counts(ocr, ["page_id"]), ["page_id"])


def token_difference(spark, d):
    return _page_tokens(spark, d).where("missing > 0 or unexpected > 0").select("page_id", "token", "missing", "unexpected")


def token_scores(spark, d):
    return E.token_scores(_page_tokens(spark, d), ["page_id"]).select("page_id", "shared", "missing", "unexpected", "recall", "precision")


def _chunked(spark, d):
    return R.chunks(_t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


def _questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(T.retrieval_terms(F.col("text")))).alias("term"))


def chunk_terms(spark, d):
    return R.postings(_chunked(spark, d), ["page_id", "chunk"]).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, d):
    ranked = R.bm25(_chunked(spark, d), _questions(spark, d), ["page_id", "chunk"])
    return ranked.select("query", "page_id", F.col("chunk").cast("long").alias("chunk"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def hit_at_k(spark, d):
    """A chunk is relevant if its document holds the passage, every white space read as one space."""
    q = _questions(spark, d)
    ranked = R.bm25(_chunked(spark, d), q, ["page_id", "chunk"])
    plain = lambda c: F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), plain(F.col("text")).alias("passage"))
    # only the documents that a query ranks are looked at: ten a query at most
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("page_id"), plain(F.coalesce("text", F.lit(""))).alias("body"))
    relevant = ranked.select("query", "page_id").distinct().join(docs, "page_id").join(items, "query").where(F.contains("body", F.col("passage"))).select("query", "page_id")
    return R.hit_table(R.first_relevant(ranked, relevant, ["query", "page_id"]), q)


def dedup_union(spark, d):
    _, native, ocr = _pages(spark, d)
    return R.deduplicated_text(native, ocr).groupBy("page_id", "source").agg(F.count("*").alias("rows"))


def unmatched_union(spark, d):
    native, ocr, v = _verdicts(spark, d)
    return R.unmatched_text(native, ocr, v).groupBy("page_id", "source").agg(F.count("*").alias("rows"))


def agreed_words(spark, d):
    _, native, ocr = _pages(spark, d)
    return R.agreed_words(native, ocr).groupBy("page_id").agg(F.count("*").alias("words"))


def _jobs(spark, d):
    """Orders as jobs: finished ones succeeded, partly delivered ones failed, open ones in the three active states."""
    key = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").when(key % 3 == 0, "uploading").when(key % 3 == 1, "queued").otherwise("dispatched")
    made = F.col("o_orderdate").cast("timestamp")
    done = F.col("state") == "succeeded"
    df = _t(spark, d, "orders").select(key.alias("job_id"), F.col("o_custkey").alias("tenant"), state.alias("state"), made.alias("created_at"), (made + F.when(key % 97 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 1 hour"))).alias("upload_expires_at"))
    key = F.col("job_id")
    return df.withColumns({
        "queued_at": F.when(F.col("state") != "uploading", F.col("created_at") + F.expr("interval 10 minutes")), "completed_at": F.when(F.col("state").isin("succeeded", "failed"), F.col("created_at") + F.expr("interval 1 day")),
        "pages_actual": F.when(done, key % 200 + 1), "reserved_pages": F.when(key % 89 == 0, 50).otherwise(200).cast("long"), "estimated_cost_micros": F.when(done, (key % 200 + 1) * 1000),
        "failure_code": F.when(F.col("state") == "failed", F.when(key % 83 == 0, None).when(key % 79 == 0, "exploded").otherwise("invalid_pdf")),
        "accepted_attempt_id": F.when(done, key * 1000 + 1), "retention_expires_at": F.when(done & (key % 73 != 0), F.col("created_at") + F.expr("interval 3 days")),
        "idempotency_key": F.concat(F.lit("k"), (key % 5).cast("string")), "input_digest": F.sha2((key % 7).cast("string"), 256),
    })


def _attempts(spark, d):
    """Line items as attempts; all but an order's first replace the first."""
    w = Window.partitionBy("l_orderkey").orderBy(*L.ORDER)
    nth, line = F.col("nth"), F.col("l_linenumber")
    open_ = F.when(line % 3 == 0, "dispatching").when(line % 3 == 1, "dispatch_unknown").otherwise("dispatched")
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "succeeded").otherwise(open_)
    code = F.element_at(F.array(*[F.lit(c) for c in ("processing_failed", "dispatch_failed", "invalid_pdf", "page_limit_exceeded", "input_digest_mismatch")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    df = _t(spark, d, "lineitem").withColumn("nth", F.row_number().over(w).cast("long")).select(F.col("l_orderkey").alias("job_id"), (F.col("l_orderkey") * 1000 + nth).alias("attempt_id"), state.alias("state"), F.col("l_shipdate").cast("timestamp").alias("created_at"), code.alias("_c"), "nth", "l_partkey")
    ended = F.col("state").isin("failed", "succeeded")
    return df.select(
        "job_id", "attempt_id", "state", "created_at", F.when(ended, F.col("created_at") + F.expr("interval 1 day")).alias("completed_at"), F.when(F.col("state") == "failed", F.col("_c")).alias("failure_code"),
        F.when(F.col("state") != "dispatching", F.when(F.col("l_partkey") % 101 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("attempt_id").cast("string")))).alias("call_id"),
        F.when(nth > 1, F.col("job_id") * 1000 + 1).alias("replaces_attempt_id"), (F.col("created_at") + F.expr("interval 1 minute")).alias("reconcile_after"),
    )


def _grants(spark, d):
    return _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("tenant"), F.floor("c_acctbal").alias("pages"))


#: A time in the middle of the tables' dates.
NOON = "1995-06-01 12:00:00"


def jobs_page(spark, d):
    return J.jobs_page(J.jobs_where(_jobs(spark, d), state="active", date="all"), 2).select("job_id", "tenant", "state", "reserved_pages")


def jobs_counts(spark, d):
    return J.page_counts(J.jobs_where(_jobs(spark, d), state="failed", date="30d", now=NOON))


def jobs_summary(spark, d):
    return J.jobs_summary(J.jobs_where(_jobs(spark, d), date="all"), ["tenant"])


def job_views(spark, d):
    return J.job_view(_jobs(spark, d)).select("id", "state", "pages", "page_limit", "error_code", F.date_diff("processing_deadline_at", "queued_at").cast("long").alias("deadline_days"))


def date_headings(spark, d):
    return J.date_groups(_jobs(spark, d), NOON).where("heading is not null").select("tenant", "job_id", "heading")


def credit_summary(spark, d):
    return J.credit_summary(_grants(spark, d), _jobs(spark, d))


def usage_days(spark, d):
    return J.usage_days(_jobs(spark, d), "1996-01-01 00:00:00")


def admission_counts(spark, d):
    return J.admission_counts(_jobs(spark, d))


def admission(spark, d):
    """A request for every order, its key sent again, sent again with another input, or new; decided once when
    nothing is active and once against all jobs."""
    jobs = _jobs(spark, d).withColumn("idempotency_key", F.concat(F.lit("q"), F.col("job_id").cast("string")))
    key = F.col("job_id") % 3
    r = jobs.select("tenant", F.when(key == 2, F.concat(F.lit("new"), F.col("job_id").cast("string"))).otherwise(F.col("idempotency_key")).alias("idempotency_key"), F.sha2((F.col("job_id") % 7 + F.when(key == 1, 1).otherwise(0)).cast("string"), 256).alias("input_digest"))
    idle = J.admit(r, jobs.where("state in ('succeeded', 'failed')"), _grants(spark, d)).withColumn("phase", F.lit("idle"))
    busy = J.admit(r, jobs, _grants(spark, d)).withColumn("phase", F.lit("busy"))
    return idle.unionByName(busy).groupBy("phase", "verdict").agg(F.count("*").alias("requests"), F.sum("reserved_pages").alias("pages"))


def queued_antijoin(spark, d):
    return J.queued_without_attempt(_jobs(spark, d), _attempts(spark, d)).select("job_id", "tenant")


def exhausted_jobs(spark, d):
    return J.exhausted_jobs(_jobs(spark, d), _attempts(spark, d))


def failure_codes(spark, d):
    return J.failure_of(_attempts(spark, d))


def winning_attempt(spark, d):
    """Every open attempt reports, in order of its creation: which report is recorded, and which wins."""
    a = _attempts(spark, d)
    return J.accept_attempts(_jobs(spark, d), a, a.select("job_id", "attempt_id", F.col("created_at").alias("arrival"))).where("recorded").select("job_id", "attempt_id", "won")


def late_jobs(spark, d):
    jobs, attempts = J.deadline_sweep(_jobs(spark, d), _attempts(spark, d), NOON)
    return jobs.groupBy("failure_code").agg(F.count("*").alias("jobs")).join(attempts.groupBy("failure_code").agg(F.count("*").alias("attempts")), "failure_code", "full_outer")


def reconciliation(spark, d):
    """What is done with each open attempt, by what the other side says (by supplier) and what is stored (by part)."""
    a = _attempts(spark, d)
    key = F.col("attempt_id")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("pending", "completed", "invalid", "failed", "unavailable")]), (key % 5 + 1).cast("int"))
    found = J.reconcile_decisions(a, a.select("attempt_id", outcome.alias("outcome")), a.where("attempt_id % 4 = 0").select("attempt_id"), NOON)
    return found.groupBy("decision").agg(F.count("*").alias("attempts"))


def running_budget(spark, d):
    requests = _jobs(spark, d)
    return J.running_budget(requests, ["tenant"], ["created_at", "job_id"], "reserved_pages", 500).groupBy("tenant").agg(F.count("*").alias("jobs"), F.max("spent").alias("spent"))


def backfill_grants(spark, d):
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("tenant"))
    return J.backfill_grants(users, _jobs(spark, d), _grants(spark, d))


def invariant_violations(spark, d):
    return J.invariant_violations(_jobs(spark, d), _attempts(spark, d)).groupBy("rule").agg(F.count("*").alias("rows"))


def _spans(spark, d):
    day = F.unix_date(F.to_date("ts")).cast("long") * 86_400_000
    ms = (F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000)).cast("long")
    start = day.cast("long") + ms
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", start.alias("start"), (start + F.floor(F.abs("value") * 1000) + 1).alias("stop"))


def stage_metrics(spark, d):
    return S.stage_summary(_t(spark, d, "events"), "event_type", "value").withColumnRenamed("stage", "event_type")


def floor_percentile(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(N.percentile_floor(F.col("value"), 0.5).alias("p50"), N.percentile_nearest(F.col("value"), 0.5).alias("p50_nearest"))


def latest_samples(spark, d):
    return Gl.latest_samples(_t(spark, d, "events"), ["event_type"], ["ts", "event_id"], 500).groupBy("event_type").agg(F.count("*").alias("samples"), F.min("event_id").alias("least_id"))


def interval_union(spark, d):
    return I.merge_intervals(_spans(spark, d), ["user_id"]).select("user_id", "start", "stop", "parts")


def covered_duration(spark, d):
    return I.covered_duration(_spans(spark, d), ["event_type"])


def max_concurrency(spark, d):
    return I.max_concurrency(_spans(spark, d), ["event_type"])


def interval_intersections(spark, d):
    s = _spans(spark, d)
    return I.intersections(s.where("event_type = 'click'"), s.where("event_type = 'view'"), ["user_id"], width=600_000).groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum(F.expr("stop - start")).alias("shared"))


def reconcile_two_sided(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    seen = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return E.two_sided_reconciliation(orders, seen, "id")


def paired_cells(spark, d):
    df = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return E.paired_cells(df, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


def label_agreement(spark, d):
    df = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return E.agreement_by(df, ["source"], "quality", "toxic")


def failure_groups(spark, d):
    """Failed pages by class: messages, states and stages put together from the parts table."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("page is Rotated by 90", "box Outside of page", "out-of-bounds run", "no answer", None)]), (F.col("p_partkey") % 5 + 1).cast("int"))
    status = F.element_at(F.array(F.lit("failed"), F.lit("timed_out"), F.lit("aborted")), (F.col("p_partkey") % 3 + 1).cast("int"))
    stage = F.when(F.col("p_size") % 4 == 0, None).otherwise(F.concat(F.lit("stage-"), (F.col("p_size") % 4).cast("string")))
    pages = _t(spark, d, "part").select(text.alias("message"), status.alias("status"), stage.alias("stage"))
    return pages.groupBy(E.failure_class(F.col("message"), F.col("status"), F.col("stage")).alias("class")).agg(F.count("*").alias("pages"))


def sample_quotas(spark, d):
    sizes = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("size"))
    return E.largest_remainder(sizes, 97)


def event_props(spark, d):
    """Structured fields harvested from JSON texts, malformed ones counted (SRC21, SRC25)."""
    df = _t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return df.groupBy("event_type").agg(F.count("k").alias("parsed"), F.sum("k").alias("total"))


QUERIES = {f.__name__: f for f in (
    association, mixed_association, page_conflicts, page_diagnostics, mixed_diagnostics, escalation_reasons, mixed_reasons, document_diagnostics, native_lines, spatial_rows, geometry_scores, similarity, occurrence_index,
    token_counts, token_difference, token_scores, chunk_terms, bm25_topk, hit_at_k, dedup_union, unmatched_union, agreed_words,
    jobs_page, jobs_counts, jobs_summary, job_views, date_headings, credit_summary, usage_days, admission_counts, admission, queued_antijoin, exhausted_jobs, failure_codes, winning_attempt, late_jobs, reconciliation, running_budget, backfill_grants, invariant_violations,
    stage_metrics, floor_percentile, latest_samples, interval_union, covered_duration, max_concurrency, interval_intersections, reconcile_two_sided, paired_cells, label_agreement, failure_groups, sample_quotas, event_props,
)}

_JOBS = """j0 AS (SELECT o_orderkey AS job_id, o_custkey AS tenant, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'uploading' WHEN 1 THEN 'queued' ELSE 'dispatched' END END AS state,
                 o_orderdate AS created_at, o_orderdate + CASE WHEN o_orderkey % 97 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS upload_expires_at FROM orders),
jobs AS (SELECT *, CASE WHEN state <> 'uploading' THEN created_at + INTERVAL 10 MINUTE END AS queued_at, CASE WHEN state IN ('succeeded', 'failed') THEN created_at + INTERVAL 1 DAY END AS completed_at,
                CASE WHEN state = 'succeeded' THEN job_id % 200 + 1 END AS pages_actual, CASE WHEN job_id % 89 = 0 THEN 50 ELSE 200 END::BIGINT AS reserved_pages, CASE WHEN state = 'succeeded' THEN (job_id % 200 + 1) * 1000 END AS cost,
                CASE WHEN state = 'failed' THEN CASE WHEN job_id % 83 = 0 THEN NULL WHEN job_id % 79 = 0 THEN 'exploded' ELSE 'invalid_pdf' END END AS failure_code, CASE WHEN state = 'succeeded' THEN job_id * 1000 + 1 END AS accepted_attempt_id,
                CASE WHEN state = 'succeeded' AND job_id % 73 <> 0 THEN created_at + INTERVAL 3 DAY END AS retention_expires_at, concat('k', job_id % 5) AS idempotency_key, job_id % 7 AS input FROM j0),
a0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS nth FROM lineitem),
a1 AS (SELECT l_orderkey AS job_id, l_orderkey * 1000 + nth AS attempt_id, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'succeeded' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'dispatching' WHEN 1 THEN 'dispatch_unknown' ELSE 'dispatched' END END AS state,
              l_shipdate AS created_at, l_partkey AS part, nth FROM a0),
attempts AS (SELECT *, CASE WHEN state IN ('failed', 'succeeded') THEN created_at + INTERVAL 1 DAY END AS completed_at,
                    CASE WHEN state = 'failed' THEN ['processing_failed', 'dispatch_failed', 'invalid_pdf', 'page_limit_exceeded', 'input_digest_mismatch'][part % 5 + 1] END AS failure_code,
                    CASE WHEN state <> 'dispatching' THEN CASE WHEN part % 101 = 0 THEN ' ' ELSE concat('c', attempt_id) END END AS call_id, CASE WHEN nth > 1 THEN job_id * 1000 + 1 END AS replaces_attempt_id FROM a1),
grants AS (SELECT c_custkey AS tenant, CAST(floor(c_acctbal) AS BIGINT) AS pages FROM customer WHERE c_acctbal > 0)"""
_CODE_RANK = "CASE failure_code WHEN 'input_digest_mismatch' THEN 1 WHEN 'page_limit_exceeded' THEN 2 WHEN 'invalid_pdf' THEN 3 WHEN 'dispatch_failed' THEN 4 ELSE 5 END"
_FAILED = f"SELECT job_id, failure_code FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {_CODE_RANK}, completed_at, attempt_id) AS n FROM attempts WHERE state = 'failed') WHERE n = 1"
_OPEN = "('dispatching', 'dispatch_unknown', 'dispatched')"
_SPANS = """s AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS "start", epoch_us(ts) // 1000 + CAST(floor(abs(value) * 1000) AS BIGINT) + 1 AS stop FROM events)"""
_PER_PAGE = """pd AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(native_count, 0) AS native_count, coalesce(ocr_count, 0) AS ocr_count, coalesce(recovered_count, 0) AS recovered_count,
             coalesce(match_count, 0) AS match_count, coalesce(first_matches, 0) AS first_matches, coalesce(unmatched_count, 0) AS unmatched_count, coalesce(conflict_count, 0) AS conflict_count, coalesce(omission_count, 0) AS omission_count,
             coalesce(low_count, 0) AS low_count, coalesce(sure_count, 0) AS sure_count, coalesce(alone_count, 0) AS alone_count, conflict_sources, omission_sources
      FROM (SELECT page_id, count(*) AS native_count FROM nat GROUP BY page_id) a
      FULL JOIN (SELECT page_id, count(*) AS ocr_count, count(*) FILTER (WHERE recovery_method IS NOT NULL) AS recovered_count, count(*) FILTER (WHERE verdict = 'match') AS match_count,
                        count(*) FILTER (WHERE verdict = 'match' AND recovery_method IS NULL) AS first_matches, count(*) FILTER (WHERE verdict IS NULL) AS unmatched_count,
                        count(*) FILTER (WHERE verdict = 'critical-token-disagreement') AS conflict_count, count(*) FILTER (WHERE verdict = 'critical-token-omission') AS omission_count, count(*) FILTER (WHERE confidence < 0.5) AS low_count,
                        count(*) FILTER (WHERE recovery_method IS NULL AND confidence >= 0.5) AS sure_count,
                        count(*) FILTER (WHERE recovery_method IS NULL AND confidence >= 0.5 AND verdict IS NULL) AS alone_count,
                        CAST(sum(sources) FILTER (WHERE verdict = 'critical-token-disagreement') AS BIGINT) AS conflict_sources, CAST(sum(sources) FILTER (WHERE verdict = 'critical-token-omission') AS BIGINT) AS omission_sources
                 FROM verdicts GROUP BY page_id) b ON a.page_id = b.page_id),
pe AS (SELECT *, sure_count >= 8 AND sure_count - alone_count < 0.5 * sure_count AS starved FROM pd)"""
_TEXT = "concat('qty ', qty, ' total $', cents)"
#: The token pattern of scoring, in this engine's syntax, and its normal form.
_FIND = r"regexp_extract_all({c}, '(?i)[£€$¥]?\(?[+\-−–—]?\d+(?:[.,]\d+)*(?:%|ppt|bp|[xkmbn])?\)?')"
_NORMAL = r"list_transform({c}, lambda t: CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN concat('-', replace(regexp_replace(lower(t[2:-2]), '[−–—]', '-', 'g'), ',', '')) ELSE replace(regexp_replace(lower(t), '[−–—]', '-', 'g'), ',', '') END)"


def _tokens(c: str) -> str:
    return _NORMAL.format(c=_FIND.format(c=c))


_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TERMS = r"regexp_extract_all(lower(regexp_replace({c}, '\p{{Sc}}', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_CHUNKS = rf"""w AS (SELECT doc_id AS page_id, {_WORDS} AS ws FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
c AS (SELECT page_id, ws, unnest(range(0, greatest(1, CAST(ceil(len(ws) / 50.0) AS BIGINT)))) AS chunk FROM w),
ct AS (SELECT page_id, chunk, {_TERMS.format(c="array_to_string(list_slice(ws, chunk * 50 + 1, chunk * 50 + 50), ' ')")} AS terms FROM c),
post AS (SELECT page_id, chunk, term, count(*) AS tf FROM (SELECT page_id, chunk, unnest(terms) AS term FROM ct) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query, unnest({_TERMS.format(c='text')}) AS term FROM benchmark)"""
_BM25 = """lens AS (SELECT page_id, chunk, len(terms) AS len FROM ct),
tot AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT q.query, p.page_id, p.chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score
       FROM q JOIN post p ON p.term = q.term JOIN lens l ON l.page_id = p.page_id AND l.chunk = p.chunk JOIN dfs d ON d.term = q.term CROSS JOIN tot GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, page_id, chunk) AS rank FROM sc WHERE score > 0),
best AS (SELECT * FROM ranked WHERE rank <= 10)"""
_DIFF = rf"""nt AS (SELECT page_id, unnest({_tokens('text')}) AS token FROM nat),
ot AS (SELECT page_id, unnest({_tokens('text')}) AS token FROM ocr),
df AS (SELECT page_id, token, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(r) AS BIGINT) AS right_n FROM (SELECT *, 1 AS l, 0 AS r FROM nt UNION ALL SELECT *, 0, 1 FROM ot) GROUP BY ALL)"""
_MERGED = """f AS (SELECT *, CASE WHEN max(stop) OVER (PARTITION BY {k} ORDER BY "start", stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "start" THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY "start", stop ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT {k}, island, min("start") AS "start", max(stop) AS stop, count(*) AS parts FROM g GROUP BY {k}, island)"""

_CROSSED = "x AS (SELECT n.page_id, n.ord, o.ord AS o_ord, n.text, o.text AS read, [n.x0, n.y0, n.x1, n.y1] AS a, [o.x0, o.y0, o.x1, o.y1] AS b FROM nat n JOIN ocr o ON o.page_id = n.page_id AND abs(n.y0 - o.y0) <= 16)"

SQL = {
    "association": f"WITH {L.SQL} SELECT page_id, ocr_ord, verdict, round(textual, 6) AS textual, round(geometric, 6) AS geometric FROM assoc WHERE verdict IS NOT NULL",
    "page_conflicts": f"WITH {L.SQL} SELECT page_id, count(*) AS conflicts FROM verdicts WHERE verdict LIKE 'critical-%' GROUP BY page_id",
    "page_diagnostics": f"WITH {L.SQL}, {_PER_PAGE} SELECT page_id, native_count, ocr_count, recovered_count, match_count, unmatched_count, conflict_count, omission_count, low_count, CASE WHEN ocr_count > recovered_count THEN round(first_matches / (ocr_count - recovered_count), 6) ELSE 0.0 END::DOUBLE AS coverage, conflict_count > 0 OR omission_count > 0 OR low_count > 0 OR starved AS escalates FROM pe",
    "escalation_reasons": f"""WITH {L.SQL}, {_PER_PAGE}, r AS (
SELECT page_id, 'critical-token-conflict' AS type, 'blocking' AS severity, conflict_count AS "count", ocr_count, conflict_count + conflict_sources AS sources FROM pe WHERE conflict_count > 0
UNION ALL SELECT page_id, 'critical-token-omission', 'blocking', omission_count, ocr_count, omission_count + omission_sources FROM pe WHERE omission_count > 0
UNION ALL SELECT page_id, 'low-ocr-confidence', 'advisory', low_count, ocr_count, low_count FROM pe WHERE low_count > 0
UNION ALL SELECT page_id, 'uncorroborated-ocr', 'blocking', alone_count, ocr_count, alone_count FROM pe WHERE starved)
SELECT page_id, type, severity, "count", round("count" / ocr_count, 6) AS share, sources FROM r""",
    "document_diagnostics": f"WITH {L.SQL}, {_PER_PAGE} SELECT page_id // 100 AS document_id, count(*) AS pages, CAST(sum(ocr_count) AS BIGINT) AS ocr_count, CAST(sum(match_count) AS BIGINT) AS match_count, CAST(sum(conflict_count) AS BIGINT) AS conflict_count, CAST(sum(low_count) AS BIGINT) AS low_count, count(*) FILTER (WHERE conflict_count > 0 OR low_count > 0 OR starved) AS escalating_pages, count(*) FILTER (WHERE conflict_count > 0 OR starved) AS blocking_pages FROM pe GROUP BY 1",
    "native_lines": f"WITH {L.SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS line, {_TEXT} AS text, 20.0::DOUBLE * ord AS y0 FROM nat",
    "spatial_rows": f"WITH {L.SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS row, {_TEXT} AS text, round(confidence, 6)::DOUBLE AS confidence FROM ocr",
    "geometry_scores": f"WITH {L.MIXED}, {_CROSSED}, y AS (SELECT *, greatest(0.0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0.0, least(a[4], b[4]) - greatest(a[2], b[2])) AS i, (a[3] - a[1]) * (a[4] - a[2]) AS ea, (b[3] - b[1]) * (b[4] - b[2]) AS eb FROM x) SELECT page_id, ord, o_ord, round(i / (ea + eb - i), 6)::DOUBLE AS iou, round(i / least(ea, eb), 6)::DOUBLE AS overlap FROM y",
    "similarity": f"""WITH {L.MIXED}, {_CROSSED}, y AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9%£€$+.-]+', ' ', 'g')) AS fa, trim(regexp_replace(lower(read), '[^a-z0-9%£€$+.-]+', ' ', 'g')) AS fb FROM x),
z AS (SELECT *, replace(fa, ' ', '') AS ca, replace(fb, ' ', '') AS cb, string_split(fa, ' ') AS wa, string_split(fb, ' ') AS wb FROM y)
SELECT page_id, ord, o_ord, round(CASE WHEN ca = cb THEN 1.0 WHEN contains(ca, cb) OR contains(cb, ca) THEN least(len(ca), len(cb)) / greatest(len(ca), len(cb))
ELSE 2.0 * list_sum(list_transform(list_distinct(wa), lambda w: least(len(list_filter(wa, lambda x: x = w)), len(list_filter(wb, lambda x: x = w))))) / (len(wa) + len(wb)) END, 6)::DOUBLE AS similarity FROM z""",
    "mixed_association": f"WITH {L.MIXED_SQL} SELECT page_id, ocr_ord, verdict, round(textual, 6) AS textual, round(geometric, 6) AS geometric FROM assoc WHERE verdict IS NOT NULL",
    "mixed_diagnostics": f"WITH {L.MIXED_SQL}, {_PER_PAGE} SELECT page_id, native_count, ocr_count, recovered_count, match_count, unmatched_count, conflict_count, omission_count, low_count, CASE WHEN ocr_count > recovered_count THEN round(first_matches / (ocr_count - recovered_count), 6) ELSE 0.0 END::DOUBLE AS coverage, conflict_count > 0 OR omission_count > 0 OR low_count > 0 OR starved AS escalates FROM pe",
    "mixed_reasons": f"""WITH {L.MIXED_SQL}, {_PER_PAGE}, r AS (
SELECT page_id, 'critical-token-conflict' AS type, 'blocking' AS severity, conflict_count AS "count", ocr_count, conflict_count + conflict_sources AS sources FROM pe WHERE conflict_count > 0
UNION ALL SELECT page_id, 'critical-token-omission', 'blocking', omission_count, ocr_count, omission_count + omission_sources FROM pe WHERE omission_count > 0
UNION ALL SELECT page_id, 'low-ocr-confidence', 'advisory', low_count, ocr_count, low_count FROM pe WHERE low_count > 0
UNION ALL SELECT page_id, 'uncorroborated-ocr', 'blocking', alone_count, ocr_count, alone_count FROM pe WHERE starved)
SELECT page_id, type, severity, "count", round("count" / ocr_count, 6) AS share, sources FROM r""",
    "jobs_counts": f"WITH {_JOBS} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS page_count FROM jobs WHERE state = 'failed' AND created_at >= TIMESTAMP '{NOON}' - INTERVAL 30 DAY",
    "job_views": f"WITH {_JOBS} SELECT job_id AS id, state, pages_actual AS pages, reserved_pages AS page_limit, CASE WHEN state = 'failed' THEN CASE WHEN failure_code = 'invalid_pdf' THEN failure_code ELSE 'processing_failed' END END AS error_code, CASE WHEN queued_at IS NOT NULL THEN 1 END::BIGINT AS deadline_days FROM jobs",
    "date_headings": f"WITH {_JOBS}, d AS (SELECT tenant, job_id, CAST(created_at AS DATE) AS day, lag(CAST(created_at AS DATE)) OVER (PARTITION BY tenant ORDER BY created_at DESC, job_id DESC) AS prev FROM jobs) SELECT tenant, job_id, concat(CASE WHEN day = DATE '1995-06-01' THEN 'Today · ' WHEN day = DATE '1995-05-31' THEN 'Yesterday · ' ELSE '' END, strftime(day, '%-d %B %Y')) AS heading FROM d WHERE prev IS DISTINCT FROM day",
    "usage_days": f"WITH {_JOBS} SELECT tenant, CAST(completed_at AS DATE) AS day, count(*) AS documents, CAST(sum(pages_actual) AS BIGINT) AS pages, CAST(sum(cost) AS BIGINT) AS cost FROM jobs WHERE state = 'succeeded' AND completed_at >= TIMESTAMP '1996-01-01' GROUP BY ALL",
    "late_jobs": f"WITH {_JOBS}, late AS (SELECT job_id, CASE WHEN state = 'uploading' THEN 'upload_expired' ELSE 'processing_deadline_exceeded' END AS failure_code FROM jobs WHERE (state = 'uploading' AND upload_expires_at <= TIMESTAMP '{NOON}') OR (state IN ('queued', 'dispatched') AND (queued_at IS NULL OR queued_at <= TIMESTAMP '{NOON}' - INTERVAL 24 HOUR))), lj AS (SELECT failure_code, count(*) AS jobs FROM late GROUP BY 1), la AS (SELECT l.failure_code, count(*) AS attempts FROM attempts a JOIN late l USING (job_id) WHERE a.state IN {_OPEN} GROUP BY 1) SELECT * FROM lj FULL JOIN la USING (failure_code)",
    "reconciliation": f"""WITH {_JOBS}, o AS (SELECT *, ['pending', 'completed', 'invalid', 'failed', 'unavailable'][attempt_id % 5 + 1] AS outcome, attempt_id % 4 = 0 AS has, attempt_id IN (SELECT replaces_attempt_id FROM attempts WHERE replaces_attempt_id IS NOT NULL) AS taken FROM attempts WHERE state IN {_OPEN})
SELECT CASE WHEN state = 'dispatched' AND outcome IN ('pending', 'completed') THEN outcome WHEN has THEN 'recovered' WHEN state = 'dispatched' THEN CASE WHEN outcome = 'unavailable' THEN 'unavailable' ELSE 'failed' END
WHEN created_at > TIMESTAMP '{NOON}' - INTERVAL 10 MINUTE THEN 'waiting_unknown' WHEN taken THEN 'replacement_exists' WHEN replaces_attempt_id IS NOT NULL THEN 'failed' ELSE 'replace' END AS decision, count(*) AS attempts FROM o GROUP BY 1""",
    "admission": f"""WITH {_JOBS}, p AS (SELECT 'idle' AS phase UNION ALL SELECT 'busy'), js AS (SELECT phase, jobs.* FROM p JOIN jobs ON phase = 'busy' OR state IN ('succeeded', 'failed')),
act AS (SELECT phase, tenant, count(*) FILTER (WHERE state IN ('uploading', 'queued', 'dispatched')) AS owned, coalesce(sum(pages_actual) FILTER (WHERE state = 'succeeded'), 0) + coalesce(sum(reserved_pages) FILTER (WHERE state IN ('uploading', 'queued', 'dispatched')), 0) AS spent FROM js GROUP BY ALL),
r AS (SELECT phase, tenant, job_id, job_id % 3 AS kind FROM p CROSS JOIN jobs),
s AS (SELECT r.*, kind <> 2 AND EXISTS (SELECT 1 FROM js WHERE js.phase = r.phase AND js.job_id = r.job_id) AS known, coalesce(act.owned, 0) AS owned, (SELECT sum(owned) FROM act x WHERE x.phase = r.phase) AS every,
  coalesce((SELECT sum(pages) FROM grants g WHERE g.tenant = r.tenant), 0) - coalesce(act.spent, 0) AS free FROM r LEFT JOIN act ON act.phase = r.phase AND act.tenant = r.tenant),
v AS (SELECT phase, free, CASE WHEN known THEN CASE kind WHEN 0 THEN 'replayed' ELSE 'idempotency_mismatch' END WHEN every >= 100 OR owned >= 5 THEN 'admission_limit' WHEN free < 1 THEN 'credits_exhausted' ELSE 'admitted' END AS verdict FROM s)
SELECT phase, verdict, count(*) AS requests, CAST(sum(CASE WHEN verdict = 'admitted' THEN least(200, free) END) AS BIGINT) AS pages FROM v GROUP BY ALL""",
    "occurrence_index": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) - 1 AS occurrence FROM lineitem",
    "token_counts": f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL",
    "token_difference": f"WITH {L.SQL}, {_DIFF} SELECT page_id, token, greatest(0, left_n - right_n) AS missing, greatest(0, right_n - left_n) AS unexpected FROM df WHERE left_n <> right_n",
    "token_scores": f"WITH {L.SQL}, {_DIFF}, x AS (SELECT page_id, CAST(sum(least(left_n, right_n)) AS BIGINT) AS shared, CAST(sum(greatest(0, left_n - right_n)) AS BIGINT) AS missing, CAST(sum(greatest(0, right_n - left_n)) AS BIGINT) AS unexpected, sum(left_n) AS a, sum(right_n) AS b FROM df GROUP BY page_id) SELECT page_id, shared, missing, unexpected, CASE WHEN a > 0 THEN round(shared / a, 6) END::DOUBLE AS recall, CASE WHEN b > 0 THEN round(shared / b, 6) END::DOUBLE AS precision FROM x",
    "chunk_terms": f"WITH {_CHUNKS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "bm25_topk": f"WITH {_CHUNKS}, {_BM25} SELECT query, page_id, chunk, round(score, 6) AS score, rank FROM best",
    "hit_at_k": rf"""WITH {_CHUNKS}, {_BM25}, rel AS (SELECT item_id AS query, doc_id AS page_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '[\x20\x09-\x0D]+', ' ', 'g')), trim(regexp_replace(b.text, '[\x20\x09-\x0D]+', ' ', 'g')))),
fr AS (SELECT query, min(rank) AS first_rank FROM best SEMI JOIN rel USING (query, page_id) GROUP BY query)
SELECT count(*) AS queries, count(*) FILTER (WHERE first_rank <= 1) AS hits_at_1, count(*) FILTER (WHERE first_rank <= 3) AS hits_at_3, count(*) FILTER (WHERE first_rank <= 5) AS hits_at_5, count(*) FILTER (WHERE first_rank <= 10) AS hits_at_10 FROM (SELECT DISTINCT query FROM q) LEFT JOIN fr USING (query)""",
    "dedup_union": f"""WITH {L.PLAIN}, blob AS (SELECT page_id, replace(string_agg(text, ' ' ORDER BY ord), '$', '') AS b FROM nat GROUP BY page_id),
u AS (SELECT page_id, 'native' AS source FROM nat UNION ALL SELECT o.page_id, 'ocr' FROM ocr o LEFT JOIN blob ON blob.page_id = o.page_id WHERE b IS NULL OR NOT contains(b, replace(o.text, '$', '')))
SELECT page_id, source, count(*) AS rows FROM u GROUP BY ALL""",
    "unmatched_union": f"WITH {L.SQL}, u AS (SELECT page_id, 'native' AS source FROM nat UNION ALL SELECT page_id, 'ocr' FROM verdicts WHERE verdict IS DISTINCT FROM 'match') SELECT page_id, source, count(*) AS rows FROM u GROUP BY ALL",
    "agreed_words": f"WITH {L.SQL}, a AS (SELECT DISTINCT page_id, unnest(['qty', 'total', qty::VARCHAR, cents::VARCHAR]) AS word FROM nat), b AS (SELECT DISTINCT page_id, unnest(['qty', 'total', qty::VARCHAR, cents::VARCHAR]) AS word FROM ocr) SELECT a.page_id, count(*) AS words FROM a JOIN b ON a.page_id = b.page_id AND a.word = b.word GROUP BY a.page_id",
    "jobs_page": f"WITH {_JOBS} SELECT job_id, tenant, state, reserved_pages FROM jobs WHERE state IN ('uploading', 'queued', 'dispatched') ORDER BY created_at DESC, job_id DESC LIMIT 25 OFFSET 25",
    "jobs_summary": f"WITH {_JOBS} SELECT tenant, count(*) AS documents, coalesce(CAST(sum(pages_actual) FILTER (WHERE state = 'succeeded') AS BIGINT), 0) AS pages, coalesce(CAST(sum(cost) FILTER (WHERE state = 'succeeded') AS BIGINT), 0) AS cost FROM jobs GROUP BY tenant",
    "credit_summary": f"WITH {_JOBS}, t AS (SELECT tenant FROM grants UNION SELECT tenant FROM jobs), s AS (SELECT tenant, coalesce((SELECT CAST(sum(pages) AS BIGINT) FROM grants g WHERE g.tenant = t.tenant), 0) AS granted, coalesce((SELECT CAST(sum(pages_actual) AS BIGINT) FROM jobs j WHERE j.tenant = t.tenant AND state = 'succeeded'), 0) AS used, coalesce((SELECT CAST(sum(reserved_pages) AS BIGINT) FROM jobs j WHERE j.tenant = t.tenant AND state IN ('uploading', 'queued', 'dispatched')), 0) AS reserved FROM t) SELECT *, greatest(0, granted - used - reserved) AS available FROM s",
    "admission_counts": f"WITH {_JOBS} SELECT tenant, count(*) AS owned, (SELECT count(*) FROM jobs WHERE state IN ('uploading', 'queued', 'dispatched')) AS global FROM jobs WHERE state IN ('uploading', 'queued', 'dispatched') GROUP BY tenant",
    "queued_antijoin": f"WITH {_JOBS} SELECT job_id, tenant FROM jobs j WHERE state = 'queued' AND accepted_attempt_id IS NULL AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.job_id = j.job_id) ORDER BY queued_at, job_id LIMIT 8",
    "exhausted_jobs": f"WITH {_JOBS}, f AS ({_FAILED}) SELECT job_id, tenant, (SELECT count(*) FROM attempts a WHERE a.job_id = j.job_id) AS attempts, coalesce(f.failure_code, 'processing_failed') AS failure_code FROM jobs j JOIN f USING (job_id) WHERE j.state IN ('queued', 'dispatched') AND accepted_attempt_id IS NULL AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.job_id = j.job_id AND a.state <> 'failed')",
    "failure_codes": f"WITH {_JOBS} {_FAILED}",
    "winning_attempt": f"WITH {_JOBS}, r AS (SELECT a.job_id, attempt_id, a.created_at AS arrival, j.state, j.accepted_attempt_id FROM attempts a JOIN jobs j USING (job_id) WHERE a.completed_at IS NULL AND j.state <> 'uploading'), w AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY arrival, attempt_id) AS n FROM r) SELECT job_id, attempt_id, n = 1 AND accepted_attempt_id IS NULL AND state IN ('queued', 'dispatched') AS won FROM w",
    "running_budget": f"WITH {_JOBS}, r AS (SELECT tenant, CAST(sum(reserved_pages) OVER (PARTITION BY tenant ORDER BY created_at, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM jobs) SELECT tenant, count(*) AS jobs, max(spent) AS spent FROM r WHERE spent <= 500 GROUP BY tenant",
    "backfill_grants": f"WITH {_JOBS} SELECT c_custkey AS tenant, 100 + coalesce(CAST(sum(pages_actual) FILTER (WHERE state = 'succeeded') AS BIGINT), 0) AS pages FROM customer LEFT JOIN jobs ON tenant = c_custkey WHERE c_custkey NOT IN (SELECT tenant FROM grants) GROUP BY c_custkey",
    "invariant_violations": f"""WITH {_JOBS}, v AS (
SELECT 'attempts_job' AS rule FROM attempts WHERE job_id NOT IN (SELECT job_id FROM jobs)
UNION ALL SELECT 'jobs_upload_window_bounded' FROM jobs WHERE upload_expires_at > created_at + INTERVAL 1 HOUR
UNION ALL SELECT 'jobs_succeeded_has_retention' FROM jobs WHERE state = 'succeeded' AND retention_expires_at IS NULL
UNION ALL SELECT 'jobs_failure_code_known' FROM jobs WHERE failure_code = 'exploded'
UNION ALL SELECT 'jobs_failed_has_code' FROM jobs WHERE (state = 'failed') <> (failure_code IS NOT NULL)
UNION ALL SELECT 'jobs_succeeded_within_reservation' FROM jobs WHERE state = 'succeeded' AND pages_actual > reserved_pages
UNION ALL SELECT 'jobs_idempotency' FROM jobs GROUP BY tenant, idempotency_key HAVING count(*) > 1
UNION ALL SELECT 'jobs_accepted_attempt' FROM jobs WHERE accepted_attempt_id IS NOT NULL AND accepted_attempt_id NOT IN (SELECT attempt_id FROM attempts)
UNION ALL SELECT 'attempts_call_id_nonblank' FROM attempts WHERE trim(call_id) = ''
UNION ALL SELECT 'attempts_call_unique' FROM attempts WHERE call_id IS NOT NULL GROUP BY call_id HAVING count(*) > 1
UNION ALL SELECT 'attempts_one_replacement' FROM attempts WHERE replaces_attempt_id IS NOT NULL GROUP BY replaces_attempt_id HAVING count(*) > 1)
SELECT rule, count(*) AS rows FROM v GROUP BY rule""",
    "stage_metrics": "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90_linear FROM events GROUP BY event_type",
    "floor_percentile": "WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(value) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, max(value) FILTER (WHERE i = greatest(0, CAST(ceil(n * 0.5) AS BIGINT) - 1)) AS p50_nearest FROM o GROUP BY user_id",
    "latest_samples": "SELECT event_type, count(*) AS samples, min(event_id) AS least_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 500 GROUP BY event_type",
    "interval_union": f"WITH {_SPANS}, {_MERGED.format(k='user_id')} SELECT user_id, \"start\", stop, parts FROM m",
    "covered_duration": f"WITH {_SPANS}, {_MERGED.format(k='event_type')} SELECT event_type, CAST(sum(stop - \"start\") AS BIGINT) AS covered, count(*) AS islands FROM m GROUP BY event_type",
    "max_concurrency": f"WITH {_SPANS}, e AS (SELECT event_type, \"start\" AS t, 1 AS step FROM s UNION ALL SELECT event_type, stop, -1 FROM s), r AS (SELECT event_type, sum(step) OVER (PARTITION BY event_type ORDER BY t, step DESC ROWS UNBOUNDED PRECEDING) AS o FROM e) SELECT event_type, CAST(max(o) AS BIGINT) AS max_concurrency FROM r GROUP BY event_type",
    "interval_intersections": f"WITH {_SPANS} SELECT a.user_id, count(*) AS pairs, CAST(sum(least(a.stop, b.stop) - greatest(a.\"start\", b.\"start\")) AS BIGINT) AS shared FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.\"start\" < b.stop AND b.\"start\" < a.stop GROUP BY a.user_id",
    "reconcile_two_sided": "WITH b AS (SELECT o_orderkey AS id, 1 AS e, 0 AS s FROM orders UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem), g AS (SELECT id, sum(e) AS e, CAST(sum(s) AS BIGINT) AS times FROM b GROUP BY id) SELECT id, CASE WHEN times = 0 THEN 'missing' WHEN e = 0 THEN 'unexpected' WHEN times > 1 THEN 'duplicate' ELSE 'ok' END AS state, times FROM g",
    "paired_cells": "SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS a_only, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS b_only, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS neither FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "label_agreement": "SELECT source, count(*) AS compared, count(*) FILTER (WHERE quality = toxic) AS agreed, round(count(*) FILTER (WHERE quality = toxic) / count(*), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "failure_groups": "WITH p AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'r' WHEN 1 THEN 'o' WHEN 2 THEN 'o' END AS m, ['failed', 'timed_out', 'aborted'][p_partkey % 3 + 1] AS status, CASE WHEN p_size % 4 <> 0 THEN concat('stage-', p_size % 4) END AS stage FROM part) SELECT CASE WHEN m = 'r' THEN 'unsupported-rotated-native-geometry' WHEN m = 'o' THEN 'native-geometry-out-of-bounds' WHEN status = 'timed_out' THEN 'timeout' WHEN status = 'aborted' THEN 'aborted' ELSE coalesce(stage, 'other') END AS class, count(*) AS pages FROM p GROUP BY 1",
    "sample_quotas": "WITH g AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1), t AS (SELECT *, size * 97 / sum(size) OVER () AS exact FROM g), f AS (SELECT *, floor(exact) AS fl, exact - floor(exact) AS rest FROM t), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, c_mktsegment) AS n, sum(fl) OVER () AS given FROM f) SELECT c_mktsegment, size, CAST(fl + CASE WHEN n <= 97 - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r",
    "event_props": "SELECT event_type, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
}
