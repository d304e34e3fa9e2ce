"""Records, envelopes and job transitions."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import associate as A
from folioscope.operators import corroborate as C
from folioscope.operators import diagnostics as D
from folioscope.operators import jobs as J
from folioscope.operators import records as R

from .test_goldens import natives, reads


def test_normalize(spark):
    raw = spark.createDataFrame([("a" * 64, 1, i, t, 1.005, 2.0, 10.0, 20.0, 1.7) for i, t in enumerate([" Total ", " Total ", " ", "x"])], "document_sha256 string, page_number int, ord int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = R.normalize_observations(raw, "ocr", confidence=True).orderBy("ord").collect()
    assert [r.text for r in got] == ["Total", "Total", "x"] and len({r.id for r in got}) == 3
    assert all(r.x0 == 1.0 and r.confidence == 1.0 and r.page_id == "ps:" + "a" * 12 + ":p1" and r.id.startswith(r.page_id + ":o:") for r in got)


def test_record_round(spark):
    n, o = natives(spark, [("a 5", (0, 0, 10, 10)), ("b", (0, 40, 10, 50))]), reads(spark, [("a 6", (0, 0, 10, 10)), ("b", (0, 40, 10, 50))])
    v = A.associate(n, o)
    d = D.page_diagnostics(o, v, n.groupBy("page_id").agg(F.count("*").alias("native_count")))
    rec = R.page_records(n, o, v, d)
    r = rec.first()
    assert [x.id for x in r.native] == ["n0", "n1"] and [x.ocr_id for x in r.matches] == ["o1"] and len(r.conflicts or []) == 1
    a, b = R.page_digests(rec).first().digest, R.page_digests(R.page_records(n, o, v, d)).first().digest
    assert a == b and len(a) == 64
    env = R.public_envelopes(rec.withColumns({"doc": F.lit("d"), "page_number": F.lit(1)}), "doc").first()
    assert env.pages == 1 and len(env.compact) < len(env.evidence)
    status = C.proposal_status(reads(spark, [("a 5", (0, 0, 1, 1)), ("zzz", (0, 0, 1, 1))]), n, o)
    e = R.enrichment_records(reads(spark, [("a 5", (0, 0, 1, 1)), ("zzz", (0, 0, 1, 1))]), status, R.page_digests(rec)).first()
    assert (e.native, e.novel, e.base_digest) == (1, 1, a)


def test_unread_null_is_not_empty(spark):
    n, o = natives(spark, [("a", (0, 0, 10, 10))]), reads(spark, [("a", (0, 0, 10, 10))])
    d = D.page_diagnostics(o, A.associate(n, o), n.groupBy("page_id").agg(F.count("*").alias("native_count")))
    kind = "page_id long, region int, x0 double, y0 double, x1 double, y1 double, kind string"
    clean = spark.createDataFrame([(1, None, None, None, None, None, None)], kind)
    never = spark.createDataFrame([], kind)
    args = (n, o, A.associate(n, o), d)
    assert R.page_records(*args, regions=clean).first().unread_ink == [] and R.page_records(*args, regions=never).first().unread_ink is None


def test_admission_and_charts(spark):
    pages = spark.createDataFrame([(1, 100.0, 100.0)], "page_id long, width double, height double")
    rows = reads(spark, [("ok", (0, 0, 10, 10)), ("  ", (0, 0, 10, 10)), ("out", (0, 0, 200, 10))])
    assert [r.text for r in R.admit_second_opinion(rows, pages).collect()] == ["ok"]
    gold = spark.createDataFrame([(1, "FY2020", "1,200"), (1, "FY2021", "5")], "page_id long, category string, value string")
    found = spark.createDataFrame([(1, "fy2020", "1,200"), (1, "FY2020", "1,200 m"), (1, "FY2021", "6")], "page_id long, category string, value string")
    r = R.chart_matches(gold, found).first()
    assert (r.matched, r.recall, r.precision) == (1, 0.5, 0.333333)


JOB = "job_id long, tenant string, state string, created_at string, queued_at string, upload_expires_at string, completed_at string, accepted_attempt_id long, failure_code string"
ATTEMPT = "attempt_id long, job_id long, state string, created_at string, completed_at string, reconcile_after string, call_id string, replaces_attempt_id long, failure_code string"
NOW = "2026-01-02 12:00:00"


def jobs(spark, *rows):
    """(id, state, more) with a time of creation an hour before now."""
    base = dict(tenant="t", created_at="2026-01-02 11:30:00", queued_at="2026-01-02 11:40:00", upload_expires_at="2026-01-02 12:30:00", completed_at=None, accepted_attempt_id=None, failure_code=None)
    return spark.createDataFrame([{**base, "job_id": i, "state": s, **more} for i, s, more in rows], JOB)


def attempts(spark, *rows):
    base = dict(created_at="2026-01-02 11:00:00", completed_at=None, reconcile_after="2026-01-02 11:59:00", call_id="c", replaces_attempt_id=None, failure_code=None)
    return spark.createDataFrame([{**base, "attempt_id": a, "job_id": j, "state": s, **more} for a, j, s, more in rows], ATTEMPT)


def test_uploads(spark):
    df = jobs(spark, *[(i, "uploading", {}) for i in range(1, 6)], (6, "uploading", {"upload_expires_at": NOW}), (7, "dispatched", {}))
    up = spark.createDataFrame([(1, 5, "application/pdf"), (2, 0, "application/pdf"), (3, 91 << 20, "application/pdf"), (4, 5, "text/html"), (6, 5, "application/pdf"), (7, 0, "x")], "job_id long, bytes long, content_type string")
    got = {r.job_id: (r.state, r.failure_code) for r in J.finalize_uploads(df, up, NOW).collect()}
    assert got == {1: ("queued", None), 2: ("failed", "invalid_upload"), 3: ("failed", "input_too_large"), 4: ("failed", "invalid_upload"), 5: ("uploading", None), 6: ("failed", "upload_expired"), 7: ("dispatched", None)}


def test_attempt_transitions(spark):
    done = {"completed_at": NOW}
    a = attempts(spark, (1, 1, "dispatching", {}), (2, 2, "dispatch_unknown", {}), (3, 3, "succeeded", done), (4, 4, "dispatched", {}), (5, 5, "failed", {**done, "failure_code": "invalid_pdf"}), (6, 5, "failed", {**done, "failure_code": "page_limit_exceeded"}))
    j = jobs(spark, *[(i, "queued", {}) for i in range(1, 6)], (8, "queued", {}), (9, "succeeded", {}))
    pairs = lambda *p: spark.createDataFrame(p, "job_id long, attempt_id long")
    calls = pairs((1, 1), (2, 2), (3, 3), (4, 9)).selectExpr("*", "'x' as call_id").unionByName(pairs((4, 4)).selectExpr("*", "' ' as call_id"))
    nj, na = J.mark_dispatched(j, a, calls, NOW)
    assert {r.attempt_id: r.state for r in na.collect()} == {1: "dispatched", 2: "dispatched", 3: "succeeded", 4: "dispatched", 5: "failed", 6: "failed"}
    assert {r.job_id for r in nj.where("state = 'dispatched'").collect()} == {1, 2}
    assert {r.attempt_id for r in J.mark_unknown(a, pairs((1, 1), (4, 4), (2, 1))).where("state = 'dispatch_unknown'").collect()} == {1, 2}
    failures = spark.createDataFrame([(1, 1, "dispatch_failed"), (3, 3, "dispatch_failed"), (9, 4, "dispatch_failed")], "job_id long, attempt_id long, failure_code string")
    assert {r.attempt_id: r.state for r in J.fail_attempts(a, failures, NOW).collect()} == {1: "failed", 2: "dispatch_unknown", 3: "succeeded", 4: "dispatched", 5: "failed", 6: "failed"}
    with pytest.raises(Exception, match="unknown failure code"):
        J.fail_attempts(a, spark.createDataFrame([(1, 1, "timeout")], failures.schema), NOW).collect()
    assert [(r.job_id, r.attempts, r.failure_code) for r in J.exhausted_jobs(j, a).collect()] == [(5, 2, "page_limit_exceeded")]
    assert [r.job_id for r in J.create_attempts(j, a).collect()] == [8]
    assert [r.replaces_attempt_id for r in J.create_replacements(j, a, spark.createDataFrame([(1,), (2,), (4,)], "attempt_id long")).collect()] == [2]
    later = J.defer_attempts(a, spark.createDataFrame([(1,), (3,)], "attempt_id long"), NOW).where("attempt_id in (1, 3)").orderBy("attempt_id").collect()
    assert [str(r.reconcile_after) for r in later] == ["2026-01-02 12:01:00", "2026-01-02 11:59:00"]


def test_acceptance_and_deadlines(spark):
    j = jobs(spark, (1, "dispatched", {}), (2, "failed", {}), (3, "uploading", {"upload_expires_at": NOW}), (4, "queued", {"queued_at": "2026-01-01 12:00:00"}), (5, "dispatched", {"queued_at": None}), (6, "queued", {}))
    a = attempts(spark, (1, 1, "dispatched", {}), (2, 1, "dispatched", {}), (3, 2, "dispatched", {}), (4, 3, "dispatching", {}), (5, 4, "dispatched", {}), (6, 4, "failed", {"completed_at": NOW}))
    reports = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 2, 3), (2, 3, 1), (3, 4, 1), (1, 5, 1), (4, 6, 1)], "job_id long, attempt_id long, arrival long")
    got = {(r.job_id, r.attempt_id, r.arrival): (r.recorded, r.won) for r in J.accept_attempts(j, a, reports).collect()}
    # the first wins, a late one is recorded, a repeated or foreign one is not, a failed job stays failed
    assert got == {(1, 2, 1): (True, True), (1, 1, 2): (True, False), (1, 2, 3): (False, False), (2, 3, 1): (True, False), (3, 4, 1): (False, False), (1, 5, 1): (False, False), (4, 6, 1): (False, False)}
    late, open_ = J.deadline_sweep(j, a, NOW)
    assert {r.job_id: r.failure_code for r in late.collect()} == {3: "upload_expired", 4: "processing_deadline_exceeded", 5: "processing_deadline_exceeded"}
    assert {r.attempt_id for r in open_.collect()} == {4, 5}
    remote = spark.createDataFrame([(1, "pending"), (2, "invalid"), (3, "unavailable"), (5, "failed")], "attempt_id long, outcome string")
    more = a.unionByName(attempts(spark, (7, 6, "dispatch_unknown", {}), (8, 6, "dispatching", {"replaces_attempt_id": 7}), (9, 5, "dispatching", {"created_at": "2026-01-02 11:55:00"})))
    got = {r.attempt_id: r.decision for r in J.reconcile_decisions(more, remote, spark.createDataFrame([(2,)], "attempt_id long"), NOW).collect()}
    assert got == {1: "pending", 2: "recovered", 3: "unavailable", 4: "replace", 5: "failed", 7: "replacement_exists", 8: "failed", 9: "waiting_unknown"}


def test_rules_of_the_tables(spark):
    j = jobs(spark, (1, "dispatched", {}), (2, "processing", {}), (3, "failed", {}), (4, "queued", {"upload_expires_at": "2026-01-02 13:00:00"}), (5, "succeeded", {"accepted_attempt_id": 9}))
    a = attempts(spark, (1, 1, "dispatched", {"call_id": None}), (2, 1, "dispatching", {"call_id": "c1"}), (3, 1, "dispatching", {"call_id": " ", "replaces_attempt_id": 4}), (4, 7, "failed", {"failure_code": "odd", "call_id": "c4"}))
    got = sorted((r.rule, r.job_id) for r in J.invariant_violations(j, a).collect())
    assert got == sorted([("jobs_state_known", 2), ("jobs_failed_has_code", 3), ("jobs_upload_window_bounded", 4), ("jobs_accepted_attempt", 5), ("attempts_dispatched_has_call_id", 1), ("attempts_one_initial", 1), ("attempts_call_id_nonblank", 1), ("attempts_replaces_same_job", 1), ("attempts_failure_code_known", 7), ("attempts_job", 7)])
    assert J.parse_jobs_query({}) == ("all", "7d", 1) and J.parse_jobs_query({"state": "active", "date": "24h", "page": "3"}) == ("active", "24h", 3)
    for bad in ({"state": "queued"}, {"date": "1d"}, {"page": "0"}, {"page": "01"}, {"page": "x"}):
        with pytest.raises(TypeError):
            J.parse_jobs_query(bad)


def test_keys_and_accounts(spark):
    secret, other = "ps_live_" + "a" * 43, "ps_live_" + "b" * 43
    users = spark.createDataFrame([("u", "active"), ("v", "suspended"), ("w", "invited")], "tenant string, status string")
    issued = J.issue_keys(spark.createDataFrame([("u", " ci ", secret), ("v", "x", other), ("u", " ", other), ("u", "y", "short")], "tenant string, name string, secret string"), users)
    keys = issued.selectExpr("1L as key_id", "*", "cast(null as string) as revoked_at")
    assert [(r.name, r.prefix) for r in keys.collect()] == [("ci", secret[:16])]
    ask = spark.createDataFrame([(1, f"Bearer {secret}"), (2, f"bearer {other}"), (3, None), (4, secret)], "request_id long, authorization string")
    assert {r.request_id: r.key_id for r in J.authenticate(ask, keys, users).collect()} == {1: 1, 2: None, 3: None, 4: None}
    gone = J.revoke_keys(keys, spark.createDataFrame([(1, "u")], "key_id long, tenant string"), NOW)
    assert {r.key_id for r in J.authenticate(ask, gone, users).collect()} == {None}
    assert gone.first().revoked_at == J.revoke_keys(gone, spark.createDataFrame([(1, "u")], "key_id long, tenant string"), "2030-01-01").first().revoked_at
    logins = spark.createDataFrame([("u",), ("v",), ("w",), ("z",)], "tenant string")
    assert {r.tenant: r.status for r in J.provision_users(logins, users).collect()} == {"u": "active", "v": None, "w": "active", "z": None}
    assert {r.tenant: r.outcome for r in J.request_credits(logins, users, spark.createDataFrame([("u",)], "tenant string")).collect()} == {"u": "pending", "v": "forbidden", "w": "forbidden", "z": "forbidden"}


def test_enrichment_state(spark):
    plans = spark.createDataFrame([(p, f"d{p}", p != 5) for p in range(1, 6)], "page_id long, base_digest string, asked boolean")
    ids = lambda *p: spark.createDataFrame([(x,) for x in p], "page_id long")
    digests = spark.createDataFrame([(p, f"d{p}" if p != 4 else "new") for p in range(1, 6)], "page_id long, digest string")
    got = {r.page_id: r.state for r in J.enrichment_state(plans, ids(1, 2), ids(1, 4), digests).collect()}
    assert got == {1: "complete", 2: "submitted", 3: "pending", 4: "stale", 5: "unavailable"}
