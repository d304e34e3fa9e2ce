"""Report queries over the driver's tables and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import runs as R
from folioscope.plans.relational import _JOBS, _PER_PAGE, _attempts, _diagnostics, _jobs
from folioscope.sources import ledger as L


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _captures(spark, d):
    """Line items as captured outputs of a request (the order): results that completed or failed, and exceptions."""
    flag = F.col("l_returnflag")
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.when(flag == "R", "exception").otherwise("result").alias("kind"), F.when(flag == "A", "completed").when(flag == "N", "failed").alias("status"),
        F.when(flag == "R", F.when(F.col("l_linenumber") % 2 == 0, "InputRejected: too large").otherwise("lost container")).alias("error"), F.when(flag == "N", F.element_at(F.array(F.lit("render"), F.lit("ocr"), F.lit(None).cast("string")), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("failure_class"),
        F.col("l_quantity").cast("long").alias("pages_ok"), (F.col("l_linenumber") % 3).cast("long").alias("pages_failed"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_extendedprice")).alias("total_method_ms"), (F.col("l_suppkey") % 4 == 0).alias("container_cold"),
        (F.col("l_linenumber") * 1000).cast("long").alias("spawned_ms"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).cast("long").alias("result_ms"),
    )


def _expected(spark, d):
    """Every second order is in the manifest."""
    return _t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("request_id"))


def _pages(spark, d):
    ok = F.when(F.col("l_returnflag") == "R", "failure").otherwise("success")
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("backend"), ok.alias("status"), F.col("l_extendedprice").alias("ms"), F.col("l_quantity").cast("long").alias("native"), F.col("l_quantity").cast("long").alias("ocr"), (F.col("l_quantity").cast("long") / 2).cast("long").alias("matches"), F.col("l_linenumber").alias("conflicts"))


def run_outcomes(spark, d):
    return R.run_reconciliation(_expected(spark, d), _captures(spark, d)).groupBy("state").agg(F.count("*").alias("requests"), F.sum("outputs").alias("outputs"), F.sum("exceptions").alias("exceptions"))


def run_totals(spark, d):
    c = _captures(spark, d)
    return R.run_totals(c, R.run_reconciliation(_expected(spark, d), c))


def failure_classes(spark, d):
    return R.failure_classes(_captures(spark, d))


def start_latency(spark, d):
    return R.start_latency(_captures(spark, d))


def baseline_summary(spark, d):
    return R.baseline_summary(_pages(spark, d), ["backend"]).select("backend", "pages", "succeeded", "failed", "native", "matches", "conflicts", "p50_ms", "p95_ms", "coverage")


def quantile_summary(spark, d):
    return R.quantile_summary(_t(spark, d, "events"), ["event_type"], "value")


def container_spans(spark, d):
    return R.container_spans(_t(spark, d, "events"), "user_id", "event_id")


def skip_shares(spark, d):
    """Lines of documents as readings: some recovered, on bare pages, half covered, with numerals or odd characters."""
    lines = _t(spark, d, "documents").select("doc_id", F.length("text").alias("native_chars"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    odd = F.when((F.col("doc_id") + F.col("n")) % 13 == 0, F.concat("line", F.lit("\ue000"))).when((F.col("doc_id") + F.col("n")) % 17 == 0, F.concat("line", F.lit("Ⅳ"))).otherwise(F.col("line"))
    rows = lines.select("native_chars", odd.alias("native_text"), ((F.col("doc_id") + F.col("n")) % 10 / 10.0).alias("covered"), F.when(F.col("n") % 11 == 5, "zoom-retry-v1").alias("recovery_method"))
    return R.skip_shares(R.selective_decision(rows)).select("decision", "n", "share", "char_share")


def page_strata(spark, d):
    """Pages by the kind of their blocking reasons."""
    pages = _diagnostics(spark, d, True)
    return pages.groupBy(R.stratum("reasons").alias("stratum")).agg(F.count("*").alias("pages"))


def recognizer_routes(spark, d):
    """Readings of parts: sure and unsure ones, with digits, in Han, kana, Hangul and Latin."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("plain", "12 a", "漢字", "かな", "한글", "naïve")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    route = R.route_recognizer(F.col("p_size") / 50, text, 0.5)
    return _t(spark, d, "part").groupBy(route.alias("route")).agg(F.count("*").alias("readings"))


def tier_report(spark, d):
    tiers = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("tier"), F.col("l_quantity").cast("long").alias("tokens"), F.least(F.col("l_quantity").cast("long"), F.lit(20).cast("long")).alias("matched"))
    return R.tier_report(tiers)


def verdict_composition(spark, d):
    return R.verdict_composition(_t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")


def plan_parity(spark, d):
    li = _t(spark, d, "lineitem")
    side = lambda cond: li.where(cond).groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_set("l_returnflag").alias("rungs"))
    return R.plan_parity(side("l_linenumber <= 2"), side("l_linenumber >= 2")).groupBy("state").agg(F.count("*").alias("pages"))


def capture_pairs(spark, d):
    caps = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_partkey") * 1000003 + F.col("l_suppkey") * 101 + F.col("l_linenumber")).alias("result_ms"), F.col("l_returnflag").alias("digest")).dropDuplicates(["request_id", "result_ms"])
    return R.repeat_pairs(caps)


def attempts_of_jobs(spark, d):
    return R.attempts_of_jobs(_jobs(spark, d), _attempts(spark, d)).groupBy("job_state").agg(F.count("*").alias("rows"), F.count("attempt_id").alias("attempts"))


def corpus_labels(spark, d):
    """Labels from notes that are put together from the parts table."""
    words = ("A table of fields", "bar charts and a graph", "two-column academic paper", "Polish annual report", "checkbox form", "sparse overlay, landscape", "near-image-only scan", "plain prose")
    key = F.col("p_partkey")
    note = F.concat_ws("; ", *[F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.floor(key / k), F.lit(8)) + 1).cast("int")) for k in (1, 8)])
    path = F.when(key % 9 == 0, "files/Deck.pdf").otherwise("files/report.pdf")
    labels = R.corpus_labels(note, path, key % 150, key % 4, key % 5 == 0, multilingual=key % 31 == 0, sibling=F.when(key % 23 == 0, "version-sibling"))
    return _t(spark, d, "part").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (run_outcomes, run_totals, failure_classes, start_latency, page_strata, baseline_summary, quantile_summary, container_spans, skip_shares, recognizer_routes, tier_report, verdict_composition, plan_parity, capture_pairs, attempts_of_jobs, corpus_labels)}

_REC = """c AS (SELECT l_orderkey AS request_id, l_returnflag AS f, l_linenumber, CAST(l_quantity AS BIGINT) AS pages_ok, l_linenumber % 3 AS pages_failed, l_linenumber * 1000 AS spawned, l_linenumber * 1000 + CAST(l_quantity AS BIGINT) AS done, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
e AS (SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey % 2 = 0),
g AS (SELECT request_id, count(*) AS outputs, count(*) FILTER (WHERE f = 'R') AS exceptions FROM c GROUP BY request_id),
r AS (SELECT CASE WHEN g.request_id IS NULL THEN 'missing' WHEN e.request_id IS NULL THEN 'unexpected' WHEN outputs > 1 THEN 'duplicate' ELSE 'ok' END AS state, coalesce(outputs, 0) AS outputs, coalesce(exceptions, 0) AS exceptions FROM e FULL JOIN g ON e.request_id = g.request_id)"""

SQL = {
    "capture_pairs": "WITH c AS (SELECT DISTINCT ON (l_orderkey, ms) l_orderkey AS request_id, ms, l_returnflag AS digest FROM (SELECT *, l_partkey * 1000003 + l_suppkey * 101 + l_linenumber AS ms FROM lineitem)), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ms) AS n FROM c) SELECT request_id, max(digest) FILTER (WHERE n = 1) AS first, max(digest) FILTER (WHERE n = 2) AS second FROM r WHERE n <= 2 GROUP BY request_id",
    "run_outcomes": f"WITH {_REC} SELECT state, count(*) AS requests, CAST(sum(outputs) AS BIGINT) AS outputs, CAST(sum(exceptions) AS BIGINT) AS exceptions FROM r GROUP BY state",
    "run_totals": f"""WITH {_REC} SELECT count(*) AS captured, count(*) FILTER (WHERE f = 'A') AS completed, count(*) FILTER (WHERE f = 'N') AS failed, count(*) FILTER (WHERE f = 'R' AND l_linenumber % 2 = 0) AS rejected, count(*) FILTER (WHERE f = 'R' AND l_linenumber % 2 = 1) AS other_exceptions,
CAST(sum(pages_ok) FILTER (WHERE f <> 'R') AS BIGINT) AS pages_ok, quantile_cont((done - spawned)::DOUBLE, 0.5) AS p50_ms, quantile_cont((done - spawned)::DOUBLE, 0.95) AS p95_ms, max(done) - min(spawned) AS window_ms,
(SELECT count(*) FROM r WHERE state = 'missing') AS missing, (SELECT count(*) FROM r WHERE state = 'unexpected') AS unexpected, (SELECT count(*) FROM r WHERE outputs > 1) AS duplicates,
round(sum(pages_ok + pages_failed) FILTER (WHERE f <> 'R') / ((max(done) - min(spawned)) / 1000), 6) AS pages_per_second FROM c""",
    "failure_classes": f"WITH {_REC} SELECT CASE l_partkey % 3 WHEN 0 THEN 'render' WHEN 1 THEN 'ocr' ELSE 'unknown' END AS failure_class, count(*) AS results FROM c WHERE f = 'N' GROUP BY 1",
    "start_latency": f"WITH {_REC} SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'cold' ELSE 'warm' END AS start, count(*) AS results, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50_ms, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95_ms, max(l_extendedprice) AS max_ms FROM c WHERE f <> 'R' AND l_suppkey % 5 <> 0 GROUP BY 1",
    "page_strata": f"WITH {L.MIXED_SQL}, {_PER_PAGE} SELECT CASE WHEN conflict_count > 0 OR omission_count > 0 THEN 'conflict' WHEN starved THEN 'escalated-other' ELSE 'clean' END AS stratum, count(*) AS pages FROM pe GROUP BY 1",
    "baseline_summary": """WITH p AS (SELECT l_suppkey AS backend, l_returnflag <> 'R' AS ok, l_extendedprice AS ms, CAST(l_quantity AS BIGINT) AS q, CAST(l_quantity AS BIGINT) // 2 AS m, l_linenumber AS k FROM lineitem)
SELECT backend, count(*) AS pages, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, CAST(coalesce(sum(q) FILTER (WHERE ok), 0) AS BIGINT) AS native, CAST(coalesce(sum(m) FILTER (WHERE ok), 0) AS BIGINT) AS matches,
CAST(coalesce(sum(k) FILTER (WHERE ok), 0) AS BIGINT) AS conflicts, quantile_disc(ms, 0.5) FILTER (WHERE ok) AS p50_ms, quantile_disc(ms, 0.95) FILTER (WHERE ok) AS p95_ms, round(sum(m) FILTER (WHERE ok) / sum(q) FILTER (WHERE ok), 6) AS coverage FROM p GROUP BY backend""",
    "quantile_summary": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.05) AS p05, quantile_disc(value, 0.25) AS p25, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "container_spans": "SELECT user_id, min(event_id) AS \"first\", max(event_id) AS \"last\", count(*) AS events FROM events GROUP BY user_id",
    "skip_shares": r"""WITH l AS (SELECT doc_id, length(text) AS chars, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
k AS (SELECT chars, t, n, (doc_id + n) % 10 / 10.0 AS covered, (doc_id + n) % 13 = 0 AS odd, (doc_id + n) % 13 <> 0 AND (doc_id + n) % 17 = 0 AS roman FROM l),
s AS (SELECT CASE WHEN n % 11 = 5 THEN 'recovery-pass' WHEN chars < 200 THEN 'no-native-layer' WHEN covered < 0.6 THEN 'not-native-covered' WHEN roman OR regexp_matches(t, '\p{N}') THEN 'native-has-digit' WHEN odd THEN 'native-suspicious' ELSE 'skip' END AS decision,
             length(t) + CASE WHEN odd OR roman THEN 1 ELSE 0 END AS len FROM k)
SELECT decision, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(len) / sum(sum(len)) OVER (), 6) AS char_share FROM s GROUP BY decision""",
    "recognizer_routes": "SELECT CASE WHEN p_size / 50 < 0.5 OR p_partkey % 6 IN (1, 2, 3, 4) THEN 'reference' ELSE 'fast' END AS route, count(*) AS readings FROM part GROUP BY 1",
    "tier_report": "SELECT l_returnflag AS tier, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(least(CAST(l_quantity AS BIGINT), 20)) AS BIGINT) AS matched, round(sum(least(CAST(l_quantity AS BIGINT), 20)) / sum(CAST(l_quantity AS BIGINT)), 6) AS recall FROM lineitem GROUP BY 1",
    "verdict_composition": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY o_orderpriority, o_orderstatus",
    "plan_parity": """WITH a AS (SELECT l_orderkey AS p, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_orderkey AS p, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
SELECT CASE WHEN a.p IS NULL THEN 'only_right' WHEN b.p IS NULL THEN 'only_left' WHEN a.r = b.r THEN 'same' ELSE 'different' END AS state, count(*) AS pages FROM a FULL JOIN b ON a.p = b.p GROUP BY 1""",
    "attempts_of_jobs": f"WITH {_JOBS} SELECT j.state AS job_state, count(*) AS rows, count(a.attempt_id) AS attempts FROM jobs j LEFT JOIN attempts a ON a.job_id = j.job_id GROUP BY 1",
    "corpus_labels": """WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS a, (p_partkey // 8) % 8 AS b FROM part),
l AS (SELECT unnest([CASE WHEN k % 5 <> 0 THEN 'native-text' END, CASE WHEN k % 5 = 0 THEN 'image-only' END, CASE WHEN k % 5 <> 0 AND k % 4 > 0 THEN 'mixed-raster-native' END, CASE WHEN a IN (0, 4) OR b IN (0, 4) THEN 'dense-table' END, CASE WHEN a = 1 OR b = 1 THEN 'chart' END,
CASE WHEN a IN (2, 3) OR b IN (2, 3) THEN 'multi-column' END, CASE WHEN a IN (0, 4) OR b IN (0, 4) THEN 'form' END, CASE WHEN a = 3 OR b = 3 OR k % 31 = 0 THEN 'multilingual' END, CASE WHEN k % 9 = 0 THEN 'slides' END, CASE WHEN k % 150 >= 100 THEN 'long-document' END,
CASE WHEN a = 5 OR b = 5 THEN 'landscape' END, CASE WHEN a IN (5, 6) OR b IN (5, 6) THEN 'sparse-overlay' END, CASE WHEN k % 23 = 0 THEN 'version-sibling' END]) AS label FROM p)
SELECT label, count(*) AS documents FROM l WHERE label IS NOT NULL GROUP BY label""",
}
