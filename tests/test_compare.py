"""Run comparison, stored results, second readings and samples."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import associate as A
from folioscope.operators import compare as Cm
from folioscope.operators import diagnostics as D
from folioscope.operators import evaluate as E
from folioscope.operators import project as P
from folioscope.operators import results as Rs
from folioscope.operators import second_pass as Sp

from .test_goldens import natives, reads

PAGE = "page_id long, state string, deterministic_same boolean, score_same boolean, derived_same boolean, schema_ok boolean, token_delta long, line_delta long"


def test_comparison_verdict(spark):
    good = [(1, "both", True, True, True, True, 1, 0), (2, "both", True, False, False, True, 1, 3)]
    r = Cm.comparison_verdict(spark.createDataFrame(good, PAGE), 2, 3).first()
    assert r["pass"] and r.reasons == "" and r.token_delta == 2
    # the derived projection counts only where the scores behind it are equal
    bad = [(1, "only_left", None, None, None, None, 0, 0), (2, "both", False, True, False, False, 3, 0)]
    r = Cm.comparison_verdict(spark.createDataFrame(bad, PAGE), 2, 3).first()
    assert not r["pass"] and r.reasons == "missing pages, deterministic projection differs, derived projection differs, schema, token delta"
    with pytest.raises(ValueError):
        Cm.comparison_verdict(spark.createDataFrame(good, PAGE), None, 1)


def test_stage_times(spark):
    stages = spark.createDataFrame([("r", "prepare", 0, 10), ("r", "copy", 4, 6), ("r", "run", 20, 25), ("r", "run", 22, 30)], "role string, stage string, start long, stop long")
    parents = spark.createDataFrame([("r", 0, 12), ("r", 20, 28)], "role string, start long, stop long")
    got = {r.stage: (r.calls, r.service, r.occupied, r.exclusive, r.share) for r in Cm.stage_occupancy(stages, parents, width=10, inner={"prepare": "copy"}).collect()}
    assert got == {"prepare": (1, 10, 10, 8, 0.4), "copy": (1, 2, 2, 2, 0.1), "run": (2, 13, 10, 10, 0.5)}
    c = Cm.role_coverage(stages, parents, width=10).first()
    assert (c.role_time, c.attributed, c.coverage) == (20, 18, 0.9)
    assert tuple(Cm.dominant_stage(Cm.stage_occupancy(stages, parents, width=10)).first()) == ("r", "run", 0.5, True)
    reps = spark.createDataFrame([("a", "completed", x) for x in (1.0, 9.0, 3.0, 5.0)] + [("a", "failed", 100.0)], "arm string, status string, ms double")
    r = Cm.repeat_summary(reps, ["arm"], ["ms"]).first()
    assert (r.repeats, r.median_ms, r.min_ms, r.max_ms) == (4, 4.0, 1.0, 9.0)


def test_gates(spark):
    pages = spark.createDataFrame([(1, True, True, 0), (2, False, True, 0)], "page_id long, candidate_trusted boolean, deterministic_same boolean, cleared_blocking long")
    kind = "page_id long, side string, verdict string, caught boolean"
    ok = spark.createDataFrame([(1, "candidate", "correct", None), (2, "candidate", "incorrect", True), (2, "control", "missing", None), (2, "control", "unsure", None)], kind)
    assert Cm.gate_verdict(ok, pages).first()["pass"]
    bad = spark.createDataFrame([(1, "candidate", "incorrect", True), (2, "candidate", "pending", None), (2, "candidate", "incorrect", False)], kind)
    r = Cm.gate_verdict(bad, pages).first()
    assert (r["pass"], r.newly_incorrect, r.pending, r.uncaught, r.unresolved) == (False, 1, 1, 1, 0)
    assert [tuple(x) for x in Cm.arm_strata(ok, pages, ["candidate_trusted"]).orderBy("candidate_trusted").collect()] == [(False, 1, 1, 1, 2), (True, 1, 1, 1, 0)]
    n = spark.createDataFrame([(2,), (1,)], "d long")
    assert Cm.control_verdict(n, n.limit(1), F.col("d")).first().exceeds is False


IDS = dict(job_id="0" * 8 + "-0000-1000-8000-" + "0" * 12, attempt_id="a1", input_sha256="e" * 64)


def envelope(compact=False, n=2, **more):
    pages = [{"page_number": i + 1, "ok": True} for i in range(n - 1)] + [{"page_number": n, "ok": False, "failure": {"code": "page_failed", "message": "Page could not be parsed."}}]
    own = {"schema_version": Rs.COMPACT_VERSION, "representation": "compact"} if compact else {"schema_version": 1, "execution_id": "b" * 32}
    return {**own, **IDS, "page_count": n, "pages": pages, **more}


def test_stored_pairs(spark):
    leak = envelope()
    leak["pages"][1]["failure"]["message"] = "stack trace"
    cases = {"ok": (envelope(), envelope(True)), "evidence identity does not match the job": (envelope(input_sha256="f" * 64), envelope(True)), "evidence page count": (envelope(page_count=3), envelope(True)), "evidence pages are not contiguous": (envelope(pages=envelope()["pages"][::-1]), envelope(True)),
             "evidence failure is not public-safe": (leak, envelope(True)), "compact version": (envelope(), envelope(True, representation="full")), "compact page count does not match its evidence": (envelope(), envelope(True, 1)), "execution id": (envelope(execution_id="x"), envelope(True)), "compact is not an envelope": (envelope(), [])}
    rows = [(name, IDS["job_id"], IDS["input_sha256"], 200, json.dumps({**e, "attempt_id": name}), json.dumps({**c, "attempt_id": name} if c else c)) for name, (e, c) in cases.items()]
    df = spark.createDataFrame(rows, "attempt_id string, expected_job string, input_digest string, max_pages int, evidence string, compact string")
    got = {r.attempt_id: r.violation for r in Rs.stored_pair_violations(df).collect()}
    assert got == {k: k for k in cases if k != "ok"}
    pointers = df.where("attempt_id = 'ok'").select("attempt_id", F.sha2("evidence", 256).alias("result_digest"), F.octet_length("evidence").alias("result_bytes"), F.sha2("compact", 256).alias("compact_result_digest"), F.octet_length("compact").alias("compact_result_bytes"), F.lit(2).alias("page_count"))
    one = df.where("attempt_id = 'ok'")
    assert Rs.stored_pair_violations(one, pointers).count() == 0
    assert Rs.stored_pair_violations(one, pointers.withColumn("page_count", F.lit(3))).first().violation == "page count does not match its pointer"


def test_pointers_and_pages(spark):
    base = dict(job_id="j", attempt_id="a", execution_id="b" * 32, document_sha256="e" * 64, status="completed", result_key=f"results/j/a/{'b' * 32}.json", result_digest="c" * 64, result_bytes=5, page_count=3, compact_result_digest="d" * 64, compact_result_bytes=4)
    base |= dict(result_uri=f"r2://results/{base['result_key']}", compact_result_key=base["result_key"].replace(".json", ".compact.json"))
    base |= dict(compact_result_uri=f"r2://results/{base['compact_result_key']}")
    expected = spark.createDataFrame([("a", "j", "e" * 64, 200, True)], "attempt_id string, expected_job string, input_digest string, max_pages int, requires_compact boolean")
    why = lambda **more: [r.violation for r in Rs.pointer_violations(spark.createDataFrame([base | more]), expected).collect()]
    assert why() == [] and why(result_key="results/j/z/x.json") == ["key is outside its attempt"] and why(page_count=201) == ["page count exceeds the reservation"] and why(job_id="k") == ["identity does not match the attempt"]
    assert why(compact_result_digest="no") == ["compact digest"] and why(status="failed") == ["status must be completed"]
    fails = spark.createDataFrame([("j", "a", "e" * 64, "failed", "timeout", "x")], "job_id string, attempt_id string, document_sha256 string, status string, failure_code string, failure_detail string")
    assert [r.violation for r in Rs.failure_violations(fails, expected).collect()] == ["unknown failure code"]
    pages = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("b", 3, True), ("c", 1, None)], "job_id string, page_number int, ok boolean").withColumns({"evidence": F.lit('{"x":1}'), "compact": F.lit("{}")})
    assert {r.job_id: r.violation for r in Rs.page_order_violations(pages).collect()} == {"b": "pages are not contiguous", "c": "page has no boolean outcome"}
    assert [r.evidence for r in Rs.public_pages(pages.where("job_id = 'a'")).orderBy("page_number").collect()] == ['{"x":1}', '{"code":"page_failed","message":"Page could not be parsed."}']
    assert [f.name for f in Rs.schema_of("projection")] == ["source", "markdown", "warnings"] and "page_number" in Rs.json_schema(pages)


def test_tiled_second_pass(spark):
    known = natives(spark, [("Net sales 42", (10, 10, 100, 30))])
    rows = [(1, 0, "a", "Net sales 42", 8.0, 0.0, 360.0, 80.0, 10.0, 10.0), (1, 1, "b", "New 7", 400.0, 0.0, 480.0, 40.0, 10.0, 10.0), (1, 2, "c", "New 7", 0.0, 0.0, 80.0, 40.0, 110.0, 10.0), (1, 3, "d", " ", 0.0, 0.0, 9.0, 9.0, 0.0, 0.0), (1, 4, "e", "Net sales 42", 8.0, 0.0, 360.0, 80.0, 10.0, 10.0)]
    tiles = spark.createDataFrame([(*r, 4.0, 0.9) for r in rows], "page_id long, ord int, id string, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, zoom double, confidence double")
    fresh, receipts = Sp.recovered_readings(tiles, known)
    assert [(r.id, r.x0, r.x1, r.recovery_method) for r in fresh.collect()] == [("b", 110.0, 130.0, "zoom-retry-v1")]
    assert [r.id for r in receipts.collect()] == ["a"]


def test_starved_pages_are_read_again(spark):
    o = reads(spark, [(f"item {i}00", (10, 10 + 40 * i, 200, 40 + 40 * i)) for i in range(9)], confidence=0.95)
    both = o.unionByName(reads(spark, [(f"item {i}00", (10, 10 + 40 * i, 200, 40 + 40 * i)) for i in range(9)], page=2, confidence=0.95))
    n = natives(spark, [("unrelated", (300, 300, 380, 320))]).unionByName(natives(spark, [("unrelated", (300, 300, 380, 320))], page=2))
    counts = n.groupBy("page_id").agg(F.count("*").alias("native_count"))
    v = A.associate(n, both)
    d = D.page_diagnostics(both, v, counts)
    asked = []

    def engine(starved):
        asked.extend(sorted(r.page_id for r in starved.collect()))
        return o.select("page_id", "ord", "id", "text", "x0", "y0", "x1", "y1", "confidence")  # reads page 1 only

    size = spark.createDataFrame([(1, 400.0, 400.0), (2, 400.0, 400.0)], "page_id long, width double, height double")
    again, admitted = Sp.second_opinion_pass(d, both, v, counts, engine, size)
    assert asked == [1, 2] and {r.page_id: r.escalates for r in again.collect()} == {1: False, 2: True} and admitted.count() == 9


def test_gold_join_fails_closed(spark):
    kind = "objectId string, pageNumber int, sha256 string"
    gold, run = spark.createDataFrame([("a", 1, "s")], kind), spark.createDataFrame([("a", 1, "s"), ("b", 1, "t")], kind)
    keys = ["objectId", "pageNumber"]
    assert Sp.gold_pages(gold, run, run, keys).first().sha256 == "s"
    with pytest.raises(Exception, match="digests differ"):
        Sp.gold_pages(gold, run, spark.createDataFrame([("a", 1, "other")], kind), keys).collect()
    with pytest.raises(Exception, match="missing proposal"):
        Sp.gold_pages(gold, run.where("objectId = 'b'"), run, keys).collect()


def test_overlays_and_sentences(spark):
    n = natives(spark, [("ﬁne", (0, 0, 5, 5)), ("fine", (0, 0, 5, 5))]).unionByName(natives(spark, [("a", (0, 0, 5, 5)), ("a", (0, 6, 5, 9))], page=2))
    assert {r.page_id: r.overlay for r in Sp.coincident_overlays(n).collect()} == {1: True, 2: False}
    from folioscope.operators import grouping as Gr

    lines = Gr.native_lines(natives(spark, [("alpha 1,200 30", (0, 0, 100, 10)), ("beta 4,500 60", (0, 40, 100, 50))]))
    md = spark.createDataFrame([(1, "| alpha | 1,200 | 60 |")], "page_id long, markdown string")
    assert Sp.defect_sentences(P.markdown_defects(md, lines)).first().sentences == ["1 table row(s) put values printed on different lines into one row, attaching values to the wrong labels."]


def slow_sample(rows, tiers, size, fill, per_document, per_document_fill, per_family):
    picked, keys, docs, fams = [], set(), {}, {}
    for name, member, order, quota in [*tiers, ("fill", lambda r: True, fill, size)]:
        taken, cap = 0, per_document_fill if name == "fill" else per_document
        for r in sorted(filter(member, rows), key=lambda r: (order(r), r[0])):
            if taken >= quota or len(picked) >= size:
                break
            if r[0] in keys or docs.get(r[1], 0) >= cap or fams.get(r[2], 0) >= per_family:
                continue
            picked.append((r[0], name)), keys.add(r[0])
            docs[r[1]], fams[r[2]] = docs.get(r[1], 0) + 1, fams.get(r[2], 0) + 1
            taken += 1
    return sorted(picked)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tiered_sample_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        d = rng.randrange(12)
        rows.append((i, f"d{d}", f"f{d % 4}", rng.randrange(5), rng.random() < 0.3))
    df = spark.createDataFrame(rows, "key long, document string, family string, score int, starved boolean")
    tiers = [("starved", F.col("starved"), [F.desc("score")], 6), ("conflict", F.col("score") > 2, [F.desc("score")], 5)]
    got = Sp.tiered_sample(df, tiers, 16, [F.col("score")], per_document=2, per_document_fill=3, per_family=5)
    want = slow_sample(rows, [("starved", lambda r: r[4], lambda r: -r[3], 6), ("conflict", lambda r: r[3] > 2, lambda r: -r[3], 5)], 16, lambda r: r[3], 2, 3, 5)
    assert sorted((r.key, r.tier) for r in got.collect()) == want
    assert E.capture_tolerance(spark.createDataFrame([("a", 1, 5), ("a", 2, 9)], "arm string, rep int, delta long"), ["arm"], "delta").first().tolerance == 4
