"""Comparison of runs: verdicts over differences, stage time shares, repeats, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import intervals as I


def comparison_verdict(pages: DataFrame, token_tolerance: int, line_tolerance: int) -> DataFrame:
    """One row (VAL6): whether two runs may pass as equal, and why not.

    ``pages``: page_id, state (both, only_left or only_right), deterministic_same, score_same,
    derived_same, schema_ok, token_delta, line_delta. The tolerances come from a repeat of one
    configuration (``evaluate.capture_tolerance``) and must be given.
    """
    if token_tolerance is None or line_tolerance is None:
        raise ValueError("tolerances are required: derive them from a repeat of one configuration")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    both = F.col("state") == "both"
    sums = pages.agg(
        n(~both).alias("missing_pages"), n(both & ~F.col("deterministic_same")).alias("deterministic_differ"), n(both & ~F.col("score_same")).alias("_score"), n(both & ~F.col("derived_same")).alias("_derived"),
        n(both & ~F.col("schema_ok")).alias("schema_failures"), F.coalesce(F.sum("token_delta"), F.lit(0)).cast("long").alias("token_delta"), F.coalesce(F.sum("line_delta"), F.lit(0)).cast("long").alias("line_delta"),
    )
    # derived rows that differ although the scores behind them are equal
    derived = F.when(F.col("_score") == 0, F.col("_derived")).otherwise(0).cast("long")
    why = F.array_compact(F.array(
        F.when(F.col("missing_pages") > 0, "missing pages"), F.when(F.col("deterministic_differ") > 0, "deterministic projection differs"), F.when(derived > 0, "derived projection differs"),
        F.when(F.col("schema_failures") > 0, "schema"), F.when(F.col("token_delta") > token_tolerance, "token delta"), F.when(F.col("line_delta") > line_tolerance, "line delta"),
    ))
    return sums.withColumn("reasons", why).select("missing_pages", "deterministic_differ", derived.alias("derived_differ"), "schema_failures", "token_delta", "line_delta", (F.size("reasons") == 0).alias("pass"), F.array_join("reasons", ", ").alias("reasons"))


def stage_occupancy(stages: DataFrame, parents: DataFrame, *, width: int, inner: dict[str, str] | None = None) -> DataFrame:
    """Time of each stage of a role (AGG45): calls, summed service, occupied union, what of it no other
    stage holds, and its share of the role's own occupied time.

    ``stages``: role, stage, start, stop; ``parents``: role, start, stop. ``inner`` names for a
    stage the one that runs within it and is taken out. ``width`` is the bin of the interval join.
    """
    base = stages.groupBy("role", "stage").agg(F.count("*").alias("calls"), F.sum(F.col("stop") - F.col("start")).alias("service"))
    occupied = I.covered_duration(stages, ["role", "stage"]).select("role", "stage", F.col("covered").alias("occupied"))
    own = stages
    for outer, within in (inner or {}).items():
        cut = I.subtract(own.where(F.col("stage") == outer), stages.where(F.col("stage") == within).withColumn("stage", F.lit(outer)), ["role", "stage"])
        own = own.where(F.col("stage") != outer).select("role", "stage", "start", "stop").unionByName(cut.select("role", "stage", "start", "stop"))
    alone = I.covered_duration(own, ["role", "stage"]).select("role", "stage", F.col("covered").alias("exclusive"))
    total = I.covered_duration(parents, ["role"]).select("role", F.col("covered").alias("role_time"))
    df = base.join(occupied, ["role", "stage"]).join(alone, ["role", "stage"], "left").join(total, "role", "left").na.fill(0, ["exclusive"])
    return df.withColumn("share", F.round(F.try_divide(F.col("exclusive").cast("double"), F.col("role_time")), 6))


def role_coverage(stages: DataFrame, parents: DataFrame, *, width: int) -> DataFrame:
    """How much of a role's occupied time its stages account for (AGG45): ``role``, ``role_time``, ``attributed``, ``coverage``."""
    total = I.covered_duration(parents, ["role"]).select("role", F.col("covered").alias("role_time"))
    both = I.intersections(I.merge_intervals(stages, ["role"]), I.merge_intervals(parents, ["role"]), ["role"], width=width)
    inside = I.covered_duration(both, ["role"]).select("role", F.col("covered").alias("attributed"))
    df = total.join(inside, "role", "left").na.fill(0, ["attributed"])
    return df.withColumn("coverage", F.round(F.try_divide(F.col("attributed").cast("double"), F.col("role_time")), 6))


def dominant_stage(shares: DataFrame, least: float = 0.2) -> DataFrame:
    """The stage with the greatest share of a role, if that is a fifth or more (AGG45, AGG37)."""
    top = shares.groupBy("role").agg(F.max(F.struct("share", F.col("stage")))["stage"].alias("stage"), F.max("share").alias("share"))
    return top.withColumn("dominant", F.coalesce(F.col("share") >= least, F.lit(False)))


def repeat_summary(repeats: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Median over the repeats of a configuration, the mean of the middle two of an even number, and
    the extremes (AGG46); only complete repeats (``status``) count."""
    whole = repeats.where("status = 'completed'")
    stats = [f(c).alias(f"{name}_{c}") for c in values for name, f in (("median", F.median), ("min", F.min), ("max", F.max))]
    return whole.groupBy(*keys).agg(F.count("*").alias("repeats"), *stats)


def control_verdict(null_pairs: DataFrame, cross_pairs: DataFrame, delta: Column) -> DataFrame:
    """Whether two engines differ by more than one engine from itself (AGG47), one row: both sums of
    differences and ``exceeds``."""
    n, c = (df.agg(F.coalesce(F.sum(delta), F.lit(0)).cast("long").alias(name)) for df, name in ((null_pairs, "null_delta"), (cross_pairs, "cross_delta")))
    return n.join(F.broadcast(c)).withColumn("exceeds", F.col("cross_delta") > F.col("null_delta"))


def gate_verdict(differences: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether a candidate arm passes against its control (AGG48), one row of counts and ``pass``.

    ``differences``: page_id, side (candidate or control), verdict (incorrect, missing, correct,
    unsure, pending), caught; ``pages``: page_id, candidate_trusted, deterministic_same,
    cleared_blocking (blocking reasons that only the control has). On trusted pages no value
    may be newly wrong, missing or undecided; nowhere may one be pending, or wrong and uncaught;
    and no page may differ in what is deterministic or lose a reason.
    """
    d = differences.join(pages.select("page_id", "candidate_trusted"), "page_id")
    mine, trusted = F.col("side") == "candidate", F.col("candidate_trusted")
    is_ = lambda *v: F.col("verdict").isin(*v)
    counts = d.agg(
        F.count_if(trusted & mine & is_("incorrect")).alias("newly_incorrect"), F.count_if(trusted & ~mine & is_("missing")).alias("missing"), F.count_if(trusted & is_("pending", "unsure")).alias("unresolved"),
        F.count_if(is_("pending")).alias("pending"), F.count_if(mine & is_("incorrect") & ~F.coalesce("caught", F.lit(False))).alias("uncaught"), F.count_if(mine).alias("candidate_only"), F.count_if(~mine).alias("control_only"),
    )
    own = pages.agg(F.count_if(~F.col("deterministic_same")).alias("deterministic_differ"), F.count_if(F.col("cleared_blocking") > 0).alias("cleared_routes"))
    checks = ("newly_incorrect", "missing", "unresolved", "pending", "uncaught", "deterministic_differ", "cleared_routes")
    df = counts.join(F.broadcast(own))
    return df.withColumn("pass", sum((F.col(c) for c in checks), F.lit(0)) == 0)


def arm_strata(differences: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Values that only one arm has, by stratum (AGG40): pages, pages that differ, and the values of each side."""
    d = differences.groupBy("page_id").agg(F.count_if(F.col("side") == "candidate").alias("_a"), F.count_if(F.col("side") == "control").alias("_b"))
    df = pages.join(d, "page_id", "left").na.fill(0, ["_a", "_b"])
    return df.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(F.col("_a") + F.col("_b") > 0).alias("differing_pages"), F.sum("_a").cast("long").alias("candidate_only"), F.sum("_b").cast("long").alias("control_only"))
