"""Interval operators: union, concurrency, intersection, subtraction, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of a key's time over which running values are carried, so that a hot key is not one task.
SLICES = 256


def _sliced(df: DataFrame, keys: list[str], at: str, slices: int) -> DataFrame:
    """Adds ``_slice``: in which of ``slices`` equal parts of its key's time a row lies. Null keys are keys."""
    ends = df.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_lo", "_hi")
    same = [df[k].eqNullSafe(ends[f"_k_{k}"]) for k in keys]
    width = F.greatest(F.lit(1e-9), (F.col("_hi") - F.col("_lo")).cast("double") / slices)
    joined = df.join(ends, same) if keys else df.join(F.broadcast(ends))
    return joined.withColumn("_slice", F.least(F.lit(slices - 1), F.floor((F.col(at) - F.col("_lo")).cast("double") / width)).cast("int")).select(*df.columns, "_slice")


def _carried(df: DataFrame, keys: list[str], total: Column, combine) -> DataFrame:
    """Adds ``_carry``: ``combine`` of the slices' totals over all slices before a row's own."""
    sums = df.groupBy(*keys, "_slice").agg(total.alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    c = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"), combine("_t").over(before).alias("_carry"))
    on = [df[k].eqNullSafe(c[f"_k_{k}"]) for k in keys] + [df["_slice"] == c["_s"]]
    return df.join(c, on, "left").select(*df.columns, "_carry")


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", *, slices: int = SLICES) -> DataFrame:
    """Overlapping or touching intervals of a key become one (WIN5): gaps and islands.

    Intervals of one start are first put together; the running maximum of the stops and the
    number of islands so far run within slices of a key's time and are carried between them,
    so a key that holds most intervals is spread over many tasks.
    """
    own = df.groupBy(*keys, F.col(start).alias("_a")).agg(F.max(stop).alias("_b"), F.count("*").alias("_n"))
    cut = _sliced(own, keys, "_a", slices)
    w = Window.partitionBy(*keys, "_slice").orderBy("_a")
    reach = _carried(cut, keys, F.max("_b"), F.max).withColumn("_before", F.greatest("_carry", F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)))).drop("_carry")
    flagged = reach.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("_a") > F.col("_before")), 1).otherwise(0))
    island = _carried(flagged, keys, F.sum("_new"), F.sum).withColumn("_island", F.coalesce("_carry", F.lit(0)) + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("_a").alias(start), F.max("_b").alias(stop), F.sum("_n").alias("parts")).drop("_island")


def covered_duration(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Total length of the union (AGG36)."""
    return merge_intervals(df, keys, start, stop).groupBy(*keys).agg(F.sum(F.col(stop) - F.col(start)).alias("covered"), F.count("*").alias("islands"))


def max_concurrency(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", *, slices: int = SLICES) -> DataFrame:
    """Most intervals open at once (WIN6); at a tie starts come before ends. Equal edges are summed first and
    what is open is carried between slices of a key's time."""
    edges = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    edges = _sliced(edges.groupBy(*keys, "at", "step").agg(F.sum("step").alias("n")), keys, "at", slices)
    w = Window.partitionBy(*keys, "_slice").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    run = _carried(edges, keys, F.sum("n"), F.sum).withColumn("open", F.coalesce("_carry", F.lit(0)) + F.sum("n").over(w))
    return run.groupBy(*keys).agg(F.max("open").alias("max_concurrency"))


def intersections(a: DataFrame, b: DataFrame, keys: list[str], *, width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Pairwise intersections of positive length (JOIN30). Both sides are spread over bins of
    ``width``, so it is an equi join; a pair is kept in the first bin that both touch."""
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))
    l = a.select(*keys, F.col(start).alias("a0"), F.col(stop).alias("a1")).withColumn("bin", F.explode(bins("a0", "a1")))
    r = b.select(*keys, F.col(start).alias("b0"), F.col(stop).alias("b1")).withColumn("bin", F.explode(bins("b0", "b1")))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    return l.join(r, [*keys, "bin"]).where((lo < hi) & (F.col("bin") == F.floor(lo / width))).select(*keys, lo.alias(start), hi.alias(stop))


def subtract(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """What of the union of ``a`` no interval of ``b`` covers (JOIN30), as a sweep over edges."""
    edge = lambda df, side: df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("step")))).alias("e"), F.lit(side).alias("side")).select(*keys, "e.at", "e.step", "side")
    at = edge(a, "a").unionByName(edge(b, "b")).groupBy(*keys, "at").agg(*[F.sum(F.when(F.col("side") == s, F.col("step")).otherwise(0)).alias(f"d{s}") for s in "ab"])
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = at.withColumns({"na": F.sum("da").over(run), "nb": F.sum("db").over(run), "until": F.lead("at").over(w)})
    pieces = open_.where("na > 0 and nb = 0 and until > at").select(*keys, F.col("at").alias(start), F.col("until").alias(stop))
    return merge_intervals(pieces, keys, start, stop).drop("parts")


def smallest_container(children: DataFrame, parents: DataFrame, keys: list[str], *, width: int) -> DataFrame:
    """Each child interval with the smallest parent that holds it (JOIN32); orphans have none.

    Columns: child_id, start, stop; parent_id, start, stop. A parent is spread over its bins,
    a child stands in the bin of its start, which its container touches as well.
    """
    p = parents.select(*keys, F.col("parent_id"), F.col("start").alias("p0"), F.col("stop").alias("p1")).withColumn("bin", F.explode(F.sequence(F.floor(F.col("p0") / width), F.floor(F.col("p1") / width))))
    c = children.withColumn("bin", F.floor(F.col("start") / width))
    held = c.join(p, [*keys, "bin"]).where("p0 <= start and stop <= p1").groupBy("child_id").agg(F.min_by("parent_id", F.struct(F.expr("p1 - p0"), F.col("parent_id"))).alias("parent_id"))
    return children.join(held, "child_id", "left").select(*keys, "child_id", "start", "stop", "parent_id")


def median_gap(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The gap at position floor(n / 2) of the sorted gaps between neighbours (WIN8)."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    gaps = F.sort_array(F.collect_list("_gap"))
    return df.withColumn("_gap", gap).groupBy(*keys).agg(F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")).alias("median_gap"))
