"""Scoring: token multisets, paired cells, run comparison, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.cluster import ship
from folioscope.functions import numbers as N
from folioscope.functions import text as T


def token_counts(df: DataFrame, keys: list[str], text: str = "text", tokens: Column | None = None) -> DataFrame:
    """How often each token occurs (AGG21)."""
    found = tokens if tokens is not None else T.evaluation_tokens(F.col(text))
    return df.select(*keys, F.explode(found).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def page_token_counts(observations: DataFrame) -> DataFrame:
    """The same by page for observations with boxes: fragments of one value are put together first (FOLD9, TXT12)."""
    from folioscope.operators.grouping import coalesce_fragments

    return token_counts(coalesce_fragments(observations), ["page_id"])


def token_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and token what is shared and what one side has more (JOIN19, SET8): counts of both
    sides in one union and one partial aggregation."""
    both = left.select(*keys, "token", F.col("n").alias("l"), F.lit(0).cast("long").alias("r")).unionByName(right.select(*keys, "token", F.lit(0).cast("long").alias("l"), F.col("n").alias("r")))
    sums = both.groupBy(*keys, "token").agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"))
    zero = F.lit(0).cast("long")
    return sums.withColumns({"shared": F.least("left_n", "right_n"), "missing": F.greatest(zero, F.col("left_n") - F.col("right_n")), "unexpected": F.greatest(zero, F.col("right_n") - F.col("left_n"))})


def token_scores(difference: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and precision over the multisets (AGG20, AGG25, AGG39, AGG43)."""
    sums = difference.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("left_n", "right_n", "shared", "missing", "unexpected")])
    return sums.withColumns({"recall": N.rate(F.col("shared"), F.col("left_n")), "precision": N.rate(F.col("shared"), F.col("right_n"))})


def two_sided_reconciliation(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Missing, unexpected and duplicate keys (JOIN22) from one aggregation over both sides."""
    both = expected.select(F.col(key), F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(seen.select(F.col(key), F.lit(0).alias("e"), F.lit(1).alias("s")))
    sums = both.groupBy(key).agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
    state = F.when(F.col("s") == 0, "missing").when(F.col("e") == 0, "unexpected").when(F.col("s") > 1, "duplicate").otherwise("ok")
    return sums.select(key, state.alias("state"), F.col("s").cast("long").alias("times"))


def positional_difference(left: DataFrame, right: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines compared by position; what one side lacks counts as a difference (JOIN20)."""
    cut = lambda df, name: df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", name))
    pairs = cut(left, "a").join(cut(right, "b"), [*keys, "pos"], "full_outer")
    return pairs.groupBy(*keys).agg(F.count("*").alias("lines"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


def page_presence(left: DataFrame, right: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Pages of either run and whether they are the same (JOIN21)."""
    l, r = left.select(*keys, F.col(digest).alias("a")), right.select(*keys, F.col(digest).alias("b"))
    state = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return l.join(r, keys, "full_outer").select(*keys, state.alias("state"))


def best_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best overlap of a box with one of equal text, not consuming (JOIN14)."""
    from folioscope.functions import geometry as G

    r = right.select("page_id", "text", F.col("id").alias("other"), *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = left.join(r, ["page_id", "text"]).withColumn("iou", G.iou(G.box(), G.box("r_")))
    return pairs.groupBy("page_id", "id").agg(F.max_by("other", F.struct("iou", "other")).alias("other"), F.max("iou").alias("iou"))


def paired_cells(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """The four cells of two yes/no readings (AGG26)."""
    cell = lambda x, y: F.count_if((a if x else ~a) & (b if y else ~b))
    return df.groupBy(*keys).agg(cell(1, 1).alias("both"), cell(1, 0).alias("a_only"), cell(0, 1).alias("b_only"), cell(0, 0).alias("neither"))


def equivalence_report(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exact paired statistics for each row of aggregated cells (NUM6, NUM7, AGG26)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    ship(cells.sparkSession)
    schema = StructType([*[f for f in cells.schema.fields], *[StructField(n, DoubleType()) for n in ("p_value", "agreement", "low", "high")]])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            extra = []
            for r in b.to_pylist():
                n = r["both"] + r["a_only"] + r["b_only"] + r["neither"]
                same = r["both"] + r["neither"]
                low, high = N.clopper_pearson(same, n) or (None, None)
                extra.append((N.mcnemar_exact(r["a_only"], r["b_only"]), same / n if n else None, low, high))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.float64()) for c in (zip(*extra) if extra else [()] * 4)]], [*b.schema.names, "p_value", "agreement", "low", "high"])

    return cells.mapInArrow(run, schema)


def agreement_by(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Share of rows on which two readings agree (AGG24)."""
    return df.groupBy(*keys).agg(F.count("*").alias("compared"), F.count_if(F.col(a) == F.col(b)).alias("agreed")).withColumn("rate", N.rate(F.col("agreed"), F.col("compared")))


# Classes of failed pages and the words of their messages.
ROTATED, OUT_OF_BOUNDS = ("rotat", "unsupported-rotated-native-geometry"), ("outside|out.of.bounds|bounds", "native-geometry-out-of-bounds")


def failure_class(message: Column, status: Column, stage: Column) -> Column:
    """Class of a failed page (FLT18): by its message, else its status, else the stage that failed."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike(ROTATED[0]), ROTATED[1]).when(m.rlike(OUT_OF_BOUNDS[0]), OUT_OF_BOUNDS[1]).when(status == "timed_out", "timeout").when(status == "aborted", "aborted").otherwise(F.coalesce(stage, F.lit("other")))


def largest_remainder(groups: DataFrame, total: int, size: str = "size") -> DataFrame:
    """Quota of each group for a sample of ``total``, by largest remainder (SRT9)."""
    n = groups.agg(F.sum(size).alias("_all"))
    exact = F.col(size) * total / F.col("_all")
    q = groups.join(F.broadcast(n)).withColumns({"_floor": F.floor(exact), "_rest": exact - F.floor(exact)})
    given = q.agg(F.sum("_floor").alias("_given"))
    names = [c for c in groups.columns if c != size]
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), *names))
    return q.join(F.broadcast(given)).withColumn("_rank", rank).withColumn("quota", (F.col("_floor") + F.when(F.col("_rank") <= F.lit(total) - F.col("_given"), 1).otherwise(0)).cast("long")).select(*names, size, "quota")


def quota_sample(df: DataFrame, quotas: DataFrame, key: str, id_col: str, seed: str) -> DataFrame:
    """The first rows of a seeded order, as many as a group's quota (SRT7, SRT9)."""
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, id_col))
    return df.join(quotas.select(key, "quota"), key).withColumn("_rank", rank).where(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def capture_tolerance(repeats: DataFrame, keys: list[str], value: str, rep: str = "rep") -> DataFrame:
    """Largest difference among repeats of one configuration (AGG42): the range of the values."""
    return repeats.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("tolerance"), F.count_distinct(rep).alias("repeats"))
