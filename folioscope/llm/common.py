"""Helpers that the corpus operators share: table reads, the shared folder, edges to components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.cluster import remove, scratch, shared_dir, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` holds two columns of longs. Each round every node takes the smallest label
    among its neighbours' (a partial aggregate, so a hub is never gathered in one task) and
    then the label of its label (pointer jumping), so the rounds grow with the logarithm of
    a component's diameter. Labels are rewritten to the shared folder each round, and those of
    the round before are deleted.

    Returns ``node``, ``component``. No edges: no rows. Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    both = (
        edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
        .where("src is not null and dst is not null")
        .select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
        .select("e.*")
        .distinct()
    )
    both = materialize(both, "edges")
    labels, stale = _written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("heard")), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("heard").alias("heard"))
        )
        near = labels.join(heard, "node", "left").select("node", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        # the root that a label points to hears of the smaller label as well, so trees hook onto trees
        hooked = near.select(F.col("label").alias("node"), F.col("next").alias("offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        moved = (
            near.join(jump, "next", "left")
            .select("node", "label", F.least("next", "far").alias("next"))
            .join(hooked, "node", "left")
            .select("node", "label", F.least("next", "offer").alias("next"))
        )
        moved, path = _written(moved, "labels")
        remove(spark, stale)
        stale = path
        changed = moved.where("next <> label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
