"""Stateful operators on Structured Streaming.

Sources are file streams and sinks are Parquet folders, so every query can be run to the end of
what is there (``availableNow``), compared with a batch, and gone on with from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.cluster import scratch, ship


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over a table of the folder, with its batch schema. A table may be a file or a folder."""
    batch = spark.read.parquet(f"{folder}/{name}.parquet")
    inside = batch.select("_metadata.file_path").limit(1).collect()
    nested = bool(inside) and f"{name}.parquet/" in inside[0][0]
    source = spark.readStream.schema(batch.schema)
    return source.parquet(f"{folder}/{name}.parquet") if nested else source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, mode: str, keys: list[str] = (), folder: str | None = None, each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Process what is there and return the result table.

    Batches are written as Parquet under ``folder`` (a fresh one in the shared folder if none is
    given), each under its number, so a batch that is run again after a failure replaces itself,
    and nothing passes the driver. The checkpoint lies beside them: a later call with the same
    folder goes on where this one ended. Complete results are the last batch; of updates the last
    row of each of ``keys`` counts. ``each`` is what of a batch is written.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    kept = each(spark.createDataFrame([], stream.schema)).schema
    columns, schema = kept.names, StructType([*kept.fields, StructField("batch", LongType())])
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{folder}/batches")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch").drop("batch")
    if mode == "update":
        own = [c for c in columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch").alias("r")).select(*keys, "r.*")
    return rows.drop("batch")


def stage_summary(samples: DataFrame, stage: str, value: str) -> DataFrame:
    """Count, p50, p95, maximum, mean and interpolated p90 of each stage (AGG14, NUM2, NUM4), as a batch."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return samples.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.9), 6).alias("p90_linear"))


def stage_totals(samples: DataFrame, stage: str, value: str) -> DataFrame:
    """Count, mean and maximum of each stage so far (AGG14): the state is one row a stage."""
    return samples.groupBy(stage).agg(F.count("*").alias("n"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))


def recent_percentiles(samples: DataFrame, stage: str, value: str, *, keep: int = 5000) -> DataFrame:
    """p50 and p95 by floor rank over the last ``keep`` samples of a stage (AGG14, WIN10); the state
    of a stage is bounded by ``keep`` numbers."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[float] = list(state.get[0]) if state.exists else []
        for f in frames:
            held.extend(f[value].dropna().tolist())
        held = held[-keep:]
        state.update((held,))
        ranked = sorted(held)
        at = lambda q: ranked[min(len(ranked) - 1, int(q * len(ranked)))] if ranked else None
        yield pd.DataFrame([(key[0], len(ranked), at(0.5), at(0.95))], columns=["stage", "samples", "p50", "p95"])

    ship(samples.sparkSession)
    return samples.select(F.col(stage).cast("string").alias("stage"), F.col(value).cast("double").alias(value)).groupBy("stage").applyInPandasWithState(update, "stage string, samples long, p50 double, p95 double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def value_counts(batch: DataFrame) -> DataFrame:
    """How often each value of a stage occurs: ``stage``, ``value``, ``n``; null values go."""
    return batch.where("value is not null").groupBy("stage", "value").agg(F.count("*").alias("n"))


def floor_percentiles(counts: DataFrame, shares: dict[str, Decimal]) -> DataFrame:
    """Percentiles by floor rank over all samples of a stage, exact (AGG14, NUM3).

    ``counts``: ``stage``, ``value``, ``n``; rows of one value add up. Values are cut into ranges,
    and the ranges' sums give each the ranks before it, so a stage that holds most values is no
    single task.
    """
    spark = counts.sparkSession
    path = scratch(spark, "ranges")
    ranges = counts.groupBy("stage", "value").agg(F.sum("n").alias("n")).repartitionByRange("stage", "value").withColumn("part", F.spark_partition_id())
    ranges.write.parquet(path)
    rows = spark.read.schema(ranges.schema).parquet(path)
    own = Window.partitionBy("stage")
    parts = rows.groupBy("stage", "part").agg(F.sum("n").alias("held"))
    parts = parts.select(F.col("stage").alias("s"), F.col("part").alias("p"), (F.sum("held").over(own.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(own).alias("samples"))
    ranked = rows.join(F.broadcast(parts), F.col("stage").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("stage", "part").orderBy("value")))
    rank = lambda share: F.least(F.col("samples") - 1, F.floor(F.col("samples") * F.lit(share)).cast("long"))
    at = lambda share: F.max(F.when((F.col("upto") - F.col("n") <= rank(share)) & (rank(share) < F.col("upto")), F.col("value")))
    return ranked.groupBy("stage").agg(F.max("samples").alias("samples"), *[at(share).alias(name) for name, share in shares.items()])


def all_percentiles(samples: DataFrame, stage: str, value: str, folder: str | None = None) -> DataFrame:
    """p50 and p95 by floor rank over every sample of a stage, as a stream run to its end.

    Of each batch the counts of its values are kept, so no state is held in memory and a batch
    that runs again replaces itself; a later call with the same folder adds what is new.
    """
    rows = samples.select(F.col(stage).cast("string").alias("stage"), F.col(value).cast("double").alias("value"))
    return floor_percentiles(run_to_end(rows, "append", folder=folder, each=value_counts), {"p50": Decimal("0.5"), "p95": Decimal("0.95")})


def first_writer(events: DataFrame, key: str, at: str, late: str = "2 days") -> DataFrame:
    """The first row of a key to arrive wins; later ones are dropped (STR9).

    A key is remembered for ``late`` after its event time, as long as a result is kept, so the
    state holds the keys of that span and no more.
    """
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_totals(events: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window with a bound on lateness; for progress reports of a running job."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).groupBy(F.window("_at", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a restarted run still has to do (STR3, STR4): work without a result of the same key."""
    return todo.join(done.select(*keys), keys, "left_anti")


def stale_results(results: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results whose page is still the one they were made for, and those that came too late (STR7)."""
    known = results.join(pages.select("page_id", "digest"), "page_id", "left")
    fresh = F.col("digest").eqNullSafe(F.col("base_digest"))
    return known.where(fresh).drop("digest"), known.where(~fresh).drop("digest")
