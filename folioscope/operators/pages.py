"""Page-local folds: state that is carried from row to row of one page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from folioscope.cluster import ship


def fold_pages(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict[str, Any]]], list[tuple]], schema: str, *, batch_rows: int = 20_000) -> DataFrame:
    """Apply ``fold`` to the ordered rows of each page.

    One shuffle by page, then a sorted walk over Arrow batches: thousands of pages share one
    Python call, which a group-by-group ``applyInPandas`` would make for each. Memory is
    bounded by a batch and one page. ``fold`` gets dictionaries and returns tuples that fit
    ``schema``. Pages have no rows in common, so nothing else is shuffled.
    """
    ship(df.sparkSession)
    out_type: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_type)
    # by a hash of the key: over a union whose sides are partitioned by the key itself the planner takes a
    # repartition by that key for done and drops it, and adaptive execution then parts the sides again
    ordered = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: list[dict[str, Any]] = []
        at: tuple | None = None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at and page:
                    done += fold(page)
                    page = []
                at = key
                page.append(row)
            if len(done) >= batch_rows:
                yield batch()
                done = []
        if page:
            done += fold(page)
        yield batch()

    return ordered.mapInArrow(run, out_type)
