"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of one group (equal texts) go to one shard. Groups enter in order of decreasing size,
each into the shard with the tightest remaining capacity that takes it; the shards hang in a
balanced tree by remaining capacity. Groups of one size class are interchangeable, so the
packing runs over the histogram of size classes, not over groups: the classes are the sizes
rounded up to ``SIGNIFICANT`` binary digits, which bounds the histogram whatever the table
holds. A group over an even share of the bytes can't stay whole under the law of near-equal
bytes and is first cut into pieces by a hash of the row's id.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioscope.llm.common import materialize

#: Binary digits of a size class: at most 2^12 classes for each doubling of the size.
SIGNIFICANT = 13
#: Chunks in which ranks are counted; more on larger tables.
ROWS_PER_CHUNK = 500_000


@dataclass
class _Node:
    key: tuple[int, int]
    rank: float
    left: _Node | None = None
    right: _Node | None = None


class CapacityTree:
    """A treap of (remaining capacity, bin): searches and updates in logarithmic time."""

    def __init__(self):
        self._root: _Node | None = None
        self._dice = random.Random(1)

    def add(self, room: int, bin_: int) -> None:
        a, b = self._split(self._root, (room, bin_))
        self._root = self._merge(self._merge(a, _Node((room, bin_), self._dice.random())), b)

    def remove(self, room: int, bin_: int) -> None:
        a, b = self._split(self._root, (room, bin_))
        _, b = self._split(b, (room, bin_ + 1))
        self._root = self._merge(a, b)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The entry with the least room that is at least ``size``."""
        at, best = self._root, None
        while at:
            if at.key >= (size, -1):
                best, at = at.key, at.left
            else:
                at = at.right
        return best

    def roomiest(self) -> tuple[int, int]:
        at = self._root
        while at.right:
            at = at.right
        return at.key

    def _split(self, at: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if at is None:
            return None, None
        if at.key < key:
            at.right, rest = self._split(at.right, key)
            return at, rest
        rest, at.left = self._split(at.left, key)
        return rest, at

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]]:
    """Pack ``(size, how many)`` and return ``(size, bin, how many)`` in the order of packing.

    With ``bins`` None as many bins are opened as the capacity asks for (an item over the
    capacity gets a bin of its own); else what fits nowhere goes, one by one, to the bin with
    the most room. Items of a size that share a bin are placed at once: after the first the
    same bin is the tightest as long as it takes another.
    """
    tree, opened, out = CapacityTree(), bins or 0, []
    for b in range(opened):
        tree.add(capacity, b)
    for size, count in sorted(histogram, reverse=True):
        while count:
            found = tree.tightest(size)
            if found is None and bins is None:
                tree.add(max(capacity, size), opened)
                opened += 1
                continue
            room, b = found or tree.roomiest()
            n = min(count, room // size) if found and size else 1 if not found else count
            tree.remove(room, b)
            tree.add(room - n * size, b)
            if out and out[-1][:2] == (size, b):
                out[-1] = (size, b, out[-1][2] + n)
            else:
                out.append((size, b, n))
            count -= n
    return out


def _size_class(size: Column) -> Column:
    """The size rounded up to its leading binary digits."""
    bits = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) + 1
    unit = F.pow(F.lit(2.0), F.greatest(bits - SIGNIFICANT, F.lit(0)))
    return (F.ceil(size / unit) * unit).cast("long")


def _ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, rows: int) -> DataFrame:
    """Gapless ``rank`` from 0 within ``keys`` without gathering a key: chunks by hash are ranked
    alone and shifted by the counts of the chunks before. ``order`` makes the rank repeatable."""
    chunks = max(16, -(-rows // ROWS_PER_CHUNK))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    sizes = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    return df.withColumn("_own", own).join(shift, [*keys, "_chunk"]).withColumn(rank, (F.col("_own") + F.col("_shift")).cast("long")).drop("_chunk", "_own", "_shift")


def shard_by_bytes(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes; rows of equal text share one.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. A null text and an empty
    one are different groups. Only groups over an even share of all bytes are cut up. Rows
    that are repeated are rows of their own and get slots of their own; a null id is an id
    like any other; other columns are ignored; an empty table gives none.

    Returns the id column, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).select(
        "id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit(""))).alias("group"),
    )
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in (("size", T.LongType()), ("text_crc32", T.LongType()), ("law", T.StringType()), ("shard", T.IntegerType()), ("slot", T.LongType()), ("grown_shard", T.IntegerType()))]]))
    capacity = -(-total["bytes"] // shards)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    # fewer than `shards` groups can be over an even share
    over = groups.where(F.col("bytes") > capacity).select("group", F.ceil(F.col("bytes") / F.lit(max(1, capacity // 64))).alias("pieces"))
    pieces = rows.join(F.broadcast(over), "group", "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("long")).drop("pieces")
    units = materialize(pieces.groupBy("group", "piece").agg(F.sum("size").alias("bytes")).withColumn("class", _size_class(F.col("bytes"))), "units")
    histogram = units.groupBy("class").count().collect()
    packed = best_fit_decreasing([(r["class"], r["count"]) for r in histogram], capacity, shards)
    steps, at = [], {}
    for size, b, n in packed:
        steps.append((size, at.get(size, 0), at.get(size, 0) + n, b))
        at[size] = at.get(size, 0) + n
    # a class that overflows one by one gives a step for each; steps are at most classes x shards then
    plan = spark.createDataFrame(_joined(steps), "class long, first long, until long, shard int")
    ranked = _ranked(units, ["class"], ["group", "piece"], "rank", sum(r["count"] for r in histogram))
    placed = ranked.join(F.broadcast(plan), (ranked["class"] == plan["class"]) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["until"])).select("group", "piece", "shard")
    placed = materialize(placed, "placed")
    out = materialize(pieces.join(placed, ["group", "piece"]).select("id", "size", "text_crc32", "shard"), "shards")
    out = _ranked(out.withColumn("_tie", F.monotonically_increasing_id()), ["shard"], ["id", "_tie"], "slot", total["rows"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _joined(steps: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Steps by class and shard, so that their number is at most classes x shards."""
    per: dict[tuple[int, int], int] = {}
    for size, lo, hi, b in steps:
        per[size, b] = per.get((size, b), 0) + hi - lo
    out, at = [], {}
    for (size, b), n in per.items():
        lo = at.get(size, 0)
        out.append((size, lo, lo + n, b))
        at[size] = lo + n
    return out


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` into eight shards of near-equal bytes."""
    from folioscope.llm.common import table

    return shard_by_bytes(table(spark, sf_dir, "documents"))
