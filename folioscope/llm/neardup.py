"""Near copies by word shingles: MinHash bands for candidates, then the exact Jaccard similarity.

A text is the set of its shingles of ``SHINGLE`` lower-case words (hashed to 64 bits). Rows of
one set are one class, so copies cost nothing. ``BANDS`` bands of ``ROWS`` minimum hashes send
two classes of similarity 0.8 into one bucket with a chance of 1 - (1 - 0.8**4)**32, so a pair
at the threshold is missed once in 20 million, a closer one less often. Buckets with the same
members are compared once; a large bucket is cut into a grid of units (pairs of chunks), so no
task gets an unbounded bucket. In a unit the shared shingles are counted, and the links are a
spanning forest of the pairs with a Jaccard similarity of at least 0.8, all of them verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import connected_components, materialize, ship
from folioscope.llm.simhash import keep_least, near_duplicate_groups

#: Words of a shingle; the least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bands, minimum hashes of each; members of a bucket from which it is cut up.
BANDS, ROWS, UNIT_ROWS = 32, 4, 2048
_RNG = np.random.default_rng(5)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_MIX = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the text's shingles; a text under ``SHINGLE`` words is one, a blank one has none."""
    own = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    if not own:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = [0, *ends[: max(0, len(own) - SHINGLE)].tolist()]
    stops = (ends[min(SHINGLE, len(own)) - 1 :] - 1).tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, stops)], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` bucket keys for every set; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.zeros((len(sets), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        low = np.minimum.reduceat(flat * _MUL[i] + _ADD[i], starts)
        low ^= low >> np.uint64(31)
        out[:, i // ROWS] = (out[:, i // ROWS] ^ low) * _MIX[i] + np.uint64(i)
    return out ^ (out >> np.uint64(29))


def _prints(docs: DataFrame) -> DataFrame:
    """``id``, ``key`` (of the set of shingles), ``bands`` (none of a blank text): a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                bands = iter(band_keys(full).view(np.int64) if full else ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([next(bands) if len(s) else [] for s in sets], pa.list_(pa.int64()))], ["id", "key", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """``key`` and the sorted set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingles(t) for t in part.column(0).to_pylist()]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key long, shingles array<long>")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that span the components of the sets' similarity graph, breadth first."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.cumsum(n) - n
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(which, kind="stable")]
    left, out, queue = np.ones(len(sets), bool), [], []
    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        queue.append(start)
        while queue:
            x = queue.pop()
            own = which[ends[x] - sizes[x] : ends[x]]
            own = own[n[own] > 1]
            m = n[own]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - first[own], m)
            both = np.bincount(holders[at], minlength=len(sets))
            near = np.flatnonzero(left & (both * sum(SIMILAR) >= SIMILAR[0] * (sizes[x] + sizes)))
            left[near] = False
            out += [(x, int(y)) for y in near]
            queue.extend(near.tolist())
            if not left.any():
                return out
    return out


def near_copy_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Group the rows that are connected by pairs of similarity 0.8 or more.

    Blank and null texts have no shingle and are copies of each other; a null id takes part
    but never names a group. Returns the id column and ``component_id``, its group's smallest id.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    prints = materialize(_prints(texts), "prints")
    classes = materialize(prints.groupBy("key").agg(F.min("id").alias("least"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("key", F.explode("bands").alias("band"))
    # buckets with the same members are one: count, ends and two sums without carry tell them apart
    buckets = spread.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key")).alias("y")).where("n > 1")
    chosen = materialize(buckets.groupBy("n", "lo", "hi", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / unit_rows).cast("int").alias("g")), "buckets")
    mine = F.pmod(F.xxhash64("key", F.lit(7)), F.col("g")).cast("int")
    unit = F.when(F.col("g") == 1, F.array(F.col("band"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.xxhash64("band", F.least(mine, j), F.greatest(mine, j))))
    members = materialize(spread.join(chosen, "band").select("key", F.explode(unit).alias("unit")), "members")
    wanted = members.select("key").distinct().join(classes.select("key", "least"), "key")
    named = texts.where("id is not null").join(wanted.where("least is not null").select(F.col("least").alias("id")).distinct(), "id", "left_semi")
    sets = materialize(_sets(named.unionByName(texts.where("id is null"))).dropDuplicates(["key"]), "sets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = members.join(sets, "key").select("unit", "key", "shingles").repartition(parts, "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held = None, [], []

        def give() -> pa.RecordBatch:
            pairs = forest(held)
            return pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in pairs], pa.int64()), pa.array([keys[y] for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            flat, ends = batch.column(2).values.to_numpy().view(np.uint64), batch.column(2).offsets.to_numpy()
            for i, (u, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if u != now:
                    if held:
                        yield give()
                    now, keys, held = u, [], []
                keys.append(key)
                held.append(flat[ends[i] : ends[i + 1]].copy())
        if held:
            yield give()

    links = units.mapInArrow(run, "a long, b long")
    comps = connected_components(links)
    rooted = classes.select("key", "least").join(comps.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = materialize(rooted.select("key", "root").join(named, "root").select("key", "component_id"), "groups")
    return prints.select("id", "key").join(by_key, "key").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays, the one with the smallest id; rows without an id stay as well."""
    return keep_least(docs, near_copy_groups(docs, id_col=id_col, text_col=text_col), id_col)


def joint_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the rows that are connected by close SimHash fingerprints or by similar sets of shingles.

    Fingerprints (``near_duplicate_groups``) come first; shingles add the pairs that are more bits
    apart. Both depend on the text alone, so a hash of it stands for the row: links of either kind
    meet at equal texts, and rows without an id connect others too. Returns the id column and
    ``component_id``, the group's smallest id (null if it has none).
    """
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    prints = materialize(near_duplicate_groups(texts, id_col="h").select("h", F.col("component_id").alias("a")).distinct(), "by-print")
    sets = materialize(near_copy_groups(texts, id_col="h").select("h", F.col("component_id").alias("b")).distinct(), "by-set")
    comps = connected_components(prints.join(sets, "h").where("a <> b").select("a", "b").distinct())
    roots = prints.join(comps.select(F.col("node").alias("a"), "component"), "a", "left").select("h", F.coalesce("component", "a").alias("root"))
    rooted = materialize(texts.select("id", "h").join(roots, "h").select("id", "root"), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select(F.col("id").alias(id_col), "component_id")


def drop_joint_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``joint_groups`` stays, the one with the smallest id; rows without an id stay as well."""
    return keep_least(docs, joint_groups(docs, id_col=id_col, text_col=text_col), id_col)
