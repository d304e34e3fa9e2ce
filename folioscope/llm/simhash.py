"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints of 64 bits are linked at ``threshold`` (at most 5) or fewer differing bits.
The bits are cut into three blocks, so linked fingerprints differ by at most one bit in one
of them. In each block the codewords of a covering code are the anchors: the perfect
Hamming code over 15 bits (covering radius 1), times all values of the other bits. Within a
block a fingerprint has one home anchor at distance 0 or 1 and is replicated to every
anchor within 1 + 1 bits (about 15); the homes of an anchor are compared with its replicas.

Only distinct fingerprints take part, so copies cost nothing. There are 524,288 anchors, so with
enough fingerprints all are large. An anchor with more than ``unit_rows`` rows is refined by
joint keys: of ``threshold + 1`` parts of the other bits linked fingerprints have one in common; a
home and a replica meet under the anchor and that part. What is still large under a joint key is cut into a grid of
units (home chunk x replica chunk) of ``unit_rows`` rows each way, so no task gets an unbounded
unit at any size; a large unit gives a spanning forest of its links rather than all of them,
which leaves components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import connected_components, materialize, ship

#: (first bit, bits) of the blocks; the lowest 15 bits of each are the Hamming part.
BLOCKS = ((0, 22), (22, 21), (43, 21))
_CHECKS = tuple(sum(1 << i for i in range(15) if (i + 1) >> k & 1) for k in range(4))
#: Rows of an anchor, or of a joint key, from which it is cut up; joint keys up to which a table of them is broadcast (24 bytes each).
UNIT_ROWS, BROADCAST_KEYS = 4096, 500_000


def _masks(syndrome: int, width: int, radius: int) -> list[int]:
    """What to XOR a block with to get every anchor within the radius; the home anchor comes first."""
    flips = {d: [] for d in range(3)}
    for d in range(3):
        for bits in combinations(range(15), d):
            s = 0
            for b in bits:
                s ^= b + 1
            if s == syndrome:
                flips[d].append(sum(1 << b for b in bits))
    rest = range(15, width)
    out = []
    for d, own in flips.items():
        for more in range(radius - d + 1):
            out += [m | sum(1 << b for b in bits) for m in own for bits in combinations(rest, more)]
    return out


def shingle_fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text: bit i is set if it is set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    out, hashes, sizes, at = np.zeros(len(texts), np.uint64), [], [], []

    def flush() -> None:
        if not at:
            return
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        on = counts * 2 > np.array(sizes)[:, None]
        out[np.array(at)] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
        hashes.clear(), sizes.clear(), at.clear()

    for i, text in enumerate(texts):
        own = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces are meant
        if not own:
            continue
        joined, n = b" ".join(own), max(1, len(own) - words + 1)
        ends = np.cumsum([len(w) + 1 for w in own])
        starts = [0, *ends[: n - 1].tolist()]
        stops = (ends[min(words, len(own)) - 1 :] - 1).tolist()
        hashes.extend([digest(joined[a:b], seed) for a, b in zip(starts, stops)])
        sizes.append(n)
        at.append(i)
        if len(hashes) > 200_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the unsigned fingerprint in a signed long) of every row: a map without a shuffle.

    Null and blank texts have fingerprint zero.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                fp = shingle_fingerprints(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _forest(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, breadth first."""
    a, b, left, queue = [], [], np.unique(fps), []
    while queue or len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = left[0], left[1:]
        near = np.bitwise_count(left ^ x) <= threshold
        if near.any():
            found = left[near]
            a.append(np.full(len(found), x))
            b.append(found)
            queue.extend(found)
            left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(unit: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int, pairs_at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and replicas of the same unit; rows come sorted by unit."""
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(unit)])))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    large = homes * sizes > 4096
    a, b = [], []
    for u in np.flatnonzero(large):
        x, y = _forest(fp[starts[u] : starts[u] + sizes[u]], threshold)
        a.append(x), b.append(y)
    of = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(home & ~large[of])
    todo = np.cumsum(sizes[of[at]])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(todo, (todo[lo - 1] if lo else 0) + pairs_at_once)))
        own = at[lo:hi]
        n = sizes[of[own]]
        x = np.repeat(fp[own], n)
        y = fp[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[of[own]], n)]
        near = (x != y) & (np.bitwise_count(x ^ y) <= threshold)
        a.append(x[near]), b.append(y[near])
        lo = hi
    none = np.zeros(0, np.uint64)
    x, y = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0) if len(x) else np.zeros((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


def _row(block: Column, k: int):
    """What a mask makes of a block: the anchor, and whether it is the home."""
    return lambda mask, i: F.struct((F.lit(k << 22) + block.bitwiseXOR(mask)).alias("anchor"), (i == 0).alias("home"))


def _hot(spread: DataFrame, key: str, unit_rows: int, name: str) -> DataFrame:
    """Keys of more than ``unit_rows`` rows with their rows ``n`` and homes ``h``; written, so that joins see its size."""
    counts = spread.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("h"))
    return materialize(counts.where(F.col("n") > unit_rows), name)


def _sized(table: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Broadcast a table whose size is known to be small; a larger one is joined by shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def _block_place() -> tuple[Column, Column]:
    """First bit and width of the block that a row's anchor belongs to."""
    first = {k: lo for k, (lo, _) in enumerate(BLOCKS)}
    width = {k: w for k, (_, w) in enumerate(BLOCKS)}
    block = F.shiftrightunsigned("anchor", 22)
    choose = lambda of: F.when(block == 0, F.lit(of[0])).when(block == 1, F.lit(of[1])).otherwise(F.lit(of[2]))
    return choose(first).cast("int"), choose(width).cast("int")


def links(distinct_fps: DataFrame, *, threshold: int = 4, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``a``, ``b``: enough links between different fingerprints (column ``fp``) to span every component.

    No fingerprint is left out at any size; a null fingerprint has no link; repeated ones do no
    harm; an empty table gives none.
    """
    if not 0 <= threshold <= 5:
        raise ValueError("three blocks serve thresholds from 0 to 5")
    ship(distinct_fps.sparkSession)
    slack = threshold // 3
    rows = []
    for k, (first, width) in enumerate(BLOCKS):
        block = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        syndrome = sum(((F.bit_count(block.bitwiseAND(F.lit(c))) % 2) * (1 << i) for i, c in enumerate(_CHECKS)), F.lit(0))
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in _masks(s, width, 1 + slack)]) for s in range(16)])
        rows.append(F.transform(F.element_at(masks, (syndrome + 1).cast("int")), _row(block, k)))
    spread = distinct_fps.where("fp is not null").select("fp", F.explode(F.flatten(F.array(*rows))).alias("r")).select("fp", "r.anchor", "r.home")
    # at most one row for each of the 524,288 anchors, whatever the input
    hot = _hot(spread, "anchor", unit_rows, "anchors").select("anchor", F.lit(True).alias("hot"))
    known = spread.join(F.broadcast(hot), "anchor", "left")
    plain = known.where("hot is null").select(F.col("anchor").alias("unit"), "fp", "home")
    units = plain
    if hot.limit(1).count():
        low, n = _block_place()
        # the fingerprint turned until its block's bits are the highest; the 42 or 43 others are the lowest
        rest = F.expr("shiftrightunsigned(fp, _low + _n) | CASE WHEN _low > 0 THEN shiftleft(fp & (shiftleft(1L, _low) - 1), 64 - _low - _n) ELSE 0L END")
        joint = known.where("hot").withColumns({"_low": low, "_n": n}).withColumn("_rest", rest)
        parts = threshold + 1  # one more than the bits that may differ, so one part is equal
        cut = lambda j: (F.shiftrightunsigned("_rest", (43 * j) // parts).bitwiseAND(F.lit((1 << ((43 * (j + 1)) // parts - (43 * j) // parts)) - 1)))
        keyed = joint.select("fp", "home", F.explode(F.array(*[F.xxhash64("anchor", F.lit(j), cut(j)) for j in range(parts)])).alias("key"))
        large = _sized(_hot(keyed, "key", unit_rows, "joint").select("key", F.ceil(F.col("n") / unit_rows).alias("nr"), F.ceil(F.greatest("h", F.lit(1)) / unit_rows).alias("nh")))
        sized = keyed.join(large, "key", "left")
        chunk = F.xxhash64("fp", F.lit(1))
        # chunk i of the homes meets chunk j of all rows in the unit (key, i, j)
        unit = lambda i, j: F.xxhash64("key", i.cast("long"), j.cast("long"))
        alone = F.array(F.struct(F.xxhash64("key", F.lit(-1)).alias("unit"), F.col("home").alias("home")))
        grid = F.concat(
            F.transform(F.sequence(F.lit(0), F.col("nh").cast("int") - 1), lambda i: F.struct(unit(i, F.pmod(chunk, F.col("nr"))).alias("unit"), F.lit(False).alias("home"))),
            F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nr").cast("int") - 1), lambda j: F.struct(unit(F.pmod(chunk, F.col("nh")), j).alias("unit"), F.lit(True).alias("home")))).otherwise(F.array().cast("array<struct<unit:bigint,home:boolean>>")),
        )
        replicas = F.when(F.col("nr").isNull(), alone).otherwise(grid)
        units = plain.unionByName(sized.select("fp", F.explode(replicas).alias("u")).select("u.unit", "fp", "u.home"))
    parts = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = units.repartition(parts, "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        names = ["a", "b"]

        def give(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = _links(*rows, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            u, f, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(u, u[-1]))  # the last unit may go on
            if cut or held and held[0][0][-1] != u[0]:
                held.append((u[:cut], f[:cut], h[:cut]))
                yield give(tuple(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((u[cut:], f[cut:], h[cut:]))
        if held:
            yield give(tuple(np.concatenate(x) for x in zip(*held)))

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, *, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Group the rows whose fingerprints are connected by links.

    Null or blank texts have fingerprint zero and are linked like any other; texts under four
    words are one shingle; repeated rows fall into the same group; a null id takes part but
    never names a group; columns besides the two named are ignored; an empty table gives none.

    Returns the id column, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id
    of the group, null if it has none).
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    comps = connected_components(links(classes.select("fp"), threshold=threshold, unit_rows=unit_rows))
    rooted = classes.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "groups")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is their group's ``component_id``, one row an id, and the rows without an id."""
    keep = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    repeated = known.groupBy(id_col).count().where("count > 1").select(id_col)
    kept = known.join(keep, id_col, "left_semi")
    if repeated.limit(1).count():
        once = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
        kept = kept.join(repeated, id_col, "left_anti").unionByName(once)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def drop_near_duplicates(docs: DataFrame, *, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group stays, the one with the smallest id, with its columns.

    Rows without an id can't be named and stay; of rows that repeat the kept id one stays. Null
    and blank texts have fingerprint zero and are one group; long texts are read whole; an
    empty table gives none.
    """
    return keep_least(docs, near_duplicate_groups(docs, threshold=threshold, id_col=id_col, text_col=text_col), id_col)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``."""
    from folioscope.llm.common import table

    return near_duplicate_groups(table(spark, sf_dir, "documents"))
