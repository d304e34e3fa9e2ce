"""Exact substring dedup by bucket-pointer refinement, spread over a cluster.

Every byte goes that a string of ``length`` (200) bytes covers which also starts elsewhere.
A suffix array of all positions would not fit any shuffle, so only some positions are
sorted, chosen by content:

1. *Buckets.* Every window of ``length`` bytes points to the least of its q-grams by hash, its
   anchor; equal windows have equal anchors at equal offsets. The windows of one anchor
   position are consecutive: one row with the anchor's bucket (the q-gram) and a second
   identifier of all bytes that these windows cover.
2. *Refinement.* A bucket of one row holds no repeated window. Rows of a bucket with the same
   second identifier are repeated as a whole. Only the other rows of larger buckets go on,
   one row for each second identifier.
3. *Refinement by later offsets.* These are judged in cells of 16 windows by the same two
   identifiers, and what is left of the cells by single windows, whose identifier is put
   together from those of its parts at later offsets, again and again: bytes give 32, those at
   offsets 0 and 32 give 64, 0 and 64 give 128, 0 and 72 give 200. With it goes the
   identifier of all its bytes at once. A window whose last bucket holds two rows with the
   same second identifier is repeated.

So every verdict rests on two identifiers of 64 bits each.

All bucket sizes are partial counts joined back, so neither a passage that a third of all
rows share nor a group of copies meets in one task; texts that occur twice are removed as a
whole and take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, ship

LENGTH, Q = 200, 32
#: Window starts that are worked on at once.
CHUNK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
_K1, _K2, _K3 = (np.uint64(int(x) * 2 + 1) for x in _rng.integers(1, 1 << 63, 3))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = max([0, *_POWERS])
    if size < n:
        up = np.full(n, np.uint64(_BASE & (2**64 - 1)))
        down = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    a, b = next(iter(_POWERS.values()))
    return a[:n], b[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of two parts from theirs."""
    return _mix(a * _K3 + (b ^ (b >> np.uint64(31))) * _K2)


class Buckets:
    """Identifiers of the strings in a stretch of bytes."""

    def __init__(self, raw: np.ndarray, q: int = Q):
        self.q = q
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_CODE[raw] * up[:-1], out=self.sums[1:])
        self.grams = _mix((self.sums[q:] - self.sums[:-q]) * self.down[: len(raw) + 1 - q]) if len(raw) >= q else np.zeros(0, np.uint64)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Identifier of the bytes from ``start`` to ``stop``."""
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * _K3)

    def windows(self, length: int) -> np.ndarray:
        """Identifier of the window of ``length`` bytes at each position, from those of its parts at later offsets."""
        ids, n = self.grams, self.q
        while n < length:
            step = min(n, length - n)
            ids, n = _pair(ids[:-step], ids[step:]), n + step
        return ids

    def anchors(self, length: int) -> np.ndarray:
        """Position of the least q-gram (the leftmost of equals) of the window at each position."""
        width = length - self.q + 1
        low = np.uint64((1 << 20) - 1)
        least = (self.grams & ~low) | np.arange(len(self.grams), dtype=np.uint64)
        n = 1
        while 2 * n <= width:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        if n < width:
            least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
        return (least & low).astype(np.int64)


def _stretches(texts: list[bytes], length: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts at a time with, for each text or part of one in it: which text,
    where it begins there, and at which byte of the text that is. Parts of a long text overlap,
    so that each window lies in exactly one."""
    held, which, offset, size = [], [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - length + 1), chunk):
            part = t[lo : lo + chunk + length - 1]
            held.append(part), which.append(i), offset.append(lo)
            size += len(part)
            if size >= chunk // 2:
                yield _stretch(held, which, offset)
                held, which, offset, size = [], [], [], 0
    if held:
        yield _stretch(held, which, offset)


def _stretch(held, which, offset):
    n = np.array([len(x) for x in held])
    return np.frombuffer(b"".join(held), np.uint8), np.array(which), np.cumsum(n) - n, np.array(offset)


def anchor_rows(texts: list[bytes], length: int = LENGTH, q: int = Q, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """For every anchor position: text, first window start, windows, bucket, second identifier, distance to the anchor."""
    out = []
    for raw, which, begin, offset in _stretches(texts, length, chunk):
        b = Buckets(raw, q)
        at = b.anchors(length)
        ends = np.append(begin[1:], len(raw))
        valid = np.zeros(len(raw) + 1, np.int8)
        np.add.at(valid, begin, 1)
        np.add.at(valid, ends - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[:-1])[: len(at)])
        own = at[starts]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        count = np.diff(np.append(first, len(own)))
        sa, a = starts[first], own[first]
        part = np.searchsorted(begin, sa, "right") - 1
        second = _pair(b.span(sa, sa + count - 1 + length), (a - sa).astype(np.uint64))
        out.append((which[part], sa - begin[part] + offset[part], count, b.grams[a], second, a - sa))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))


#: Windows of one anchor that are judged together before single ones are.
CELL = 16


def cell_rows(contexts: list[bytes], off: np.ndarray, count: np.ndarray, length: int, q: int, cell: int) -> tuple[np.ndarray, ...]:
    """Context, first window in it, windows, bucket and second identifier of every cell.

    A cell holds the windows whose distance to the anchor is in one stretch of ``cell``
    values. Its bucket is the string that all windows such a cell may hold have in common;
    its second identifier is that of what the windows present cover.
    """
    n = np.array([len(c) for c in contexts])
    begin = np.cumsum(n) - n
    b = Buckets(np.frombuffer(b"".join(contexts), np.uint8), q)
    low, high = (off - count + 1) // cell, off // cell
    per = high - low + 1
    row = np.repeat(np.arange(len(contexts)), per)
    c = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + low[row]
    j0 = np.maximum(off[row] - cell * c - cell + 1, 0)
    j1 = np.minimum(off[row] - cell * c, count[row] - 1)
    r0 = off[row] - cell * c
    at = begin[row]
    bucket = _pair(b.span(at + r0, at + r0 + length - cell + 1), c.astype(np.uint64))
    second = _pair(b.span(at + j0, at + j1 + length), (off[row] - j0).astype(np.uint64))
    return row, j0, j1 - j0 + 1, bucket, second


def window_rows(contexts: list[bytes], cells: list[list[dict]], length: int, q: int) -> tuple[np.ndarray, ...]:
    """Context, position in it, need and the two identifiers of each window of the given cells."""
    n = np.array([len(c) for c in contexts])
    begin = np.cumsum(n) - n
    b = Buckets(np.frombuffer(b"".join(contexts), np.uint8), q)
    ids = b.windows(length)
    flat = np.array([(i, x["first"], x["count"], x["need"]) for i, own in enumerate(cells) for x in own], np.int64).reshape(-1, 4)
    row, first, per, need = (np.repeat(flat[:, k], flat[:, 2]) for k in range(4))
    j = first + np.arange(len(row)) - np.repeat(np.cumsum(flat[:, 2]) - flat[:, 2], flat[:, 2])
    at = begin[row] + j
    return row, j, need.astype(bool), ids[at], b.span(at, at + length)


def with_keys(docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("_k1", "_k2")) -> DataFrame:
    """Adds two columns, which together stand for the text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({names[0]: F.xxhash64(text), names[1]: F.crc32(text) * F.lit(1 << 31) + F.octet_length(text)})


def _refine(rows: DataFrame, refs: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Split the rows of buckets that hold two rows or more.

    Returns the rows whose second identifier occurs twice, and one row for each second
    identifier of a bucket that has several, with ``need``: whether it is the only one.
    """
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("second").alias("lo"), F.max("second").alias("hi")).where("n > 1").select("bucket", F.expr("lo = hi").alias("same"))
    buckets = materialize(buckets, name)  # else the join would reuse the aggregation's partitions, which can't be split at a hot bucket
    live = materialize(rows.join(buckets, "bucket"), name)
    mixed = live.where("not same")
    parts = materialize(mixed.groupBy("bucket", "second").agg(F.count("*").alias("n"), F.min(F.struct(*refs)).alias("rep")), name)
    twice = mixed.join(parts.where("n > 1").select("bucket", "second"), ["bucket", "second"])
    return live.where("same").select(*refs).unionByName(twice.select(*refs)), parts.select("rep.*", F.expr("n = 1").alias("need"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """``_k1``, ``_k2``, ``copies`` and ``spans`` (``first`` window start and ``count``) of every text
    that occurs twice or holds repeated windows."""
    spark = docs.sparkSession
    ship(spark)
    i64 = lambda x: pa.array(np.asarray(x).astype(np.int64))
    hashed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    keyed = with_keys(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                k1, k2, texts = (part.column(i).to_pylist() for i in range(3))
                own = []
                for i, key in enumerate(zip(k1, k2)):  # copies that come together take part once
                    if key not in seen and key[1] % (1 << 31) >= length:
                        seen.add(key)
                        own.append(i)
                if len(seen) > 500_000:
                    seen.clear()
                if not own:
                    continue
                which, first, count, bucket, second, off = anchor_rows([texts[i].encode() for i in own], length, q, chunk)
                at = np.array(own)[which]
                yield pa.RecordBatch.from_arrays([i64(np.array(k1)[at]), i64(np.array(k2)[at]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32)), hashed(bucket), hashed(second)], ["_k1", "_k2", "first", "count", "off", "bucket", "second"])

    keys = materialize(keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("copies"), F.min("id").alias("holder")), "keys")
    rows = materialize(keyed.where(F.octet_length("text") >= length).select("_k1", "_k2", "text").mapInArrow(anchors, "_k1 long, _k2 long, first int, count int, off int, bucket long, second long"), "anchors")
    whole, left = _refine(rows, ["_k1", "_k2", "first", "count", "off"], "buckets")

    # what is left goes on with the bytes around it, taken from one copy of each text
    wanted = left.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("first", "count", "off", "need")).alias("list")).join(keys, ["_k1", "_k2"])
    one = keyed.join(wanted.withColumnRenamed("_k1", "a").withColumnRenamed("_k2", "b"), (F.col("_k1") == F.col("a")) & (F.col("_k2") == F.col("b")) & F.col("id").eqNullSafe(F.col("holder")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                cols: list[list] = [[] for _ in range(7)]
                for k1, k2, text, own in zip(*(part.column(i).to_pylist() for i in range(4))):
                    raw = text.encode()
                    for x in own:
                        for col, v in zip(cols, (k1, k2, x["first"], x["count"], x["off"], x["need"], raw[x["first"] : x["first"] + x["count"] - 1 + length])):
                            col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["_k1", "_k2", "first", "count", "off", "need", "bytes"])

    contexts = one.select("_k1", "_k2", "text", "list").mapInArrow(cut, "_k1 long, _k2 long, first int, count int, off int, need boolean, bytes binary")
    contexts = materialize(contexts.withColumn("ctx", F.monotonically_increasing_id()), "contexts")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                ctx, off, count, need, raw = part.columns
                row, first, n, bucket, second = cell_rows(raw.to_pylist(), off.to_numpy().astype(np.int64), count.to_numpy().astype(np.int64), length, q, cell)
                yield pa.RecordBatch.from_arrays([i64(ctx.to_numpy()[row]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(need.to_numpy(zero_copy_only=False)[row]), hashed(bucket), hashed(second)], ["ctx", "first", "count", "asked", "bucket", "second"])

    rows = materialize(contexts.select("ctx", "off", "count", "need", "bytes").mapInArrow(cells, "ctx long, first int, count int, asked boolean, bucket long, second long"), "cells")
    in_cells, left = _refine(rows, ["ctx", "first", "count", "asked"], "cells")
    asked = left.groupBy("ctx").agg(F.collect_list(F.struct("first", "count", (F.col("need") & F.col("asked")).alias("need"))).alias("list"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                k1, k2, first, raw, own = part.columns
                row, j, need, ids, second = window_rows(raw.to_pylist(), own.to_pylist(), length, q)
                yield pa.RecordBatch.from_arrays([hashed(ids), hashed(second), i64(k1.to_numpy()[row]), i64(k2.to_numpy()[row]), pa.array((first.to_numpy()[row] + j).astype(np.int32)), pa.array(need)], ["bucket", "second", "_k1", "_k2", "first", "need"])

    single = contexts.join(asked, "ctx").select("_k1", "_k2", "first", "bytes", "list").mapInArrow(windows, "bucket long, second long, _k1 long, _k2 long, first int, need boolean")
    single = materialize(single, "windows")
    twice = materialize(single.groupBy("bucket", "second").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "second"), "repeated")
    in_windows = single.where("need").join(twice, ["bucket", "second"]).select("_k1", "_k2", "first", F.lit(1).alias("count"))
    in_cells = contexts.select("ctx", "_k1", "_k2", F.col("first").alias("base")).join(in_cells.where("asked"), "ctx").select("_k1", "_k2", (F.col("base") + F.col("first")).alias("first"), "count")
    found = whole.select("_k1", "_k2", "first", "count").unionByName(in_cells).unionByName(in_windows)
    spans = found.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("first", "count")).alias("spans"))
    out = keys.select("_k1", "_k2", "copies").join(spans, ["_k1", "_k2"], "left").where("copies > 1 or spans is not null")
    return materialize(out, "spans")


def _kept(raw: bytes, copies: int, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Removed stretches (start, stop), in order."""
    if copies > 1:
        return [(0, len(raw))] if len(raw) >= length else []
    out: list[list[int]] = []
    for first, stop in sorted((x["first"], x["first"] + x["count"] - 1 + length) for x in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def _without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in gone:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _whole_characters(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches widened to whole characters, so that what stays is text."""
    out = []
    for a, b in gone:
        while a and raw[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return out


def substring_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """What exact substring dedup removes from each document.

    A null text counts as empty; texts under ``length`` bytes lose nothing; of repeated rows
    and copies every one is removed (the strings are judged on the input); other columns are
    ignored; an empty table gives none.

    Returns the id column, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, length=length, q=q, cell=cell, chunk=chunk)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                raw = (text or "").encode()
                gone = _kept(raw, copies or 1, own, length)
                out.append((len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_without(raw, gone)).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = with_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).join(spans, ["_k1", "_k2"], "left")
    return joined.select("id", "text", "copies", "spans").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def drop_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The same table with the repeated strings taken out of its texts (whole characters go).

    A null text stays null; texts under ``length`` bytes stay as they are; a text that occurs
    twice becomes empty in every row that has it, rows without an id too; ``chars_col``, if
    there is one, is counted anew; all columns stay, whatever their names; an empty table
    gives none.
    """
    length = options.get("length", LENGTH)
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, copies, own in zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1))):
                raw = (text or "").encode()
                gone = _kept(raw, copies or 1, own, length)
                texts.append(_without(raw, _whole_characters(raw, gone)).decode() if gone else text)
            cols = batch.columns[: len(names)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    # names that the table does not have
    own = ["_k1", "_k2", "_copies", "_spans"]
    while set(own) & {n.lower() for n in names}:
        own = [f"_{n}" for n in own]
    spans = spans.withColumnsRenamed(dict(zip(["_k1", "_k2", "copies", "spans"], own)))
    joined = with_keys(docs, text_col, tuple(own[:2])).join(spans, own[:2], "left").select(*names, *own[2:])
    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in names else out


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes in all ``documents``."""
    from folioscope.llm.common import table

    return substring_digests(table(spark, sf_dir, "documents"))
