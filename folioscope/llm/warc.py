"""WARC archives: write, index first, then coalesced byte-range reads.

``write_archives`` turns pages into WARC/1.1 records and writes them with Spark's text
writer, whose line separator is the blank lines that end a record; so the files come
through Spark's commit protocol and any file system that Spark writes to will do. Of pages
with equal payloads one is stored, the others are revisit records. ``index_archives`` walks
every file once, header by header, and gives offset, length, URL and digest of each record.
``read_records`` takes the selected index rows, sorts them by file and offset, merges
neighbouring ranges and reads each merged range in one go.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, scratch, ship

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Ranges are merged over gaps of at most so many bytes, up to a read of so many.
GAP, READ = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each ten digits are eight letters."""
    letters = []
    for g in range(4):
        v = F.conv(F.substring(hex40, 1 + 10 * g, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(ALPHABET), (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per page below ``path``.

    Payloads are compared by their SHA-1. Of equal payloads of at least ``least_payload``
    bytes the page with the largest id is the response (rows that repeat this id are
    responses too); a null id is a response only where no other has the payload. Only
    digests that occur twice are looked up; their table is written first, so that Spark knows
    its size and sends the payloads through a shuffle only if it is too large to broadcast
    (a digest that many pages share is then split by adaptive execution).
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[body_col], F.lit("")).alias("body"))
    digest = F.sha1("body")
    stored = rows.select("id", digest.alias("sha")).groupBy("sha").agg(F.max("id").alias("holder"), F.count("*").alias("n"))
    shared = materialize(stored.where("n > 1").select("sha", "holder"), "holders")
    known = rows.withColumn("sha", digest).join(shared.withColumn("shared", F.lit(True)), "sha", "left")
    known = known.withColumn("holder", F.when(F.col("shared"), F.col("holder")).otherwise(F.col("id")))
    size = F.octet_length("body")
    response = F.col("id").eqNullSafe(F.col("holder")) | (size < least_payload)
    urn = lambda c: F.concat(F.lit("<urn:md5:"), F.md5(F.coalesce(c.cast("string"), F.lit(""))), F.lit(">"))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20"), F.lit("urn:page:unknown"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"), F.col("body"))
    block = F.when(response, http).otherwise("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))),
        F.when(response, "").otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("holder"))), F.coalesce(line("X-Refers-To-Id", F.col("holder").cast("string")), F.lit("")))),
        line("X-Payload-Length", size.cast("string")),
        F.coalesce(line("X-Page-Id", F.col("id").cast("string")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    known.select(F.concat(head, block)).write.option("lineSep", END).option("compression", "none").text(path)


def _open(path: str):
    """A file on any store that Arrow reaches (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


INDEX = "path string, offset long, length long, url string, digest string, kind string, id string, refers_to string, payload_bytes long"


def index_archives(spark: SparkSession, path: str, window: int = 1 << 20) -> DataFrame:
    """Where each record of the archives below ``path`` is, from one walk over each file."""
    ship(spark)

    def walk(path: str) -> Iterator[tuple]:
        with _open(path) as f:
            size, at, start, held = f.size(), 0, 0, b""
            while at < size:
                want, stop = window, -1
                while True:
                    if not (start <= at and at + min(want, size - at) <= start + len(held)):
                        start, held = at, f.read_at(min(want, size - at), at)
                    stop = held.find(b"\r\n\r\n", at - start)
                    if stop >= 0 or start + len(held) >= size:
                        break
                    want *= 2
                if stop < 0:
                    raise ValueError(f"{path}: the record at {at} has no end of its header")
                x = _fields(held[at - start : stop])
                length = stop - (at - start) + 4 + int(x["content-length"])
                yield path, at, length, x.get("warc-target-uri"), x.get("warc-payload-digest", "").removeprefix("sha1:"), x["warc-type"], x.get("x-page-id"), x.get("x-refers-to-id"), int(x.get("x-payload-length", -1))
                at += length + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in INDEX.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        held = []
        for b in batches:
            for p in b.column(0).to_pylist():
                for row in walk(p):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path")
    return files.mapInArrow(run, INDEX)


def read_records(selected: DataFrame, *, gap: int = GAP, most: int = READ, bodies: bool = False) -> DataFrame:
    """The records that rows of an index name, read in merged ranges.

    Returns the index's columns, ``payload_digest`` and ``payload_size`` as found in the
    record (of the full payload; for a revisit as its header states) and, with ``bodies``,
    ``body``. A payload that does not have the digest its header states is an error.
    """
    spark = selected.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = selected.repartition(parts, "path", F.floor(F.col("offset") / most)).sortWithinPartitions("path", "offset")
    columns = [x.split()[0] for x in INDEX.split(", ")]

    def record(raw: bytes) -> tuple[str, int, str | None]:
        head, _, block = raw.partition(b"\r\n\r\n")
        x = _fields(head)
        stated = x["warc-payload-digest"].removeprefix("sha1:")
        if x["warc-type"] == "revisit":
            return stated, int(x["x-payload-length"]), None
        body = block.partition(b"\r\n\r\n")[2]
        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if found != stated:
            raise ValueError(f"{x.get('warc-record-id')}: the payload's digest is {found}, the header states {stated}")
        return found, len(body), body.decode() if bodies else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, offsets, lengths = (b.column(k).to_pylist() for k in range(3))
            i, out = 0, []
            opened, f = None, None
            try:
                while i < len(paths):
                    j, stop = i + 1, offsets[i] + lengths[i]
                    while j < len(paths) and paths[j] == paths[i] and offsets[j] - stop <= gap and offsets[j] + lengths[j] - offsets[i] <= most:
                        stop = max(stop, offsets[j] + lengths[j])
                        j += 1
                    if opened != paths[i]:
                        if f:
                            f.close()
                        opened, f = paths[i], _open(paths[i])
                    held = memoryview(f.read_at(stop - offsets[i], offsets[i]))
                    out += [record(bytes(held[offsets[k] - offsets[i] :][: lengths[k]])) for k in range(i, j)]
                    i = j
                    if bodies and sum(x[1] for x in out) > most or i >= len(paths):
                        done = b.slice(i - len(out), len(out))
                        cols = [*done.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())]
                        names = [*columns, "payload_digest", "payload_size"]
                        if bodies:
                            cols.append(pa.array([x[2] for x in out], pa.string()))
                            names.append("body")
                        yield pa.RecordBatch.from_arrays(cols, names)
                        out = []
            finally:
                if f:
                    f.close()

    return ordered.select(*columns).mapInArrow(run, INDEX + ", payload_digest string, payload_size long" + ", body string" * bodies)


def round_trip(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write pages as archives, index them, and read every record back.

    A null payload counts as empty, a null URL gets a placeholder in the header; repeated
    rows give records of their own; other columns are ignored; an empty table gives none.

    Returns the id column, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.
    """
    write_archives(pages, path, id_col=id_col, url_col=url_col, body_col=body_col)
    index = materialize(index_archives(pages.sparkSession, path), "index")
    kind = pages.schema[id_col].dataType
    return read_records(index).select(F.col("id").cast(kind).alias(id_col), F.col("payload_size").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` into WARC archives and back."""
    from folioscope.llm.common import table

    return round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


_V = "CAST(('0x' || substr(h, {0}, 10)) AS BIGINT)"
_LETTERS = " || ".join(f"substr('{ALPHABET}', CAST((({_V.format(1 + 10 * g)} >> {35 - 5 * k}) & 31) + 1 AS BIGINT), 1)" for g in range(4) for k in range(8))
OP6_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT h, max(page_id) AS holder FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM holder THEN NULL ELSE holder END AS refers_to
FROM p JOIN r USING (h)
"""
