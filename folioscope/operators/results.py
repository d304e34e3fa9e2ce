"""Stored results: the public form of a document's pages and checks of what was stored."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from folioscope.operators.jobs import FAILURE_CODES, MOST_PAGES, MOST_RESULT_BYTES, SHA256

# The failure that the public sees, the compact form's version, and how ids look.
FAILED_PAGE = ("page_failed", "Page could not be parsed.")
COMPACT_VERSION = "compact-v1"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
EXECUTION_ID = "^[0-9a-f]{32}$"

#: Field-level schemas for readers of stored records (VAL9).
SCHEMAS = {
    "geometry": "width double, height double, pointWidth double, pointHeight double, pointBounds array<double>, rotation int, viewportTransform array<double>",
    "native_observation": "id string, pageNumber int, text string, box array<double>, pointBox array<double>, geometryMethod string, mcid int, structureRole string, font string, fontSize double",
    "ocr_observation": "id string, pageNumber int, text string, box array<double>, confidence double, polygon array<array<double>>, recoveryMethod string",
    "provenance": "parserName string, parserVersion string, nativeAdapter string, ocrAdapter string, regionRecoveryAdapter string, renderer string, backend string, configuration map<string,string>",
    "projection": "source string, markdown string, warnings array<string>",
}


def schema_of(name: str) -> StructType:
    """One of the field-level schemas (VAL9)."""
    return _parse_datatype_string(SCHEMAS[name])


def json_schema(df: DataFrame) -> str:
    """A table's schema as JSON, for consumers of the files (SNK5)."""
    return json.dumps(json.loads(df.schema.json()), sort_keys=True, indent=1)


def public_pages(pages: DataFrame) -> DataFrame:
    """What the public sees of each page (REC17): evidence and compact form as JSON, or the one public
    failure. ``pages``: job_id, page_number, ok, evidence, compact (JSON texts)."""
    failure = F.to_json(F.struct(F.lit(FAILED_PAGE[0]).alias("code"), F.lit(FAILED_PAGE[1]).alias("message")))
    shown = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(failure)
    return pages.select("job_id", "page_number", "ok", shown("evidence").alias("evidence"), shown("compact").alias("compact"))


def page_order_violations(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Jobs whose pages are not 1, 2, … up to at most 200, each once with an outcome (REC17, VAL8): one
    aggregation, no window. ``pages``: job_id, page_number, ok."""
    sums = pages.groupBy("job_id").agg(F.count("*").alias("n"), F.count_distinct("page_number").alias("u"), F.min("page_number").alias("lo"), F.max("page_number").alias("hi"), F.count_if(F.col("ok").isNull()).alias("open"))
    why = F.when(F.col("n") > most, "too many pages").when((F.col("u") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "pages are not contiguous").when(F.col("open") > 0, "page has no boolean outcome")
    return sums.select("job_id", why.alias("violation")).where("violation is not null")


def _first(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that does not hold; what is null does not hold."""
    out = F.lit(None).cast("string")
    for ok, message in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), message).otherwise(out)
    return out


def pointer_violations(pointers: DataFrame, expected: DataFrame, *, bucket: str = "results") -> DataFrame:
    """The first thing wrong with each pointer to a result (VAL8), which is no proof of one.

    ``pointers``: job_id, attempt_id, execution_id, document_sha256, status, result_uri,
    result_key, result_digest, result_bytes, page_count, and the compact_* of the last four;
    ``expected``: attempt_id, expected_job, input_digest, max_pages, requires_compact.
    """
    df = pointers.join(expected, "attempt_id", "left")
    base = F.concat(F.lit("results/"), "job_id", F.lit("/"), "attempt_id", F.lit("/"), "execution_id")
    key, small = F.concat(base, F.lit(".json")), F.concat(base, F.lit(".compact.json"))
    uri = lambda k: F.concat(F.lit(f"r2://{bucket}/"), k)
    sized = lambda c: (F.col(c) >= 1) & (F.col(c) <= MOST_RESULT_BYTES)
    plain = ~F.coalesce("requires_compact", F.lit(True))
    rules = [
        (F.col("status") == "completed", "status must be completed"),
        (F.col("expected_job") == F.col("job_id"), "identity does not match the attempt"),
        (F.col("document_sha256") == F.col("input_digest"), "input digest does not match the job"),
        (F.col("execution_id").rlike(EXECUTION_ID), "execution id"),
        (F.col("result_key") == key, "key is outside its attempt"), (F.col("result_uri") == uri(key), "uri does not match"),
        (plain | (F.col("compact_result_key") == small), "compact key is outside its attempt"), (plain | (F.col("compact_result_uri") == uri(small)), "compact uri does not match"),
        (F.col("result_digest").rlike(SHA256), "digest"), (sized("result_bytes"), "bytes"),
        (plain | F.col("compact_result_digest").rlike(SHA256), "compact digest"), (plain | sized("compact_result_bytes"), "compact bytes"),
        (F.col("page_count").between(1, F.col("max_pages")), "page count exceeds the reservation"),
    ]
    return df.select("attempt_id", _first(rules).alias("violation")).where("violation is not null")


def failure_violations(failures: DataFrame, expected: DataFrame) -> DataFrame:
    """The first thing wrong with each returned failure (VAL8). ``failures``: job_id, attempt_id,
    document_sha256, status, failure_code, failure_detail; ``expected`` as above."""
    df = failures.join(expected, "attempt_id", "left")
    same = (F.col("expected_job") == F.col("job_id")) & (F.col("document_sha256") == F.col("input_digest"))
    rules = [(F.col("status") == "failed", "status must be failed"), (same, "identity does not match the attempt"), (F.col("failure_code").isin(*FAILURE_CODES), "unknown failure code"), (F.length("failure_detail") <= 500, "detail must be bounded")]
    return df.select("attempt_id", _first(rules).alias("violation")).where("violation is not null")


def stored_pair_violations(stored: DataFrame, pointers: DataFrame | None = None, *, compact_version: str = COMPACT_VERSION) -> DataFrame:
    """The first thing wrong with each stored pair of evidence and compact form (VAL5, VAL8).

    ``stored``: attempt_id, expected_job, input_digest, max_pages, evidence and compact (JSON
    texts). ``pointers``, if given: attempt_id, result_digest, result_bytes,
    compact_result_digest, compact_result_bytes, page_count. Envelopes are read by their known
    fields, so page bodies are never parsed here.
    """
    page = "array<struct<page_number:int,ok:boolean,failure:struct<code:string,message:string>>>"
    common = f"job_id string, attempt_id string, input_sha256 string, page_count int, pages {page}"
    df = stored.withColumns({"_e": F.from_json("evidence", f"schema_version int, execution_id string, {common}"), "_c": F.from_json("compact", f"schema_version string, representation string, {common}")})
    if pointers is not None:
        df = df.join(pointers.select("attempt_id", *[F.col(c).alias(f"_p_{c}") for c in ("result_digest", "result_bytes", "compact_result_digest", "compact_result_bytes", "page_count")]), "attempt_id", "left")
    size = lambda c: F.octet_length(c)

    def envelope(x: str, name: str) -> list[tuple[Column, str]]:
        pages = F.col(f"{x}.pages")
        public = lambda p: F.when(p["ok"], True).otherwise((p["failure"]["code"] == FAILED_PAGE[0]) & (p["failure"]["message"] == FAILED_PAGE[1]))
        return [
            (size(name).between(1, MOST_RESULT_BYTES), f"{name} bytes"), (F.col(x).isNotNull() & F.col(f"{x}.job_id").isNotNull(), f"{name} is not an envelope"),
            ((F.col(f"{x}.job_id") == F.col("expected_job")) & (F.col(f"{x}.attempt_id") == F.col("attempt_id")) & (F.col(f"{x}.input_sha256") == F.col("input_digest")), f"{name} identity does not match the job"),
            (F.col(f"{x}.page_count").between(1, F.col("max_pages")) & (F.size(pages) == F.col(f"{x}.page_count")), f"{name} page count"),
            (F.forall(F.sequence(F.lit(0), F.size(pages) - 1), lambda i: F.get(pages, i)["page_number"] == i + 1), f"{name} pages are not contiguous"),
            (F.forall(pages, lambda p: p["ok"].isNotNull()), f"{name} page has no boolean outcome"), (F.forall(pages, public), f"{name} failure is not public-safe"),
        ]

    rules = [*envelope("_e", "evidence"), (F.col("_e.schema_version") == 1, "evidence version"), (F.col("_e.execution_id").rlike(EXECUTION_ID), "execution id"), *envelope("_c", "compact"), ((F.col("_c.schema_version") == compact_version) & (F.col("_c.representation") == "compact"), "compact version"), (F.col("_c.page_count") == F.col("_e.page_count"), "compact page count does not match its evidence")]
    if pointers is not None:
        same = [(F.col(f"_p_{p}_digest") == F.sha2(c, 256)) & (F.col(f"_p_{p}_bytes") == size(c)) for p, c in (("result", "evidence"), ("compact_result", "compact"))]
        rules += [(same[0], "evidence does not match its pointer"), (same[1], "compact does not match its pointer"), (F.col("_p_page_count") == F.col("_e.page_count"), "page count does not match its pointer")]
    return df.select("attempt_id", _first(rules).alias("violation")).where("violation is not null")


def write_json_lines(df: DataFrame, path: str, *, append: bool = False) -> None:
    """Records as JSON lines, a new folder or appended to one (SNK2); Spark's commit protocol makes it whole or nothing."""
    df.write.mode("append" if append else "errorifexists").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Such records again; a torn line is null in every column and left out."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.na.drop("all")
