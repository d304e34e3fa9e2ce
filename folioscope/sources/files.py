"""File sources: run records, manifests, TSV readings, log lines, binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import is_blank

TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
MANIFEST = "schemaVersion string, documents array<struct<objectId:string,path:string,sha256:string,pageCount:int,split:string,familyId:string,pages:array<struct<pageNumber:int,labels:array<string>>>>>"
MAX_BYTES, MAX_PAGES = 256 << 20, 2000


def pdf_binaries(spark: SparkSession, path: str, *, most: int = MAX_BYTES) -> DataFrame:
    """Binary documents with their digest (SRC1, SRC2, SRC20): files over the limit are not read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def tesseract_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of TSV readings (SRC13): level 5, not blank, with an area and a confidence."""
    df = spark.read.schema(TSV).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    df = df.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.col("width") > 0) & (F.col("height") > 0) & ~is_blank(F.col("text")))
    return df.select(F.col("page_num").alias("page_number"), F.trim("text").alias("text"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), (F.col("conf") / 100).alias("confidence"))


def run_records(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON records of a run (SRC17); a key that occurs twice is an error when the rows are read."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    sole = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate record: "), F.concat_ws("/", *keys))).cast(one.schema["_r"].dataType)).otherwise(F.col("_r"))
    return one.withColumn("_r", sole).select(*keys, "_r.*").select(*df.columns)


def manifest(spark: SparkSession, path: str, split: str = "development") -> DataFrame:
    """Documents of one split of a corpus manifest, one row per page (SRC18, AGG28)."""
    docs = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*").where(F.col("split") == split)
    return docs.select("objectId", "sha256", "familyId", F.explode_outer("pages").alias("p")).select("objectId", "sha256", "familyId", "p.pageNumber", "p.labels")


def log_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects inside log lines (SRC21); lines without one are dropped."""
    return spark.read.text(path).select(F.from_json(F.regexp_extract("value", r"(\{.*\})", 1), schema).alias("e")).where("e is not null").select("e.*")


def captures(spark: SparkSession, path: str, schema: str, *, arrays: bool = False) -> DataFrame:
    """Captured results (SRC33): JSON lines, which are split and read in parallel, or with ``arrays`` files
    of one array each. Lines that hold no record are left out."""
    return spark.read.schema(schema).option("multiLine", arrays).option("mode", "PERMISSIVE").json(path).na.drop("all")


def text_grid(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Observations of prose: a word is an observation at its place in the line (FIXTURES.md 2.2)."""
    lines = docs.select(F.col(id_col).alias("page_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "row"))
    words = lines.select("page_id", "line", F.posexplode(F.split("row", " ")).alias("nth", "text"), "row").where("text <> ''")
    start = F.length(F.array_join(F.slice(F.split("row", " "), 1, F.col("nth")), " ")) + F.when(F.col("nth") > 0, 1).otherwise(0)
    x0 = (8 * start).cast("double")
    return words.select("page_id", (F.col("line") * 100_000 + F.col("nth")).alias("ord"), F.concat_ws(":", F.lit("w"), "page_id", "line", "nth").alias("id"), "text", x0.alias("x0"), (F.col("line") * 20).cast("double").alias("y0"), (x0 + 8 * F.length("text")).alias("x1"), (F.col("line") * 20 + 16).cast("double").alias("y1"))


def write_pages(df: DataFrame, path: str, keys: list[str], *, mode: str = "overwrite") -> None:
    """Records by page (SNK1, SNK2, SNK4): Spark's commit protocol is the atomic rename."""
    df.repartition(*keys).write.mode(mode).parquet(path)
