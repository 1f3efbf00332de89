"""Sources and sinks of the engine's own tables: parsed documents, recordings, pinned responses,
artifacts that go stale with their source, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcegrain.operators import windows

DOCUMENT = "paper_id string, title string, authors array<string>, year int, venue string, doi string, pages int, paragraphs array<struct<text:string,page_start:int,page_end:int>>"
PIN = "url string, provider string, source string, status_code int, error string, body string"
REPORT = "audit_id string, input_paper_id string, status string, checked_at timestamp, results array<struct<entry_id:string,status:string,reason:string>>"


def _stem(path: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(path), r"\.json$", "")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON file each; reference artifacts and unreadable files are left out."""
    df = spark.read.schema(DOCUMENT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    named = df.withColumn("file", F.col("_metadata.file_name"))
    return named.where(~F.endswith("file", F.lit(".references.json")) & F.col("_bad").isNull()).drop("_bad")


def corpus(documents: DataFrame) -> DataFrame:
    """(paper_id, passage_index, content) of the passages that aren't blank."""
    return documents.select("paper_id", F.posexplode("paragraphs").alias("passage_index", "p")).where("trim(p.text) <> ''").select("paper_id", "passage_index", F.col("p.text").alias("content"), "p.page_start")


def read_recordings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded candidate sets; a file's stem is its case."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("case_id", _stem())


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses by exact url; recording one url twice is an error when the rows are read."""
    pins = spark.read.schema(PIN).option("multiLine", True).json(path)
    once = pins.groupBy("url").agg(F.count("*").alias("n"), F.min(F.struct("provider", "source", "status_code", "error", "body")).alias("p"))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("url recorded twice: "), F.col("url")))).otherwise(F.col("url"))
    return once.select(ok.cast("string").alias("url"), "p.*")


def uploads(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """PDF uploads that may be parsed: by suffix, size and leading mark; with their digest."""
    raw = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".pdf") & (F.col("length") <= most_bytes))
    return raw.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "length", F.sha2("content", 256).alias("digest"))


def fresh(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Artifacts (paper_id, digest) whose source still has the digest they were made from."""
    return artifacts.join(sources.select("paper_id", "digest"), ["paper_id", "digest"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def newest(catalog: DataFrame) -> DataFrame:
    return catalog.where("paper_id is not null and created_at is not null").orderBy(F.desc("created_at"), "paper_id")


def latest_audit(reports: DataFrame) -> DataFrame:
    return windows.first_of(reports, ["input_paper_id"], [F.desc("checked_at"), F.asc("audit_id")])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Digest and size of each file, for a backup's check."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
