"""The parse queue as a stream: files arrive, are parsed, and a restart goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcegrain.sources import bibtex


def bib_stream(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """Entries of BibTeX files as the files arrive."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).load(path)
    return bibtex.parse(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def latest(requests: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The last request of each key: later ones supersede those before."""
    return requests.withWatermark(at, delay).groupBy(key).agg(F.max_by(F.struct(*[c for c in requests.columns if c != key]), at).alias("r")).select(key, "r.*")


def changed(contents: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Contents whose digest was not seen for the key within the delay."""
    return contents.withColumn("digest", F.sha2("content", 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark([key, "digest"])


def run_queue(jobs: DataFrame, parse: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each batch is parsed and written under its id, so a batch that is run again after a failure
    replaces what it wrote before."""

    def step(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
