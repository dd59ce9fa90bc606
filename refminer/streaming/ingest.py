"""Incremental ingestion: new files of references or documents become citations, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refminer.plans.pipeline import citations_from_text

DOCUMENT = "source_url string, text string"


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENT, files_per_batch: int = 1000) -> DataFrame:
    """Documents of the JSON-lines files that arrive below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Citations of all documents that have arrived, added to the Parquet table at out.

    A batch's files and offset are logged in checkpoint (shared storage), so a run after a lost executor, or a second run,
    adds nothing twice: a batch's rows lie in its own folder, which a repeated attempt replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        citations_from_text(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """window_start, event_type and n, on streams as well as tables; rows later than lateness are left out on a stream."""
    late = events.withWatermark("ts", lateness)
    counts = late.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n")
