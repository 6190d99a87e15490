"""An extension beyond the batch operators: the stateless ones on streams, dedup within a watermark, and exact dedup in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwright.config import CleaningConfig
from siftwright.functions.text import fingerprint_digest
from siftwright.operators.records import add_derived_columns, add_obfuscation_columns, clean_records, text_column
from siftwright.operators.validation import with_issues


def enrich_stream(stream: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Cleaned, derived and obfuscation columns, and each row's issues."""
    return with_issues(add_derived_columns(add_obfuscation_columns(clean_records(stream, config))))


def dedup_stream(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each cleaned text within the watermark: arrival order, not row order, decides."""
    marked = stream.withColumn("text_fingerprint", fingerprint_digest(F.col("text"))).withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark(["split", "text_fingerprint"])


def first_rows_stream(stream: DataFrame) -> DataFrame:
    """(split, text_fingerprint, row_idx) of a stream's records: for each fingerprint the smallest row index so far.

    For outputMode("update"): state is one number a fingerprint, and a batch gives the fingerprints that it met. A smaller
    index that comes later is a correction of the row before it, so the order of arrival makes no difference in the end.
    """
    name = text_column(stream, "text_clean", "text")
    marked = stream.select("split", "row_idx", fingerprint_digest(F.col(name)).alias("text_fingerprint"))
    return marked.groupBy("split", "text_fingerprint").agg(F.min("row_idx").alias("row_idx"))


def write_first_rows(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start first_rows_stream() of stream over all that is there; a batch has a path of its own, so a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    started = first_rows_stream(stream).writeStream.outputMode("update").foreachBatch(write)
    return started.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What exact deduplication keeps of all rows that came so far."""
    return spark.read.parquet(folder).groupBy("split", "text_fingerprint").agg(F.min("row_idx").alias("row_idx"))
