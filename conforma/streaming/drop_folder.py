"""Rules over a folder that files keep arriving in (an extension: batch parity needs no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report, rules
from ..sources.adapters import paragraphs

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).parquet(path)


def audit_stream(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the findings of each batch of documents to path; rules need a document's rows only, so
    batches are independent. A batch that is repeated replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        rows = paragraphs(batch)
        found = report.union([rules.crowded(rows), rules.shouted(rows)])
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events (ts, event_type) by window; late ones within the watermark still count."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("window"), "event_type").agg(F.count("*").alias("n"))
