"""Incremental ingest: new Markdown or text rows become passages of a package as they arrive.

Tokenising is stateless, so the batch operators serve a stream as they are; the
file source's checkpoint remembers what was read, and each micro-batch is
written with its number, so that a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, source string, text string") -> DataFrame:
    """New Parquet files of documents."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(docs: DataFrame, target: str, checkpoint: str, splitter: str = "block", once: bool = False) -> StreamingQuery:
    """Passages with tokens, appended under target/batch=n."""

    def store(batch: DataFrame, number: int) -> None:
        tokens = index.tokenized(index.passages(batch, splitter))
        tokens.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def term_counts(docs: DataFrame, ts_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Documents per source and window of time, late rows dropped after the watermark."""
    return docs.withWatermark(ts_col, late).groupBy(F.window(ts_col, window), "source").agg(F.count("*").alias("documents"))
