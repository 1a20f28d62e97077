"""Incremental validation as a stream: each micro-batch appends to a coverage log what the log doesn't hold yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paragrid.operators.state import CAP, not_yet


def append_new(batch: DataFrame, batch_id: int, log_path: str, cap: int = CAP) -> None:
    """Appends the batch's new (doc_id, idx), marked over_cap where a document has more of them than the cap. A batch
    that is run again after a failure replaces its own rows and finds the others in the log."""
    spark = batch.sparkSession
    rows = batch.select("doc_id", "idx").distinct()
    try:
        log = spark.read.parquet(log_path).where(F.col("batch") != batch_id)
        rows = not_yet(rows, log)
    except Exception as e:  # the log begins with the first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    counts = rows.groupBy("doc_id").agg((F.count("*") > cap).alias("over_cap"))
    rows.join(counts, "doc_id").write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")


def follow(paragraphs: DataFrame, log_path: str, checkpoint: str, cap: int = CAP) -> StreamingQuery:
    """Starts the stream over a streaming frame of (doc_id, idx, ...)."""
    return paragraphs.writeStream.foreachBatch(lambda df, k: append_new(df, k, log_path, cap)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_per_window(rows: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, check, n of a stream of findings, with late rows up to a watermark."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "check").agg(F.count("*").alias("n")).select("window.start", "check", "n")
