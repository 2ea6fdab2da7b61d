"""Streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions.redaction import redacted


def redacted_stream(files: DataFrame) -> DataFrame:
    """files (path, content) with text and redactions; without state, so it serves streams and tables alike."""
    found = files.withColumn("_found", redacted(C.unix_newlines(C.text_of(F.col("content")))))
    return found.select("path", F.col("_found.text").alias("text"), F.col("_found.counts").alias("redactions"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream has now, written to a shared folder and read back; run again on the folder, it takes up what is new since."""
    state = {"path": f"{folder}/out", "checkpointLocation": f"{folder}/state"}
    running = stream.writeStream.format("parquet").options(**state).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(state["path"])
