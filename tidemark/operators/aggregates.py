"""Totals and histograms of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths as P


def totals(files: DataFrame) -> DataFrame:
    """source_files, packed_bytes, source_bytes, redactions of selected files."""
    hits = F.aggregate(F.map_values("redactions"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return files.agg(F.count("*").alias("source_files"), total("packed_size").alias("packed_bytes"), total("source_size").alias("source_bytes"), total(hits).alias("redactions"))


def redactions_by_kind(files: DataFrame) -> DataFrame:
    # outer: a plain explode makes Catalyst test the map for emptiness first, which runs the redaction once more
    return files.select(F.explode_outer("redactions").alias("kind", "n")).where("kind is not null").groupBy("kind").agg(F.sum("n").cast("bigint").alias("n"))


def reasons(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def languages(files: DataFrame) -> DataFrame:
    """(language, n) of files (path), most frequent first and then by name."""
    return files.select(P.language(F.col("path")).alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")
