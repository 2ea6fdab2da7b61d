"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, label): the smallest id that each end of the links (a, b) reaches.

    links must be a written table. Each round gives a node the smallest label among itself, its neighbours and its label's
    label, and writes the labels, so that rounds grow with the logarithm of a path's length. Joins are between written tables, so
    that a node with very many links is split by adaptive execution; labels are minima, which are combined before any shuffle.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label"))
    labels, k = written(first.withColumn("changed", F.lit(True)), folder, f"{name}/0"), 0
    while not labels.where("changed").isEmpty():
        k += 1
        of = labels.select(F.col("id").alias("at"), F.col("label").alias("near"))
        told = links.join(of, F.col("a") == F.col("at")).select(F.col("b").alias("id"), "near").union(links.join(of, F.col("b") == F.col("at")).select(F.col("a").alias("id"), "near"))
        jumped = labels.join(of, F.col("label") == F.col("at")).select("id", "near")
        own = labels.select("id", F.col("label").alias("near"), F.col("label").alias("old"))
        gathered = own.unionByName(told.union(jumped), allowMissingColumns=True).groupBy("id").agg(F.min("near").alias("label"), F.min("old").alias("old"))
        labels = written(gathered.select("id", "label", (F.col("label") < F.col("old")).alias("changed")), folder, f"{name}/{k}")
        discard(links.sparkSession, folder, f"{name}/{k - 1}")
    return labels.select("id", "label")
