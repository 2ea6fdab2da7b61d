"""The driver's tables, and tables as views of files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("docs", "src", "tests", "build", ".ssh", "misc")
SUFFIXES = {"en": ".md", "fr": ".py", "de": ".json", "es": ".yaml"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows that take long each, dealt by these keys over as many tasks as a shuffle has; a small file would be a task or two, whatever its rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and text of every document: the folder by doc_id, the suffix by language."""
    return document_columns(table(spark, sf_dir, "documents"))


def document_columns(docs: DataFrame) -> DataFrame:
    """As document_files, of a table or a stream of documents."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.pmod("doc_id", F.lit(len(FOLDERS))) + 1).cast("int"))
    suffix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in SUFFIXES.items() for x in item]), F.col("lang")), F.lit(".txt"))
    path = F.concat(folder, F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return docs.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of the rows of all tables that hold texts."""
    parts = [document_files(spark, sf_dir).select("path", "text")]
    for name, path, text in (
        ("pages", F.concat(F.lit("site/"), F.col("page_id"), F.lit(".html")), "html"),
        ("conversations", F.concat(F.lit("docs/chat/"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".txt")), "text"),
        ("events", F.concat(F.lit("data/ev/"), F.col("event_id"), F.lit(".json")), "props"),
        ("benchmark", F.concat(F.lit("tests/"), F.col("item_id"), F.lit(".txt")), "text"),
    ):
        parts.append(table(spark, sf_dir, name).select(path.alias("path"), F.coalesce(text, F.lit("")).alias("text")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
