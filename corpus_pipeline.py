"""The corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens; each stage works on all that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language, neardup, pii
from tidemark.llm.common import discard, pick, ship_package, table, work_folder, written
from tidemark.llm.queries import tokenizer_path

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior from which a document counts as being in some language.
LEAST_SCORE = 0.5
#: Ids of decisions up to which they are broadcast; above, the join shuffles.
BROADCAST_IDS = 1_000_000


#: Name of the column that tells rows apart.
KEY = "_row"


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, found by exact name, whatever others there are."""
    return pick(docs, **{c: c for c in COLUMNS})


def _keyed(docs: DataFrame, folder: str) -> DataFrame:
    """The documents with a key of each row, in the order of doc_id: doc_id itself unless some are null or repeated."""
    docs = _columns(docs)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.select(*COLUMNS, F.col("doc_id").alias(KEY))
    # the text's hash deals out the rows of one doc_id; the numbers are written, as they would differ in another run
    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.select(*COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn(KEY, F.monotonically_increasing_id()), folder, "keyed")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The keyed documents without those of the written keys."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, KEY, "left_anti").select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters or whose language the classifier can't tell.

    A null or empty text has no letters. Every row is judged by its own text, also where doc_ids are null or repeated. An empty table
    stays empty; columns other than those of documents are dropped.
    """
    ship_package(spark)
    folder = work_folder(spark)
    docs = _keyed(docs, folder)
    found = language.identify(docs, carried=(KEY,))
    return _without(docs, written(found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select(KEY), folder, "rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id; of rows repeated with that id, one.

    Rows with one doc_id are compared like any others. A document without an id is linked with nothing, as in op10, and stays.
    """
    ship_package(spark)
    folder = work_folder(spark)
    docs = _keyed(docs, folder)
    found = neardup.near_duplicates(docs.where("doc_id is not null"), id_col=KEY)
    return _without(docs, written(found.where("not kept").select(F.col("doc_id").alias(KEY)), folder, "dropped"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark.

    A null or empty text holds none. Every row is judged by its own text, also where doc_ids are null or repeated; with an empty table
    or an empty benchmark all rows stay.
    """
    ship_package(spark)
    folder = work_folder(spark)
    docs = _keyed(docs, folder)
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), id_col=KEY).select(F.col("doc_id").alias(KEY)).distinct()
    return _without(docs, written(leaks, folder, "leaks"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars is that of the new text. Null texts stay null."""
    ship_package(spark)
    return pii.masked_documents(_columns(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and digests of ids and decoded text; one row for each row, null texts have no tokens, an empty table no rows."""
    ship_package(spark)
    return bpe.encode_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("tokens", encode_tokens),
]

#: SQL can't express the classifier, the tagger or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs, folder, before = table(spark, sf_dir, "documents"), work_folder(spark), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        discard(spark, folder, *before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
