"""From candidate files to decisions: why a file is left out, or what of it is kept."""

from __future__ import annotations

import dataclasses
import functools
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import vocabulary as V
from tidemark.errors import ScanError
from tidemark.functions import content as C
from tidemark.functions import paths as P
from tidemark.functions.redaction import POSSIBLE, redact, redacted
from tidemark.functions.rules import Rule, denied
from tidemark.operators.select import greedy_select


def excluded_folder(path: str) -> bool:
    """Whether a directory of a tree is never entered; the plain form of is_always_excluded for its last component."""
    name = unicodedata.normalize("NFC", path.rsplit("/", 1)[-1]).lower()
    return name in V.EXCLUDED_DIRECTORIES or name.endswith(".egg-info") or sensitive_name(name)


@functools.cache
def sensitive_name(name: str) -> bool:
    bare = next((name.removesuffix(s) for s in V.BACKUP_SUFFIXES if name.endswith(s)), name)
    return bare in V.EXCLUDED_NAMES or bare.startswith((".env", *V.KEY_PREFIXES)) or bare.endswith((".tfstate", ".ppk", *V.EXCLUDED_SUFFIXES)) or ".tfstate." in bare or ".ppk." in bare


@F.pandas_udf(T.StructType([T.StructField("safe_path", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType()))]))
def _path_facts(paths: pd.Series) -> pd.DataFrame:
    """The portable form of each normalised path, if it has one, and what credentials it holds."""
    possible = re.compile(POSSIBLE)
    safe = [None if p is None else P.portable_path(p) for p in paths]
    return pd.DataFrame({"safe_path": safe, "counts": [None if p is None else redact(p)[1] if possible.search(p) else {} for p in safe]}, dtype=object)


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row. The optimizer pushes predicates through projections with a copy of an expression for each use, but not through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def path_stage(files: DataFrame, rules: Sequence[Rule] = (), output: str | None = None) -> DataFrame:
    """files (path, ...) with safe_path, shown_path, path_reason and path_counts; the first reason that holds counts.

    Paths of ASCII without anything that a detector looks for are decided in the JVM. For others, one call of Python finds both
    what Unicode tables and what the cascade say of them.
    """
    files = _settled(files, _clean=F.when(~F.col("path").contains("\\"), P.normalized(F.col("path"))))
    clean = F.col("_clean")
    files = _settled(files, _plain=clean.isNotNull() & ~clean.rlike(r"[^\x00-\x7F]") & ~clean.rlike(POSSIBLE))
    files = files.withColumn("_facts", _path_facts(F.when(~F.col("_plain"), clean)))
    nothing = F.create_map().cast("map<string,bigint>")
    safe = F.when(F.col("_plain"), F.when(P.is_portable_ascii(clean), clean)).otherwise(F.col("_facts.safe_path"))
    counts = F.when(F.col("_plain"), nothing).otherwise(F.coalesce("_facts.counts", nothing))
    files = _settled(files, safe_path=safe, path_counts=counts).drop("_facts", "_plain")
    safe = F.col("safe_path")
    reason = (
        F.when(safe.isNull(), "unsafe_path")
        .when(F.size("path_counts") > 0, "secret_in_path")
        .when(P.is_always_excluded(safe), "always_excluded")
        .when(denied(safe, rules), "project_ignore")
        .when((safe == output) if output else F.lit(False), "output_archive")
    )
    shown = F.when(safe.isNull(), P.unsafe_label(F.coalesce("_clean", "path"))).when(F.size("path_counts") > 0, F.lit("<redacted-path>")).otherwise(safe)
    return _settled(files, path_reason=reason, shown_path=shown).drop("_clean")


def collisions(paths: DataFrame) -> DataFrame:
    """(fold, n): keys that several of the safe paths share after composition and case folding."""
    return paths.where("safe_path is not null").groupBy(P.fold_key(F.col("safe_path")).alias("fold")).agg(F.count_distinct("safe_path").alias("n")).where("n > 1")


def read_reason(path: Column, size: Column, content: Column, max_file_size: int) -> Column:
    """Why a file that is there can't be taken, before and after its content is looked at."""
    return (
        F.when(size > max_file_size, "file_size_limit")
        .when(P.is_binary_suffix(path), "binary_extension")
        .when(C.is_binary(content), "binary_content")
        .when(C.text_of(content).isNull(), "non_utf8_text")
    )


def content_stage(files: DataFrame, max_file_size: int = V.DEFAULT_FILE_BYTES) -> DataFrame:
    """files (safe_path, size, content) with read_reason, packed text and counts, sizes and hash.

    Contents of files that are left out never reach the redaction.
    """
    told = F.col("kind") if "kind" in files.columns else F.lit("file")
    reason = F.when(told != "file", told).otherwise(read_reason(F.col("safe_path"), F.col("size"), F.col("content"), max_file_size))
    files = files.withColumn("read_reason", reason)
    files = files.withColumn("_found", redacted(F.when(F.col("read_reason").isNull(), C.unix_newlines(C.text_of(F.col("content"))))))
    opened = ~F.coalesce(F.col("read_reason"), F.lit("")).isin("file_size_limit", "binary_extension", "symlink_or_junction", "not_regular_file", "io_error")
    return (
        files.withColumn("packed", F.col("_found.text"))
        .withColumn("redactions", F.col("_found.counts"))
        .withColumn("packed_size", F.octet_length("packed").cast("bigint"))
        .withColumn("source_size", F.when(opened, F.col("size")).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("sha256", C.content_hash(F.col("packed")))
        .drop("_found")
    )


def chosen_files(files: DataFrame, decided: DataFrame, max_files: int) -> DataFrame:
    """The files (safe_path, ...) that were selected: at most max_files, so their paths are broadcast if that number is small."""
    paths = decided.where("reason is null").select(F.col("path").alias("safe_path"))
    return files.join(F.broadcast(paths) if max_files <= V.MOST_FILES else paths, "safe_path", "left_semi")


@dataclasses.dataclass
class Scan:
    """files: selected ones (path, source_size, packed, packed_size, sha256, redactions); skipped: (path, reason) in the order of both.

    held: what is kept in memory for them until `release`.
    """

    files: DataFrame
    skipped: DataFrame
    candidates: int
    path_counts: dict[str, int]
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def scan(files: DataFrame, max_file_size: int = V.DEFAULT_FILE_BYTES, max_total_size: int = V.DEFAULT_TOTAL_BYTES, max_files: int = V.DEFAULT_FILES, rules: Sequence[Rule] = (), output: str | None = None, ceilings: bool = True) -> Scan:
    """Decide over files (path, size, content and perhaps kind).

    With ceilings, too many candidates and too much work of rules end the scan, as colliding paths always do.
    """
    staged = path_stage(files, rules, output)
    if ceilings:
        parts = F.greatest(F.size(P.components(P.normalized(F.col("path")))), F.lit(1))
        n, work = files.agg(F.count("*"), F.coalesce(F.sum(parts), F.lit(0))).first()
        if n > V.MOST_CANDIDATES or work * len(rules) > V.MOST_MATCH_WORK:
            raise ScanError("there are too many candidates or rules")
    if not collisions(staged.where("path_reason is null or path_reason not in ('unsafe_path', 'secret_in_path')")).isEmpty():
        raise ScanError("two paths are equal but for case or composition")
    safe = staged.where("path_reason is null")
    kept = content_stage(safe, max_file_size)
    kept = kept.withColumn("priority", P.priority(F.col("safe_path"))).withColumn("fold", P.fold_key(F.col("safe_path")))
    narrow = kept.select("priority", "fold", F.col("safe_path").alias("path"), F.col("size").alias("planned_size"), "read_reason", "source_size", "packed_size")
    decided = greedy_select(narrow, max_files, max_total_size).persist()  # narrow, and wanted several times
    # contents are joined to the decisions before they are redacted again, so that is done for selected files alone
    chosen = content_stage(chosen_files(safe, decided, max_files), max_file_size)
    skipped = staged.where("path_reason is not null").select(F.col("shown_path").alias("path"), F.col("path_reason").alias("reason")).unionByName(decided.where("reason is not null"))
    skipped = skipped.orderBy(*skipped_order())
    counts = staged.where("path_reason = 'secret_in_path'").select(F.explode_outer("path_counts").alias("kind", "n")).where("kind is not null").groupBy("kind").agg(F.sum("n").alias("n"))
    return Scan(chosen.select(F.col("safe_path").alias("path"), "source_size", "packed", "packed_size", "sha256", "redactions"), skipped, files.count(), {r["kind"]: r["n"] for r in counts.orderBy("kind").collect()}, (decided,))


def skipped_order() -> list[Column]:
    """Skipped files (path, reason) are told by reason, then by path without regard to case."""
    return [F.col("reason"), P.fold_key(F.col("path")), F.col("path")]


def sanitized(text: str | None, most: int, marker: str = "[TRUNCATED]") -> tuple[str | None, dict[str, int]]:
    """A name that can be shown: masked, with control characters replaced, and cut to `most` characters; and counts of each."""
    if text is None:
        return None, {}
    text, counts = redact(text)
    bad = [k for k, c in enumerate(text) if c in V.BIDI_CONTROLS or unicodedata.category(c) in ("Cc", "Cs")]
    if bad:
        text = "".join("�" if k in set(bad) else c for k, c in enumerate(text))
        counts["UNSAFE_METADATA"] = len(bad)
    if len(text) > most:
        text = text[: most - len(marker)] + marker
        counts["TRUNCATED_METADATA"] = 1
    return text, dict(sorted(counts.items()))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType()))]))
def _sanitized(texts: pd.Series, most: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sanitized(t, int(n)) for t, n in zip(texts, most, strict=True)], columns=["text", "counts"], dtype=object)


def sanitized_with_counts(text: Column, most: int) -> Column:
    """struct(text, counts) as `sanitized` gives it."""
    return _sanitized(text, F.lit(most))


def sanitized_column(text: Column, most: int, marker: str = "[TRUNCATED]") -> Column:
    """The text part of `sanitized` for texts without credentials, as an expression."""
    plain = F.regexp_replace(text, f"[\\p{{Cc}}\\p{{Cs}}{V.BIDI_CONTROLS}]", "�")
    return F.when(F.length(plain) > most, F.concat(plain.substr(F.lit(1), F.lit(most - len(marker))), F.lit(marker))).otherwise(plain)
