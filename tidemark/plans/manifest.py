"""The manifest of an archive: its records and totals, its one canonical form, and strict reading."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import __version__
from tidemark import vocabulary as V
from tidemark.errors import VerificationError
from tidemark.functions.paths import fold_key, portable_path

FORMAT, SCHEMA_VERSION = "tidemark", 1
#: Fixed value: digits that an integer of a manifest may have.
MOST_DIGITS = 19


def records(files: DataFrame) -> DataFrame:
    """One row for each selected file (path, source_size, packed, sha256, redactions), as its manifest record."""
    return files.select(
        F.lit("source").alias("kind"), F.concat(F.lit("files/"), F.col("path")).alias("path"), "sha256", F.octet_length("packed").cast("bigint").alias("size"),
        F.col("path").alias("source_path"), F.col("source_size").cast("bigint").alias("source_size"), "redactions",
    )


def canonical(data: dict[str, Any]) -> bytes:
    return (json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8")


def archive_order(path: F.Column) -> list[F.Column]:
    return [fold_key(path), path]


def _fail(message: str) -> None:
    raise VerificationError(message)


def _integer(text: str) -> int:
    if len(text.lstrip("-")) > MOST_DIGITS:
        _fail("the manifest has an integer that is too long")
    return int(text)


def _no_doubles(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        _fail("the manifest has a key twice")
    return out


def parse(data: bytes) -> dict[str, Any]:
    """The manifest of canonical bytes; floats, constants, double keys and any other form of the same content are errors."""
    if len(data) > V.MOST_MANIFEST_BYTES:
        _fail("the manifest is too large")
    try:
        out = json.loads(data.decode("utf-8"), parse_int=_integer, parse_float=lambda _: _fail("the manifest has a fraction"), parse_constant=lambda _: _fail("the manifest has a constant that is no number"), object_pairs_hook=_no_doubles)
    except (UnicodeDecodeError, ValueError, RecursionError) as e:
        raise VerificationError(f"the manifest is no JSON: {e}") from e
    if not isinstance(out, dict) or canonical(out) != data:
        _fail("the manifest isn't in its canonical form")
    return out


@F.pandas_udf(T.BooleanType())
def is_canonical(text: pd.Series) -> pd.Series:
    """Whether a text is a manifest in its one form; null for null."""

    def fine(x: str) -> bool:
        try:
            return parse(x.encode()) is not None
        except VerificationError:
            return False

    return text.map(fine, na_action="ignore")


_TEXT = re.compile(f"[^\\x00-\\x1f\\x7f-\\x9f\ud800-\udfff{V.BIDI_CONTROLS}]+")


def _is_int(x: Any, most: int, least: int = 0) -> bool:
    return type(x) is int and least <= x <= most


def _is_text(x: Any, most: int) -> bool:
    return isinstance(x, str) and 0 < len(x) <= most and _TEXT.fullmatch(x) is not None


def _is_counts(x: Any) -> bool:
    return isinstance(x, dict) and len(x) <= 128 and all(_is_text(k, 128) and _is_int(v, (1 << 31) - 1) for k, v in x.items())


def structure_violations(m: dict[str, Any]) -> list[tuple[str, str, str]]:
    """(path, check, detail) of all fields outside of their types and ranges."""
    out: list[tuple[str, str, str]] = []

    def need(fine: bool, check: str, path: str = "MANIFEST.json") -> None:
        if not fine:
            out.append((path, check, "missing, or outside of its type or range"))

    part = lambda name, of=m: of.get(name) if isinstance(of.get(name), dict) else {}
    project, policy, totals, tool = part("project"), part("policy"), part("totals"), part("tool")
    git = part("git", project)
    need(m.get("format") == FORMAT, "format")
    need(type(m.get("schema_version")) is int and m["schema_version"] == SCHEMA_VERSION, "schema_version")
    need(_is_text(tool.get("name"), 128) and _is_text(tool.get("version"), 128), "tool")
    need(_is_text(project.get("name"), 255), "project.name")
    need(type(git.get("available")) is bool, "git.available")
    need(git.get("branch") is None or _is_text(git["branch"], 1024), "git.branch")
    need(git.get("commit") is None or (isinstance(git["commit"], str) and re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", git["commit"]) is not None), "git.commit")
    need(git.get("dirty") is None or type(git["dirty"]) is bool, "git.dirty")
    need(_is_counts(project.get("languages")), "project.languages")
    need(_is_counts(project.get("metadata_redactions", {})), "project.metadata_redactions")
    fixed = {"archive_compression": "stored", "secret_policy": "redact", "text_encoding": "UTF-8", "text_newlines": "LF"}
    need(all(policy.get(k) == v for k, v in fixed.items()) and type(policy.get("include_untracked")) is bool, "policy")
    for name, most in (("max_file_size", V.MOST_FILE_BYTES), ("max_total_size", V.MOST_TOTAL_BYTES), ("max_files", V.MOST_FILES)):
        need(_is_int(policy.get(name), most, 1), f"policy.{name}")
    for name, most in (("candidate_files", V.MOST_CANDIDATES), ("packed_bytes", V.MOST_TOTAL_BYTES), ("source_files", V.MOST_FILES), ("redactions", (1 << 31) - 1)):
        need(_is_int(totals.get(name), most), f"totals.{name}")
    need("source_bytes" not in totals or _is_int(totals["source_bytes"], V.MOST_TOTAL_BYTES), "totals.source_bytes")
    need(_is_counts(totals.get("excluded_by_reason")), "totals.excluded_by_reason")
    need(_is_counts(totals.get("redactions_by_kind")), "totals.redactions_by_kind")
    warnings = m.get("warnings")
    need(isinstance(warnings, list) and len(warnings) <= 100 and all(_is_text(w, 2048) for w in warnings), "warnings")
    entries = m.get("entries")
    need(isinstance(entries, list) and len(entries) <= V.MOST_ENTRIES, "entries")
    for r in entries if isinstance(entries, list) else []:
        if not isinstance(r, dict) or not isinstance(r.get("path"), str):
            need(False, "record")
            continue
        path, kind = r["path"], r.get("kind")
        need(portable_path(path, normalize=False) is not None, "record.path", path)
        need(_is_int(r.get("size"), V.MOST_ARCHIVE_BYTES), "record.size", path)
        need(isinstance(r.get("sha256"), str) and re.fullmatch("[0-9a-f]{64}", r["sha256"]) is not None, "record.sha256", path)
        if kind == "source":
            need(path.startswith("files/") and r.get("source_path") == path.removeprefix("files/"), "record.source_path", path)
            need(_is_int(r.get("source_size"), V.MOST_FILE_BYTES), "record.source_size", path)
            need(_is_counts(r.get("redactions", {})), "record.redactions", path)
        else:
            need(kind == "generated" and not path.startswith("files/"), "record.kind", path)
    return out


def build(record_rows: list[dict[str, Any]], project: dict[str, Any], policy: dict[str, Any], totals: dict[str, Any], warnings: list[str]) -> dict[str, Any]:
    return {"entries": record_rows, "format": FORMAT, "policy": policy, "project": project, "schema_version": SCHEMA_VERSION, "tool": {"name": "tidemark", "version": __version__}, "totals": totals, "warnings": warnings}
