"""Writing an archive: entries in one order, stored, with fixed metadata; equal input gives equal bytes."""

from __future__ import annotations

import dataclasses
import hashlib
import heapq
import io
import itertools
import os
import re
import tempfile
import zipfile
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import IO, Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocabulary as V
from tidemark.config import Config
from tidemark.errors import TidemarkError
from tidemark.functions.redaction import PREFIX, redact
from tidemark.operators import aggregates
from tidemark.operators.scan import Scan, sanitized
from tidemark.plans import manifest
from tidemark.sources.git import GitInfo

#: Fixed values of every entry.
ZIP_TIME, ZIP_MODE, ZIP_SYSTEM = (1980, 1, 1, 0, 0, 0), 0o100644, 3
LISTED_FILES = 500


@dataclasses.dataclass(frozen=True)
class ArchiveResult:
    path: Path
    sha256: str
    archive_bytes: int
    source_files: int
    source_bytes: int
    redactions: int


def _write_entries(entries: Iterable[tuple[str, bytes]], target: IO[bytes] | str) -> None:
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED, allowZip64=False) as out:
        for path, content in entries:
            info = zipfile.ZipInfo(path, ZIP_TIME)
            info.create_system, info.external_attr = ZIP_SYSTEM, ZIP_MODE << 16
            out.writestr(info, content)


def write_zip(entries: Iterable[tuple[str, bytes]], target: Path) -> None:
    """Entries in the given order to a new file beside target, which then takes its place."""
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    os.close(handle)
    try:
        _write_entries(entries, name)
        if os.path.getsize(name) > V.MOST_ARCHIVE_BYTES:
            raise TidemarkError("the archive would be too large")
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def guard_output(target: Path, force: bool) -> None:
    if target.is_symlink():
        raise TidemarkError("the output is a link")
    if target.exists() and not (force and target.is_file()):
        raise TidemarkError("the output exists; force is needed" if target.is_file() else "the output is no regular file")


@dataclasses.dataclass
class Summary:
    """What the generated entries and the manifest say; small whatever the size of the scan."""

    project: str
    git: GitInfo
    languages: dict[str, int]
    metadata: dict[str, int]
    totals: dict
    config: Config
    warnings: list[str]
    listed: list[str]
    affected: list[tuple[str, dict[str, int]]]


def summarize(scan: Scan, config: Config, project: str, git: GitInfo, warnings: list[str]) -> Summary:
    files = scan.files
    name, metadata = sanitized(project, 255)
    branch, more = sanitized(git.branch, 1024)
    for counts in (more, scan.path_counts):
        for kind, n in counts.items():
            metadata[kind] = metadata.get(kind, 0) + n
    by_kind = {r["kind"]: r["n"] for r in aggregates.redactions_by_kind(files).collect()}
    for kind, n in metadata.items():
        by_kind[kind] = by_kind.get(kind, 0) + n
    row = aggregates.totals(files).first()
    totals = {
        "candidate_files": scan.candidates, "excluded_by_reason": {r["reason"]: r["n"] for r in aggregates.reasons(scan.skipped).collect()}, "packed_bytes": row["packed_bytes"], "source_bytes": row["source_bytes"],
        "redactions": sum(by_kind.values()), "redactions_by_kind": dict(sorted(by_kind.items())), "source_files": row["source_files"],
    }
    listed = [r["path"] for r in files.select("path").orderBy(*manifest.archive_order(F.col("path"))).limit(LISTED_FILES).collect()]
    affected = [(r["path"], dict(sorted(r["redactions"].items()))) for r in files.where(F.size("redactions") > 0).select("path", "redactions").orderBy(*manifest.archive_order(F.col("path"))).collect()]
    languages = {r["language"]: r["n"] for r in aggregates.languages(files).collect()}
    return Summary(name or "redacted-project", dataclasses.replace(git, branch=branch), languages, dict(sorted(metadata.items())), totals, config, warnings, listed, affected)


def _bullets(lines: Iterable[str], none: str) -> str:
    return "\n".join(f"- {x}" for x in lines) or f"- {none}"


def generated_entries(s: Summary) -> dict[str, bytes]:
    """The texts that explain an archive to whoever opens it."""
    t, g, c = s.totals, s.git, s.config
    state = [f"git: `{str(g.available).lower()}`", *([f"branch: `{g.branch}`"] if g.branch else []), *([f"commit: `{g.commit}`"] if g.commit else []), *([f"uncommitted changes: `{str(g.dirty).lower()}`"] if g.dirty is not None else [])]
    state += [f"files: `{t['source_files']}`", f"bytes: `{t['packed_bytes']}`", f"masked values: `{t['redactions']}`", "languages: " + (", ".join(f"{k} ({n})" for k, n in s.languages.items()) or "none known")]
    more = t["source_files"] - len(s.listed)
    files = [f"`files/{p}`" for p in s.listed] + ([f"and {more} more, which MANIFEST.json lists"] if more > 0 else [])
    counts = lambda x: ", ".join(f"{k}={n}" for k, n in x.items())
    affected = ([f"names and git metadata: {counts(s.metadata)}"] if s.metadata else []) + [f"`files/{p}`: {counts(x)}" for p, x in s.affected]
    note = f"Values masked as `{PREFIX}...>>` aren't in this archive and mustn't be guessed.\n"
    texts = {
        "CONTEXT.md": f"# {s.project}: snapshot\n\nStart here; the files are below `files/`.\n\n## State\n\n{_bullets(state, '')}\n\n## Files\n\n{_bullets(files, 'none')}\n\n## Left out\n\nBinary files, credential containers, caches, dependencies and build output. Finding secrets is a heuristic: read REDACTIONS.md before sharing.\n\n## Warnings\n\n{_bullets(s.warnings, 'none')}\n\nLimits: {c.max_files} files, {c.max_file_size} bytes each, {c.max_total_size} bytes in all.\n",
        "REDACTIONS.md": f"# Masked values\n\n## By kind\n\n{_bullets((f'`{k}`: {n}' for k, n in t['redactions_by_kind'].items()), 'none')}\n\n## By file\n\n{_bullets(affected, 'none')}\n\nUnknown forms of credentials may have been missed.\n",
        "adapters/AGENTS.md": f"# Snapshot of {s.project}\n\nRead `../CONTEXT.md` and `../MANIFEST.json`; `../files/` is for reading only.\n{note}",
        "adapters/CLAUDE.md": f"# Snapshot of {s.project}\n\nRead `../CONTEXT.md` and `../MANIFEST.json`; `../files/` is for reading only.\n{note}",
        "adapters/IMPORT_PROMPT.md": f"# Import {s.project}\n\nTreat the files as a read-only snapshot, and check against the live project before changing it.\n{note}",
        "adapters/cursor-context.mdc": f"---\ndescription: snapshot of a project\nalwaysApply: true\n---\n\nRead `../CONTEXT.md` first.\n{note}",
    }
    return {k: v.encode() for k, v in texts.items()}


def _order(path: str) -> tuple[str, str]:
    return path.casefold(), path


def all_entries(s: Summary, rows: list[dict[str, Any]], stored: Iterable[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """Stored files, which come in the archive's order and have these records, merged with generated entries and the manifest."""
    generated, c = generated_entries(s), s.config
    rows = rows + [{"kind": "generated", "path": k, "sha256": hashlib.sha256(v).hexdigest(), "size": len(v)} for k, v in generated.items()]
    rows.sort(key=lambda r: _order(r["path"]))
    project = {"git": dataclasses.asdict(s.git), "languages": s.languages, "metadata_redactions": s.metadata, "name": s.project}
    policy = {"archive_compression": "stored", "include_untracked": c.include_untracked, "max_file_size": c.max_file_size, "max_files": c.max_files, "max_total_size": c.max_total_size, "secret_policy": "redact", "text_encoding": "UTF-8", "text_newlines": "LF"}
    generated["MANIFEST.json"] = manifest.canonical(manifest.build(rows, project, policy, s.totals, s.warnings))
    if len(generated["MANIFEST.json"]) > V.MOST_MANIFEST_BYTES:
        raise TidemarkError("the manifest would be too large")
    yield from heapq.merge(sorted(generated.items(), key=lambda x: _order(x[0])), stored, key=lambda x: _order(x[0]))


def build_archive(scan: Scan, config: Config, output: str | os.PathLike, project: str, git: GitInfo = GitInfo(), warnings: tuple[str, ...] = (), force: bool = False) -> ArchiveResult:
    """Write the archive of a scan. Contents come to the driver one partition at a time; they are bounded by the scan's limits."""
    target = Path(os.path.abspath(os.path.expanduser(os.fspath(output))))
    guard_output(target, force)
    target.parent.mkdir(parents=True, exist_ok=True)
    scan = dataclasses.replace(scan, files=scan.files.persist())
    try:
        s = summarize(scan, config, project, git, list(warnings))
        rows = [{k: v for k, v in r.asDict().items() if k != "redactions"} | ({"redactions": dict(r["redactions"])} if r["redactions"] else {}) for r in manifest.records(scan.files).collect()]
        packed = scan.files.select(F.concat(F.lit("files/"), "path").alias("name"), "packed").orderBy(*manifest.archive_order(F.col("name")))
        write_zip(all_entries(s, rows, ((r["name"], r["packed"].encode()) for r in packed.toLocalIterator())), target)
    finally:
        scan.files.unpersist()
    data = target.read_bytes()
    return ArchiveResult(target, hashlib.sha256(data).hexdigest(), len(data), s.totals["source_files"], s.totals["source_bytes"], s.totals["redactions"])


_SUFFIX = re.compile(r"[^/](\.[^./]+)$")


def archive_of(files: Iterable[tuple[str, str]], project: str, config: Config = Config(), git: GitInfo = GitInfo()) -> bytes:
    """The archive of a few files (path, text) in memory, as build_archive writes it for a scan that selects all of them."""
    rows, stored, kinds, languages = [], [], Counter(), Counter()
    for path, text in sorted(files, key=lambda x: _order(x[0])):
        packed, counts = redact(text.replace("\r\n", "\n").replace("\r", "\n"))
        data = packed.encode()
        stored.append((f"files/{path}", data))
        row = {"kind": "source", "path": f"files/{path}", "sha256": hashlib.sha256(data).hexdigest(), "size": len(data), "source_path": path, "source_size": len(text.encode())}
        rows.append(row | ({"redactions": counts} if counts else {}))
        kinds.update(counts)
        if (suffix := _SUFFIX.search(path)) and suffix[1].lower() in V.LANGUAGES:
            languages[V.LANGUAGES[suffix[1].lower()]] += 1
    totals = {
        "candidate_files": len(rows), "excluded_by_reason": {}, "packed_bytes": sum(r["size"] for r in rows), "source_bytes": sum(r["source_size"] for r in rows),
        "redactions": kinds.total(), "redactions_by_kind": dict(sorted(kinds.items())), "source_files": len(rows),
    }
    if len(rows) > config.max_files or max(totals["packed_bytes"], totals["source_bytes"]) > config.max_total_size:
        raise TidemarkError("the files are more than an archive may hold")
    affected = [(r["source_path"], r["redactions"]) for r in rows if "redactions" in r]
    s = Summary(project, git, dict(sorted(languages.items(), key=lambda x: (-x[1], x[0]))), {}, totals, config, [], [r["source_path"] for r in rows[:LISTED_FILES]], affected)
    out = io.BytesIO()
    _write_entries(all_entries(s, rows, stored), out)
    return out.getvalue()


def pack_groups(files: DataFrame, project: str, config: Config = Config()) -> DataFrame:
    """files (archive, path, text) to (archive, data): one archive for each value of `archive`, all in parallel. An archive's limits bound a group.

    Each task streams its files, sorted by archive, and holds one archive's files at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("archive").type
                yield from zip(batch["archive"].to_pylist(), batch["path"].to_pylist(), (text.as_py() for text in batch["text"]))

        for name, group in itertools.groupby(rows(), lambda row: row[0]):
            made = archive_of([(path, text) for _, path, text in group], f"{project}-{name}", config)
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([made], pa.binary())], names=["archive", "data"])

    grouped = files.select("archive", "path", "text").repartition("archive").sortWithinPartitions("archive")
    return grouped.mapInArrow(pack, f"archive {files.schema['archive'].dataType.simpleString()}, data binary")
