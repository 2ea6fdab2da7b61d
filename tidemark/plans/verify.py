"""Checking archives. All violations are rows (path, check, detail); `verify` and `inspect` raise the first."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import vocabulary as V
from tidemark.errors import VerificationError
from tidemark.functions.paths import fold_key, portable_path
from tidemark.plans import manifest
from tidemark.plans.pack import ZIP_MODE, ZIP_SYSTEM, ZIP_TIME

Violation = tuple[str, str, str]
_END = struct.Struct("<4s4H2LH")


def preflight(data: bytes) -> int:
    """The number of entries that the archive's end record announces; VerificationError unless all its bounds agree."""
    if not _END.size <= len(data) <= V.MOST_ARCHIVE_BYTES:
        raise VerificationError("the archive is too large or too short")
    mark, disk, first_disk, here, entries, size, start, comment = _END.unpack(data[-_END.size :])
    if mark != b"PK\5\6" or comment or disk or first_disk or here != entries:
        raise VerificationError("the archive's end record is missing, followed by something or spread over disks")
    if entries > V.MOST_ENTRIES or size > V.MOST_DIRECTORY_BYTES or start + size != len(data) - _END.size or 0xFFFF in (entries,) or 0xFFFFFFFF in (size, start):
        raise VerificationError("the archive's directory is too large or not where it should be")
    return entries


def entry_violations(infos: list[zipfile.ZipInfo]) -> list[Violation]:
    out: list[Violation] = []
    seen: dict[str, str] = {}
    last: tuple[str, str] | None = None
    for i in infos:
        name = i.filename
        fine = {
            "entry.path": portable_path(name, normalize=False) == name and not i.is_dir(), "entry.flags": not i.flag_bits & ~0x800, "entry.stored": i.compress_type == zipfile.ZIP_STORED and i.compress_size == i.file_size <= V.MOST_ARCHIVE_BYTES,
            "entry.mode": i.create_system == ZIP_SYSTEM and i.external_attr >> 16 == ZIP_MODE, "entry.time": i.date_time == ZIP_TIME, "entry.extra": not i.extra and not i.comment,
        }
        out += [(name, check, "not as archives are written") for check, ok in fine.items() if not ok]
        key = name.casefold()
        if key in seen:
            out.append((name, "entry.unique", "a duplicate" if seen[key] == name else "collides with another entry"))
        seen[key] = name
        if last is not None and (key, name) < last:
            out.append((name, "entry.order", "out of order"))
        last = (key, name)
    return out


def readable_archive(data: bytes) -> zipfile.ZipFile:
    entries = preflight(data)
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
        raise VerificationError(f"no archive: {e}") from e
    if len(archive.infolist()) != entries:
        raise VerificationError("the archive doesn't have as many entries as it says")
    return archive


def open_archive(data: bytes) -> tuple[zipfile.ZipFile, list[Violation]]:
    archive = readable_archive(data)
    return archive, entry_violations(archive.infolist())


# reconciliation, over tables


def missing_and_extra(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, check, detail): records (path, size) without entry, entries (path, size) without record, and different sizes."""
    both = records.select("path", F.col("size").alias("told")).join(entries.select("path", F.col("size").alias("found")), "path", "full_outer")
    check = F.when(F.col("found").isNull(), "entry.missing").when(F.col("told").isNull(), "entry.extra").when(F.col("told") != F.col("found"), "entry.size")
    return both.select("path", check.alias("check"), F.concat_ws(" ", F.col("told").cast("string"), F.col("found").cast("string")).alias("detail")).where("check is not null")


def wrong_hashes(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records (path, sha256) whose entry (path, content) has another hash."""
    joined = records.select("path", "sha256").join(entries.select("path", "content"), "path").where(F.sha2("content", 256) != F.col("sha256"))
    return joined.select("path", F.lit("entry.sha256").alias("check"), F.lit("the content has another hash").alias("detail"))


def out_of_order(entries: DataFrame) -> DataFrame:
    """Entries (n, path) that come before the one ahead of them in the archive's order, and duplicates. Those of several archives have a column `archive`."""
    own = [c for c in ("archive",) if c in entries.columns]
    keyed = entries.select(*own, "n", "path", F.struct(fold_key(F.col("path")).alias("fold"), "path").alias("key"))
    before = F.lag("key").over(Window.partitionBy(*own).orderBy("n"))  # an archive has at most MOST_ENTRIES entries
    wrong = keyed.withColumn("before", before).where(F.col("key") <= F.col("before"))
    return wrong.select(*own, "path", F.lit("entry.order").alias("check"), F.lit("out of order").alias("detail"))


def total_violations(m: dict[str, Any]) -> list[Violation]:
    """What the totals say against what the records add up to."""
    sources, totals, policy = [r for r in m["entries"] if r["kind"] == "source"], m["totals"], m["policy"]
    counts: dict[str, int] = {}
    for part in [r.get("redactions", {}) for r in sources] + [m["project"].get("metadata_redactions", {})]:
        for kind, n in part.items():
            counts[kind] = counts.get(kind, 0) + n
    counts = {k: n for k, n in sorted(counts.items()) if n}
    packed, source = sum(r["size"] for r in sources), sum(r["source_size"] for r in sources)
    facts = {
        "totals.source_files": len(sources) == totals["source_files"], "totals.packed_bytes": packed == totals["packed_bytes"], "totals.source_bytes": source == totals.get("source_bytes", source),
        "totals.redactions_by_kind": counts == totals["redactions_by_kind"], "totals.redactions": sum(counts.values()) == totals["redactions"],
        "totals.candidate_files": totals["candidate_files"] == totals["source_files"] + sum(totals["excluded_by_reason"].values()),
        "policy": len(sources) <= policy["max_files"] and max(packed, source) <= policy["max_total_size"] and all(r["source_size"] <= policy["max_file_size"] for r in sources),
        "generated": {r["path"] for r in m["entries"] if r["kind"] == "generated"} == set(V.GENERATED_ENTRIES), "records.unique": len({r["path"] for r in m["entries"]}) == len(m["entries"]),
    }
    return [("MANIFEST.json", check, "doesn't fit the records") for check, fine in facts.items() if not fine]


def violations(data: bytes, hashes: bool = True) -> tuple[dict[str, Any], list[Violation]]:
    """The manifest and all violations of an archive; VerificationError if it can't be read at all."""
    archive, out = open_archive(data)
    names = {i.filename: i for i in archive.infolist()}
    if "MANIFEST.json" not in names:
        raise VerificationError("the archive has no manifest")
    m = manifest.parse(archive.read("MANIFEST.json"))
    wrong = manifest.structure_violations(m)
    if wrong:
        return m, out + wrong
    records = {r["path"]: r for r in m["entries"]}
    out += total_violations(m)
    out += [(p, "entry.missing", "") for p in sorted(records.keys() - names.keys())] + [(p, "entry.extra", "") for p in sorted(names.keys() - records.keys() - {"MANIFEST.json"})]
    for path in sorted(records.keys() & names.keys()):
        if names[path].file_size != records[path]["size"]:
            out.append((path, "entry.size", "the entry has another size"))
        elif hashes:
            try:
                right = hashlib.sha256(archive.read(path)).hexdigest() == records[path]["sha256"]
            except (zipfile.BadZipFile, ValueError):
                right = False
            if not right:
                out.append((path, "entry.sha256", "the content has another hash"))
    return m, out


def summary(m: dict[str, Any], data: bytes, hashes: bool) -> dict[str, Any]:
    t = m["totals"]
    out = {"integrity": "VERIFIED" if hashes else "NOT_VERIFIED", "project": m["project"]["name"], "source_files": t["source_files"], "packed_bytes": t["packed_bytes"], "redactions": t["redactions"], "warnings": m["warnings"]}
    return out | ({"archive_sha256": hashlib.sha256(data).hexdigest()} if hashes else {})


def _checked(path: str | Path, hashes: bool) -> dict[str, Any]:
    try:
        data = Path(path).read_bytes()
    except OSError as e:
        raise VerificationError(f"{path} can't be read") from e
    m, wrong = violations(data, hashes)
    if wrong:
        where, check, detail = wrong[0]
        raise VerificationError(f"{where}: {check}: {detail}")
    return summary(m, data, hashes)


def inspect_archive(path: str | Path) -> dict[str, Any]:
    """A summary after all checks but the hashes of contents."""
    return _checked(path, hashes=False)


def verify_archive(path: str | Path) -> dict[str, Any]:
    return _checked(path, hashes=True)


# tables of archives, checked where they are; an archive's limits bound what a task holds of it


#: Bytes and rows of a batch on its way back from Python.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4096
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _mapped(archives: DataFrame, rows: Callable[[bytes], Iterable[tuple]], form: str) -> DataFrame:
    """archives (archive, data) to rows that each archive gives, with its name in front."""
    kinds = [c.split() for c in form.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("archive"), *(pa.field(name, _ARROW[kind]) for name, kind in kinds)])
            held, size = [], 0
            for name, data in zip(batch["archive"], batch["data"]):  # one archive at a time becomes a value of Python
                name = name.as_py()
                for row in rows(data.as_py()):
                    held.append((name, *row))
                    size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield _batch(held, schema)
                        held, size = [], 0
            if held:
                yield _batch(held, schema)

    return archives.select("archive", "data").mapInArrow(run, f"archive {archives.schema['archive'].dataType.simpleString()}, {form}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def listed_entries(archives: DataFrame, wanted: Callable[[str], bool] = lambda path: True) -> DataFrame:
    """(archive, n, path, size, content) of the entries of archives (archive, data) whose path is wanted; contents of others aren't read."""

    def rows(data: bytes) -> Iterator[tuple]:
        archive = readable_archive(data)
        return ((n, i.filename, i.file_size, archive.read(i)) for n, i in enumerate(archive.infolist()) if wanted(i.filename))

    return _mapped(archives, rows, "n long, path string, size long, content binary")


def checked_archives(archives: DataFrame, hashes: bool = True) -> DataFrame:
    """(archive, path, check, detail) of all violations; an archive that can't be read at all has the check `archive`."""

    def rows(data: bytes) -> list[tuple]:
        try:
            return violations(data, hashes)[1]
        except VerificationError as e:
            return [("", "archive", str(e))]

    return _mapped(archives, rows, "path string, check string, detail string")


def archive_summaries(archives: DataFrame, hashes: bool = True) -> DataFrame:
    """(archive, integrity, project, source_files, packed_bytes, redactions) of archives without violations."""

    def rows(data: bytes) -> list[tuple]:
        try:
            m, wrong = violations(data, hashes)
        except VerificationError:
            return []
        return [] if wrong else [tuple(list(summary(m, data, hashes).values())[:5])]

    return _mapped(archives, rows, "integrity string, project string, source_files long, packed_bytes long, redactions long")


def manifest_records(archives: DataFrame) -> DataFrame:
    """(archive, path, size, sha256, source_path, source_size, redactions) of the source records in each archive's manifest."""

    def rows(data: bytes) -> list[tuple]:
        m = manifest.parse(readable_archive(data).read("MANIFEST.json"))
        return [(r["path"], r["size"], r["sha256"], r["source_path"], r["source_size"], sum(r.get("redactions", {}).values())) for r in m["entries"] if r["kind"] == "source"]

    return _mapped(archives, rows, "path string, size long, sha256 string, source_path string, source_size long, redactions long")


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, n, path, size, content): the entries of all archives that a path or pattern names, read where the archives are."""
    return listed_entries(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data")))
