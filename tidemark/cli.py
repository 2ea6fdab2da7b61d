"""The command line: init, scan, pack, inspect, verify."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import config as K
from tidemark import vocabulary as V
from tidemark.config import Config
from tidemark.errors import ScanError, SecretPolicyError, TidemarkError
from tidemark.functions.rules import Rule, parse_rules
from tidemark.functions.sizes import format_size, parse_size
from tidemark.operators import aggregates
from tidemark.operators.scan import Scan, sanitized, scan
from tidemark.plans.pack import build_archive
from tidemark.plans.verify import inspect_archive, verify_archive
from tidemark.sources import git
from tidemark.sources.tree import read_tree, walk

TEMPLATES = {
    K.FILE_NAME: f"[limits]\nmax_file_size = {V.DEFAULT_FILE_BYTES}\nmax_total_size = {V.DEFAULT_TOTAL_BYTES}\nmax_files = {V.DEFAULT_FILES}\n\n[scan]\ninclude_untracked = true\n",
    K.IGNORE_NAME: "# One pattern a line; what matches is never packed.\n",
}


def _positive(text: str) -> int:
    if not re.fullmatch("[0-9]+", text) or int(text) == 0:
        raise argparse.ArgumentTypeError("a positive whole number is needed")
    return int(text)


def _size(text: str) -> int:
    try:
        return parse_size(text)
    except TidemarkError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("init", "scan", "pack", "inspect", "verify"):
        p = commands.add_parser(name)
        p.add_argument("--json", action="store_true", help="print one JSON object")
        if name in ("inspect", "verify"):
            p.add_argument("archive")
            continue
        p.add_argument("path", nargs="?", default=".")
        if name != "scan":
            p.add_argument("--force", action="store_true", help="overwrite what exists")
        if name != "init":
            p.add_argument("--tracked-only", action="store_true")
            p.add_argument("--fail-on-secret", action="store_true")
            p.add_argument("--max-file-size", type=_size)
            p.add_argument("--max-total-size", type=_size)
            p.add_argument("--max-files", type=_positive)
        if name == "pack":
            p.add_argument("-o", "--output")
    return top


def load_rules(root: Path, fallback: bool) -> tuple[list[Rule], str]:
    """The deny rules of a directory and, without git, the rules of its .gitignore; and a token that changes with their files."""
    rules, token = [], ""
    for name, wanted in ((K.IGNORE_NAME, True), (".gitignore", fallback)):
        data = K.policy_bytes(root / name) if wanted else None
        token += K.policy_token(data)
        if data is not None:
            try:
                text = data.decode("utf-8-sig", "strict" if name == K.IGNORE_NAME else "replace")
            except UnicodeDecodeError as e:
                raise K.ConfigError(f"{name} isn't UTF-8") from e
            rules += parse_rules(text, name, negation=name != K.IGNORE_NAME)
    return rules, token


def scan_project(spark: SparkSession, path: str, config: Config | None = None, output: str | None = None) -> tuple[Scan, git.GitInfo, list[str], Path]:
    """Scan a directory; ScanError if it, its rules or its configuration change meanwhile."""
    root = git.locate_root(path)
    config = Config.load(root) if config is None else config
    config.assert_source_unchanged(root)
    relative = None
    if output is not None and Path(output).resolve().is_relative_to(root):
        relative = Path(output).resolve().relative_to(root).as_posix()
    before = git.snapshot_token(root, relative)
    listed = git.file_list(root, config.include_untracked)
    rules, token = load_rules(root, listed is None)
    warnings = ["git was not at hand; .gitignore was followed as well as could be"] if listed is None else []
    paths = [p for p in (walk(str(root)) if listed is None else listed) if relative is None or os.fsdecode(p) != relative]
    tree = read_tree(spark, str(root), config.max_file_size, paths)
    # what isn't UTF-8 can't be a string; it is unsafe, whatever else it is
    text = F.when(F.is_valid_utf8(F.col("path_raw").cast("string")), F.col("path_raw").cast("string")).otherwise(F.concat(F.lit("\\"), F.hex("path_raw")))
    files = tree.select(text.alias("path"), "size", "kind", "content").persist()
    found = scan(files, config.max_file_size, config.max_total_size, config.max_files, rules, relative)
    found.held += (files,)
    first = {r["path"]: r["sha256"] for r in found.files.select("path", "sha256").collect()}
    again = scan(tree.select(text.alias("path"), "size", "kind", "content"), config.max_file_size, config.max_total_size, config.max_files, rules, relative)
    second = {r["path"]: r["sha256"] for r in again.files.select("path", "sha256").collect()}
    again.release()
    if first != second or git.snapshot_token(root, relative) != before or load_rules(root, listed is None)[1] != token:
        found.release()
        raise ScanError("the project changed while it was scanned")
    config.assert_source_unchanged(root)
    return found, git.git_info(root, relative), warnings, root


def _payload(found: Scan) -> dict[str, Any]:
    row = aggregates.totals(found.files).first()
    kinds = {r["kind"]: r["n"] for r in aggregates.redactions_by_kind(found.files).collect()}
    for kind, n in found.path_counts.items():
        kinds[kind] = kinds.get(kind, 0) + n
    return {
        "candidate_files": found.candidates, "source_files": row["source_files"], "packed_bytes": row["packed_bytes"], "source_bytes": row["source_bytes"], "redactions": sum(kinds.values()), "redactions_by_kind": kinds,
        "excluded_by_reason": {r["reason"]: r["n"] for r in aggregates.reasons(found.skipped).collect()}, "languages": {r["language"]: r["n"] for r in aggregates.languages(found.files).collect()},
    }


def init(path: str, force: bool) -> dict[str, Any]:
    """Write both templates, or neither."""
    root = git.locate_root(path)
    targets = {root / name: text for name, text in TEMPLATES.items()}
    for target in targets:
        if target.is_symlink() or (target.exists() and not (force and target.is_file())):
            raise TidemarkError(f"{target.name} exists; force is needed")
    before = {t: t.read_bytes() if t.exists() else None for t in targets}
    staged: list[str] = []
    try:
        for target, text in targets.items():
            handle, name = tempfile.mkstemp(dir=root)
            staged.append(name)
            with os.fdopen(handle, "w") as f:
                f.write(text)
            os.replace(name, target)
    except OSError:
        for target, data in before.items():
            target.unlink(missing_ok=True) if data is None else target.write_bytes(data)
        for name in staged:
            Path(name).unlink(missing_ok=True)
        raise
    return {"created": sorted(TEMPLATES)}


def _run(args: argparse.Namespace) -> dict[str, Any]:
    if args.command == "init":
        return init(args.path, args.force)
    if args.command in ("inspect", "verify"):
        return (inspect_archive if args.command == "inspect" else verify_archive)(args.archive)
    spark = SparkSession.builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    root = git.locate_root(args.path)
    config = Config.load(root).with_overrides(max_file_size=args.max_file_size, max_total_size=args.max_total_size, max_files=args.max_files, include_untracked=False if args.tracked_only else None)
    output = None
    if args.command == "pack":
        name, counts = sanitized(root.name, 255)
        output = args.output or f"{'project' if counts else name}{V.ARCHIVE_SUFFIX}"
    found, info, warnings, root = scan_project(spark, args.path, config, output)
    try:
        payload = _payload(found)
        metadata = sum(n for text in (root.name, info.branch) for n in sanitized(text, 255)[1].values())
        if args.fail_on_secret and payload["redactions"] + metadata:
            raise SecretPolicyError("secrets were found")
        if args.command == "scan":
            return payload
        done = build_archive(found, config, output, root.name, info, tuple(warnings), args.force)
    finally:
        found.release()
    return {"archive": str(done.path), "archive_bytes": done.archive_bytes, "archive_sha256": done.sha256, "redactions": done.redactions, "source_bytes": done.source_bytes, "source_files": done.source_files}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out = _run(args)
    except TidemarkError as e:
        print(json.dumps({"error": str(e)}) if args.json else f"error: {e}", file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(f"error: {e.strerror or e}", file=sys.stderr)
        return TidemarkError.exit_code
    if args.json:
        print(json.dumps(out, sort_keys=True, ensure_ascii=True))
    else:
        for key, value in out.items():
            shown = f"{value} ({format_size(value)})" if key.endswith("bytes") else value
            print(f"{key}: {shown}".encode(sys.stdout.encoding or "utf-8", "backslashreplace").decode(sys.stdout.encoding or "utf-8"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
