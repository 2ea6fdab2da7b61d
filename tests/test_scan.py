import dataclasses
import json
import subprocess
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidemark import cli, config
from tidemark.config import Config
from tidemark.errors import ConfigError, ScanError, TidemarkError, VerificationError
from tidemark.functions import content as C
from tidemark.operators.scan import scan
from tidemark.operators.select import greedy_select
from tidemark.plans import manifest
from tidemark.plans.pack import build_archive, write_zip
from tidemark.plans.verify import archive_entries, inspect_archive, missing_and_extra, verify_archive, violations, wrong_hashes
from tidemark.sources import git
from tidemark.sources.tree import read_tree, walk

SECRET = "q7" + "Zt" * 6
FILES = {"README.md": b"hello\r\nworld", "src/app/a.py": f'password = "{SECRET}"\n'.encode(), "src/app/b.bin": b"x", "big.txt": b"y" * 3000, "zero.txt": b"a\0b", "latin.txt": b"\xff\xfe\xfd abc", ".env": b"A=1", "bom.md": b"\xef\xbb\xbfx"}


def frame(spark, files):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files.items()], "path string, size long, content binary")


def test_contents(spark):
    cases = {b"": False, b"a\0": True, b"\x01" + b"a" * 19: False, b"\x01" + b"a" * 18: True, b"a" * 9000 + b"\0": True, "é".encode(): False}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "c binary")
    assert {bytes(r.c): r.b for r in df.select("c", C.is_binary(df.c).alias("b")).collect()} == cases
    row = spark.createDataFrame([("a\r\nb\rc\n",)], "t string").select(C.unix_newlines(F.col("t")).alias("t")).first()
    assert row.t == "a\nb\nc\n"


def test_scan(spark):
    found = scan(frame(spark, FILES), max_file_size=2000)
    assert {r.path: r.packed for r in found.files.collect()} == {"README.md": "hello\nworld", "src/app/a.py": 'password = "<<REDACTED:GENERIC_SECRET>>"\n', "bom.md": "x"}
    reasons = {r.path: r.reason for r in found.skipped.collect()}
    assert reasons == {"src/app/b.bin": "binary_extension", "big.txt": "file_size_limit", "zero.txt": "binary_content", "latin.txt": "non_utf8_text", ".env": "always_excluded"}
    assert found.candidates == len(FILES) == 3 + len(reasons)


def test_collision_stops_a_scan(spark):
    with pytest.raises(ScanError):
        scan(frame(spark, {"A.md": b"1", "a.md": b"2"}))


def fold(rows, max_files, most):
    """Selection by brute force."""
    out, chosen, packed_total, source_total = {}, 0, 0, 0
    for _, _, path, planned, told, source, packed in sorted(rows, key=lambda r: r[:3]):
        if chosen >= max_files:
            out[path] = "file_limit"
        elif source_total + planned > most:
            out[path] = "source_total_size_limit"
        elif told or packed_total + packed > most:
            out[path] = told or "total_size_limit"
        else:
            out[path], chosen, packed_total, source_total = None, chosen + 1, packed_total + packed, source_total + source
    return out


@pytest.mark.parametrize("most", [0, 50, 130, 10_000])
def test_selection(spark, most):
    rows = [(i % 3, f"p{i:03}", f"P{i:03}", i * 7 % 31, "binary_content" if i % 5 == 0 else None, i * 7 % 31, None if i % 5 == 0 else i * 11 % 37) for i in range(60)]
    df = spark.createDataFrame(rows, "priority int, fold string, path string, planned_size long, read_reason string, source_size long, packed_size long")
    assert {r.path: r.reason for r in greedy_select(df, 20, most, None).collect()} == fold(rows, 20, most)


def test_inspection_limit(spark):
    rows = [(0, f"p{i}", f"p{i}", 9, "binary_content", 9, None) for i in range(5)]
    df = spark.createDataFrame(rows, "priority int, fold string, path string, planned_size long, read_reason string, source_size long, packed_size long")
    with pytest.raises(PythonException, match="more bytes"):
        greedy_select(df, 20, 10).collect()


@pytest.fixture
def packed(spark, tmp_path):
    found = scan(frame(spark, FILES), max_file_size=2000)
    result = build_archive(found, Config(max_file_size=2000), tmp_path / "a.zip", "proj")
    return found, result


def test_round_trip(spark, packed, tmp_path):
    found, result = packed
    assert verify_archive(result.path)["integrity"] == "VERIFIED" and inspect_archive(result.path)["integrity"] == "NOT_VERIFIED"
    assert SECRET.encode() not in result.path.read_bytes()
    again = build_archive(found, Config(max_file_size=2000), tmp_path / "b.zip", "proj")
    assert again.sha256 == result.sha256 and again.source_files == 3
    with pytest.raises(TidemarkError):
        build_archive(found, Config(max_file_size=2000), tmp_path / "b.zip", "proj")
    rows = archive_entries(spark, str(result.path)).collect()
    m = json.loads(next(r.content for r in rows if r.path == "MANIFEST.json"))
    records = spark.createDataFrame([(r["path"], r["size"], r["sha256"]) for r in m["entries"]], "path string, size long, sha256 string")
    entries = archive_entries(spark, str(result.path)).where("path <> 'MANIFEST.json'")
    assert missing_and_extra(records, entries).isEmpty() and wrong_hashes(records, entries).isEmpty()


def rewritten(path, change):
    with zipfile.ZipFile(path) as z:
        entries = [(i.filename, z.read(i)) for i in z.infolist()]
    write_zip(change(entries), path)
    return path


@pytest.mark.parametrize(
    "change, check",
    [
        (lambda e: [(n, c.replace(b"hello", b"hullo")) for n, c in e], "entry.sha256"),
        (lambda e: [(n, c + b"x" if n == "files/README.md" else c) for n, c in e], "entry.size"),
        (lambda e: [x for x in e if x[0] != "files/README.md"], "entry.missing"),
        (lambda e: sorted([*e, ("files/zz", b"")], key=lambda x: (x[0].casefold(), x[0])), "entry.extra"),
        (lambda e: e[::-1], "entry.order"),
        (lambda e: [(n.replace("README.md", "a:b"), c) for n, c in e], "entry.path"),
        (lambda e: [(n, c.replace(b'"redactions": 1,\n    "redactions_by', b'"redactions": 2,\n    "redactions_by')) for n, c in e], "totals.redactions"),
    ],
)
def test_tampering(packed, change, check):
    path = rewritten(packed[1].path, change)
    assert check in {c for _, c, _ in violations(path.read_bytes())[1]}
    with pytest.raises(VerificationError):
        verify_archive(path)


@pytest.mark.parametrize("text", ['{"a": 1}', '{\n  "a": 1.5\n}\n', '{\n  "a": 1,\n  "a": 1\n}\n', '{\n  "a": ' + "9" * 5000 + "\n}\n", "[" * 2000, '{\n  "a": NaN\n}\n', "\xff"])
def test_strict_manifest(text):
    with pytest.raises(VerificationError):
        manifest.parse(text.encode("latin-1"))


@pytest.mark.parametrize("data", [b"", b"PK" * 30, b"x" * 22])
def test_no_archive(tmp_path, data):
    (tmp_path / "x.zip").write_bytes(data)
    with pytest.raises(VerificationError):
        inspect_archive(tmp_path / "x.zip")


def test_config(tmp_path):
    assert Config.load(tmp_path) == Config()
    path = tmp_path / config.FILE_NAME
    path.write_text("﻿[limits]\nmax_files = 7\n[scan]\ninclude_untracked = false\n", encoding="utf-8")
    loaded = Config.load(tmp_path)
    assert loaded.max_files == 7 and not loaded.include_untracked
    path.write_text("[limits]\nmax_files = 8\n")
    with pytest.raises(ConfigError):
        loaded.assert_source_unchanged(tmp_path)
    for text in ("[other]\n", "[limits]\nx = 1\n", "[limits]\nmax_files = 0\n", "[limits]\nmax_files = true\n", "[limits]\nmax_file_size = 99999999999\n", "[limits\n"):
        path.write_text(text)
        with pytest.raises(ConfigError):
            Config.load(tmp_path)
    with pytest.raises(ConfigError):
        Config().with_overrides(max_files=10_001)
    assert dataclasses.replace(Config(), max_files=3).max_files == 3


def tree(root):
    for name, data in {"a.py": b"x = 1\n", "_p/__init__.py": b"", ".gitignore": b"*.log\n", "b.log": b"l", "node_modules/m.js": b"m", ".ssh/k": b"k"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "link").symlink_to("a.py")


def test_tree(spark, tmp_path):
    tree(tmp_path)
    assert walk(str(tmp_path)) == [b".gitignore", b"_p/__init__.py", b"a.py", b"b.log", b"link"]
    rows = {bytes(r.path_raw): r.kind for r in read_tree(spark, str(tmp_path)).select("path_raw", "kind").collect()}
    assert rows[b"link"] == "symlink_or_junction" and rows[b"_p/__init__.py"] == "file"


def _git(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args], cwd=root, check=True, capture_output=True)


def test_git(tmp_path):
    if git.git_binary(tmp_path) is None:
        pytest.skip("no git")
    tree(tmp_path)
    assert git.file_list(tmp_path) is None and not git.git_info(tmp_path).available
    _git(tmp_path, "init", "-q", "-b", "main")
    _git(tmp_path, "add", "-f", "a.py", "b.log")
    _git(tmp_path, "commit", "-qm", "x")
    assert b"b.log" not in git.file_list(tmp_path) and git.file_list(tmp_path, False) == [b"a.py"]
    info, token = git.git_info(tmp_path), git.snapshot_token(tmp_path)
    assert info.available and info.branch == "main" and len(info.commit) == 40 and info.dirty
    (tmp_path / "new.txt").write_text("n")
    assert git.snapshot_token(tmp_path) != token
    with pytest.raises(ScanError):
        git.locate_root(tmp_path / "_p")


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text(f'password = "{SECRET}"\n')
    assert cli.main(["init", str(root), "--json"]) == 0 and cli.main(["init", str(root)]) == 5 and cli.main(["init", str(root), "--force"]) == 0
    out = str(tmp_path / "o.zip")
    capsys.readouterr()
    assert cli.main(["pack", str(root), "-o", out, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["redactions"] == 1
    assert cli.main(["verify", out]) == 0 and cli.main(["inspect", out, "--json"]) == 0 and cli.main(["verify", str(tmp_path / "none.zip")]) == 4
    assert cli.main(["scan", str(root), "--fail-on-secret"]) == 3
    (root / config.FILE_NAME).write_text("[x]\n")
    assert cli.main(["scan", str(root)]) == 2


def test_git_is_never_the_projects_own(tmp_path, monkeypatch):
    real = git.git_binary(tmp_path)
    if real is None:
        pytest.skip("no git")
    planted, link = tmp_path / "git", tmp_path.parent / "links"
    planted.write_text("#!/bin/sh\nexit 1\n")
    planted.chmod(0o755)
    link.mkdir(exist_ok=True)
    (link / "git").unlink(missing_ok=True)
    (link / "git").symlink_to(planted)
    import os

    monkeypatch.setenv("PATH", os.pathsep.join([str(tmp_path), "relative", str(link), os.path.dirname(real)]))
    assert git.git_binary(tmp_path) == os.path.realpath(real)


def test_git_runs_apart(tmp_path, monkeypatch):
    if git.git_binary(tmp_path) is None:
        pytest.skip("no git")
    _git(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    given, before = [], subprocess.Popen
    monkeypatch.setattr(git.subprocess, "Popen", lambda command, **more: given.append((command, more["env"])) or before(command, **more))
    monkeypatch.setenv("GIT_DIR", "/nowhere")
    assert git.file_list(tmp_path) == [b"a", b"b"]
    assert all("protocol.allow=never" in command and env["GIT_NO_LAZY_FETCH"] == "1" and "GIT_DIR" not in env for command, env in given)
    monkeypatch.setattr(git.V, "MOST_CANDIDATES", 1)
    with pytest.raises(ScanError, match="too many"):
        git.file_list(tmp_path)
    monkeypatch.setattr(git, "MOST_OUTPUT", 1)
    with pytest.raises(ScanError, match="too much"):
        git.run_git(tmp_path, "ls-files", "--others")


def test_packing_twice_gives_equal_bytes(spark, tmp_path, capsys):
    """The archive that the first run leaves in a clean repository changes neither its state nor the second archive."""
    if git.git_binary(tmp_path) is None:
        pytest.skip("no git")
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    _git(root, "init", "-q", "-b", "main")
    _git(root, "add", "a.py")
    _git(root, "commit", "-qm", "x")
    out, seen = root / "out [1]!.zip", []
    for more in ([], ["--force"]):
        assert cli.main(["pack", str(root), "-o", str(out), "--json", *more]) == 0
        seen.append(out.read_bytes())
        with zipfile.ZipFile(out) as z:
            assert json.loads(z.read("MANIFEST.json"))["project"]["git"]["dirty"] is False
    assert seen[0] == seen[1] and git.git_info(root).dirty and not git.git_info(root, out.name).dirty


def test_skipped_files_are_in_order(spark):
    found = scan(frame(spark, {"b.png": b"x", "A.png": b"x", "z.bin": b"x", ".env": b"x", "c.txt": b"\xff\xfe\xfd"}), max_file_size=2000)
    rows = [(r.reason, r.path) for r in found.skipped.collect()]
    assert rows == sorted(rows, key=lambda x: (x[0], x[1].casefold())) and len(rows) == 5
    found.release()


def test_paths_in_the_jvm_and_in_python_agree(spark):
    paths = ["a.py", "./a//b", "con.txt", "x:y", "é.md", "é.md", "end.", "k/AKIA" + "Z9" * 8, "api_key=" + "q7" * 9, "a\\b", "", "/", "..", "‮x", "x" * 300, "a\x07b", None, "ok/sk-proj-" + "a1" * 12 + "/x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    from tidemark.functions.paths import portable_path
    from tidemark.functions.redaction import redact
    from tidemark.operators.scan import path_stage

    rows = {r.path: r for r in path_stage(df).collect()}
    for p in paths:
        clean = None if p is None or "\\" in p else p.removeprefix("./").strip("/")
        safe = portable_path(clean) if clean is not None else None
        assert rows[p].safe_path == safe, p
        assert (rows[p].path_counts or {}) == (redact(safe)[1] if safe else {}), p
        assert (rows[p].path_reason == "unsafe_path") == (safe is None) and (rows[p].path_reason == "secret_in_path") == bool(safe and redact(safe)[1]), p


def test_order_within_each_archive(spark):
    from tidemark.plans.verify import out_of_order

    rows = [("x", 0, "a"), ("x", 1, "c"), ("x", 2, "B"), ("y", 0, "b"), ("y", 1, "b"), ("y", 2, "c")]
    found = out_of_order(spark.createDataFrame(rows, "archive string, n long, path string")).collect()
    assert sorted((r.archive, r.path) for r in found) == [("x", "B"), ("y", "b")]


def test_init_undoes_a_half_done_start(tmp_path, monkeypatch):
    calls, before = [], cli.os.replace
    monkeypatch.setattr(cli.os, "replace", lambda a, b: calls.append(b) or (before(a, b) if len(calls) == 1 else (_ for _ in ()).throw(OSError("full"))))
    with pytest.raises(OSError):
        cli.init(str(tmp_path), False)
    assert list(tmp_path.iterdir()) == []
