"""What git knows of a directory, through a git that runs with a clean environment and bounded output."""

from __future__ import annotations

import dataclasses
import hashlib
import os
import shutil
import subprocess
import tempfile
import time
from pathlib import Path

from tidemark import vocabulary as V
from tidemark.errors import ScanError

SECONDS, MOST_OUTPUT, MOST_ERRORS = 30, 32 * V.MIB, V.MIB


@dataclasses.dataclass(frozen=True)
class GitInfo:
    available: bool = False
    branch: str | None = None
    commit: str | None = None
    dirty: bool | None = None


def git_binary(root: Path) -> str | None:
    """The first git on the path that lies outside of the project, both as it is named and where its links lead."""
    tops = {os.path.abspath(root), os.path.realpath(root)}
    for folder in filter(os.path.isabs, os.environ.get("PATH", "").split(os.pathsep)):
        found = shutil.which("git", path=folder)
        if found and not any(Path(place).is_relative_to(top) for place in (os.path.abspath(found), os.path.realpath(found)) for top in tops):
            return os.path.realpath(found)
    return None


def run_git(root: Path, *args: str, stdin: bytes = b"") -> tuple[int, bytes] | None:
    """(exit code, output) of a git command in root; None without git. It is stopped when it takes too long or says too much.

    It gets none of the caller's git settings, asks for nothing, runs no monitor and fetches nothing, not even what a partial clone lacks.
    """
    binary = git_binary(root)
    if binary is None:
        return None
    env = {k: v for k, v in os.environ.items() if not k.upper().startswith("GIT_")}
    env |= {"GIT_OPTIONAL_LOCKS": "0", "GIT_TERMINAL_PROMPT": "0", "GIT_NO_LAZY_FETCH": "1", "LC_ALL": "C"}
    settings = ("core.fsmonitor=false", "core.untrackedCache=false", "protocol.allow=never", "protocol.ext.allow=never", "submodule.recurse=false")
    command = [binary, *(x for setting in settings for x in ("-c", setting)), "-C", os.fspath(root), *args]
    with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as errors:
        given.write(stdin)
        given.seek(0)
        try:
            process = subprocess.Popen(command, cwd=os.path.dirname(binary), env=env, stdin=given, stdout=out, stderr=errors)
        except OSError as e:
            raise ScanError(f"git {args[0]} can't be run") from e
        latest, running = time.monotonic() + SECONDS, True
        while running:
            try:
                process.wait(timeout=0.02)
                running = False
            except subprocess.TimeoutExpired:
                pass
            loud = any(os.fstat(f.fileno()).st_size > most for f, most in ((out, MOST_OUTPUT), (errors, MOST_ERRORS)))
            if loud or (running and time.monotonic() > latest):
                process.kill()
                process.wait()
                raise ScanError(f"git {args[0]} {'says too much' if loud else 'takes too long'}")
        out.seek(0)
        return process.returncode, out.read()


def _line(root: Path, *args: str) -> str | None:
    done = run_git(root, *args)
    return done[1].decode("utf-8", "replace").strip() or None if done and done[0] == 0 else None


def locate_root(path: str | os.PathLike) -> Path:
    """The directory itself, which mustn't be below the top of a repository."""
    root = Path(path).expanduser().resolve()
    if not root.is_dir():
        raise ScanError(f"{path} is no directory")
    top = _line(root, "rev-parse", "--show-toplevel")
    if top is not None and Path(top).resolve() != root:
        raise ScanError(f"{path} lies inside a repository; its top is the root to use")
    return root


def file_list(root: Path, include_untracked: bool = True) -> list[bytes] | None:
    """Tracked files and, if wanted, untracked ones, less all that ignore rules name; None outside of a work tree."""
    if _line(root, "rev-parse", "--is-inside-work-tree") != "true":
        return None
    done = run_git(root, "ls-files", "--cached", *(["--others", "--exclude-standard"] if include_untracked else []), "--deduplicate", "-z", "--")
    if not done or done[0]:
        raise ScanError("git can't list the files")
    listed = done[1]
    if len(listed) > V.MOST_PATH_BYTES or (listed and not listed.endswith(b"\0")):
        raise ScanError("git's list of files is malformed or too long")
    if listed.count(b"\0") > V.MOST_CANDIDATES:  # before any path is made of it
        raise ScanError("git lists too many files")
    paths = {p for p in listed.split(b"\0") if p}
    if not paths:
        return []
    checked = run_git(root, "check-ignore", "--no-index", "--stdin", "-z", stdin=b"\0".join(sorted(paths)) + b"\0")
    if not checked or checked[0] not in (0, 1):
        raise ScanError("git can't check the ignore rules")
    return sorted(paths - set(checked[1].split(b"\0")))


def _status(root: Path, excluded: str | None = None) -> bytes | None:
    """What is changed or untracked, but for one path: an archive that is written into the project doesn't change its state."""
    other = [f":(exclude,literal){excluded}"] if excluded else []
    done = run_git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all", "--ignore-submodules=all", "--", ".", *other)
    return done[1] if done and done[0] == 0 else None


def git_info(root: Path, excluded: str | None = None) -> GitInfo:
    if _line(root, "rev-parse", "--is-inside-work-tree") != "true":
        return GitInfo()
    status = _status(root, excluded)
    return GitInfo(True, _line(root, "branch", "--show-current"), _line(root, "rev-parse", "--verify", "-q", "HEAD"), None if status is None else bool(status))


def snapshot_token(root: Path, excluded: str | None = None) -> str | None:
    """Changes with the commit, the branch and the state of the work tree; None outside of one."""
    info = git_info(root, excluded)
    if not info.available:
        return None
    return hashlib.sha256(b"\0".join([(info.commit or "").encode(), (info.branch or "").encode(), _status(root, excluded) or b""])).hexdigest()
