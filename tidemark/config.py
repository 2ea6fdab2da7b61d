"""Limits of a scan, from defaults, a TOML file and overrides."""

from __future__ import annotations

import dataclasses
import hashlib
import os
import stat
import tomllib
from pathlib import Path

from tidemark import vocabulary as V
from tidemark.errors import ConfigError

FILE_NAME = "tidemark.toml"
IGNORE_NAME = ".tidemarkignore"
_CEILINGS = {"max_file_size": V.MOST_FILE_BYTES, "max_total_size": V.MOST_TOTAL_BYTES, "max_files": V.MOST_FILES}


@dataclasses.dataclass(frozen=True)
class Config:
    max_file_size: int = V.DEFAULT_FILE_BYTES
    max_total_size: int = V.DEFAULT_TOTAL_BYTES
    max_files: int = V.DEFAULT_FILES
    include_untracked: bool = True
    source_token: str | None = dataclasses.field(default=None, compare=False)

    def __post_init__(self) -> None:
        for name, ceiling in _CEILINGS.items():
            value = getattr(self, name)
            if type(value) is not int or not 0 < value <= ceiling:
                raise ConfigError(f"{name} must be a whole number from 1 to {ceiling}")
        if type(self.include_untracked) is not bool:
            raise ConfigError("include_untracked must be true or false")

    def with_overrides(self, **changes: int | bool | None) -> Config:
        """A copy with what isn't None changed, and checked again."""
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if v is not None})

    @classmethod
    def load(cls, root: str | os.PathLike) -> Config:
        """From tidemark.toml in root, if there is one."""
        data = policy_bytes(Path(root) / FILE_NAME)
        return dataclasses.replace(cls() if data is None else cls.parse(data), source_token=policy_token(data))

    @classmethod
    def parse(cls, data: bytes) -> Config:
        """From the content of a tidemark.toml: a table [limits] and a table [scan], and nothing else."""
        try:
            told = tomllib.loads(data.decode("utf-8-sig"))
        except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{FILE_NAME} can't be read: {e}") from e
        known = {"limits": set(_CEILINGS), "scan": {"include_untracked"}}
        for table, values in told.items():
            if table not in known or not isinstance(values, dict):
                raise ConfigError(f"{FILE_NAME}: unknown table {table}")
            if extra := set(values) - known[table]:
                raise ConfigError(f"{FILE_NAME}: unknown key {sorted(extra)[0]} in {table}")
        return cls(**told.get("limits", {}), **told.get("scan", {}))

    def assert_source_unchanged(self, root: str | os.PathLike) -> None:
        if self.source_token is not None and policy_token(policy_bytes(Path(root) / FILE_NAME)) != self.source_token:
            raise ConfigError(f"{FILE_NAME} has changed since it was read")


def policy_bytes(path: Path) -> bytes | None:
    """The content of a policy file, None if there is none; it must be a regular file of bounded size that holds still."""
    try:
        before = path.lstat()
    except FileNotFoundError:
        return None
    if not stat.S_ISREG(before.st_mode):
        raise ConfigError(f"{path.name} must be a regular file")
    if before.st_size > V.MOST_POLICY_BYTES:
        raise ConfigError(f"{path.name} is too large")
    data, after = path.read_bytes(), path.lstat()
    if len(data) != before.st_size or (before.st_mtime_ns, before.st_ino) != (after.st_mtime_ns, after.st_ino):
        raise ConfigError(f"{path.name} changed while it was read")
    return data


def policy_token(data: bytes | None) -> str:
    return hashlib.sha256(b"missing" if data is None else b"present:" + data).hexdigest()
