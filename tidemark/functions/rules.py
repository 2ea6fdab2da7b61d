"""Deny and ignore rules: parsing, and compilation to regular expressions that Spark evaluates natively.

A rule becomes one anchored expression over the normalised path. `*` and `?` cross slashes; a path pattern is held against the whole
path and, from the right, against as many components as it has; a directory pattern against every run of components of its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import vocabulary as V
from tidemark.errors import ConfigError


class Rule(NamedTuple):
    pattern: str
    negated: bool = False
    deny: bool = True


def parse_rules(text: str, name: str = "rules", negation: bool = False) -> list[Rule]:
    """One rule a line; blank lines and comments are skipped. `!` takes a path back where negation is allowed."""
    out: list[Rule] = []
    for number, line in enumerate(map(str.strip, text.removeprefix("﻿").splitlines()), 1):
        if not line or line[0] == "#":
            continue
        if line[0] == "!" and not negation:
            raise ConfigError(f"{name}:{number}: rules that take paths back are not allowed here")
        pattern = line.removeprefix("!").replace("\\", "/")
        pattern = pattern if pattern.isascii() else unicodedata.normalize("NFC", pattern)
        if len(pattern) > V.MOST_PATTERN_BYTES or len(pattern.encode()) > V.MOST_PATTERN_BYTES:
            raise ConfigError(f"{name}:{number}: the pattern is too long")
        if pattern:
            out.append(Rule(pattern, line[0] == "!", not negation))
    if len(out) > V.MOST_RULES:
        raise ConfigError(f"{name} has too many rules")
    return out


def _glob(pattern: str, star: str, one: str) -> str:
    """A glob as a regular expression that Python and Java read alike."""
    out, k = [], 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append(one)
        elif c == "[" and (close := pattern.find("]", k + 1 + (pattern[k : k + 1] == "!"))) >= 0:
            body, k = pattern[k:close], close + 1
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body.removeprefix("!"))
            out.append(f"[{'^' * body.startswith('!')}{inner}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", c) if ord(c) < 128 else c)
    return "".join(out)


def compiled(pattern: str) -> str | None:
    """The regular expression of a rule's pattern, to be matched against the whole normalised path; None: it fits nothing."""
    anchored, directory = pattern.startswith("/"), pattern.rstrip("/") != pattern
    bare = pattern.strip("/") if directory else pattern.lstrip("/")
    if not bare:
        return None
    anywhere = _glob(bare, "[\\s\\S]*", "[\\s\\S]")
    if directory and anchored:  # taken literally
        return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", bare) + "(?:/[\\s\\S]*)?"
    if directory:
        # components can't hold slashes, so within a run of as many components as the pattern has, a wildcard crosses one only if
        # another slash of the pattern is missing from the run; that can't be, and wildcards stay within components
        return f"(?:[\\s\\S]*/)?{_glob(bare, '[^/]*', '[^/]')}(?:/[\\s\\S]*)?"
    if anchored or "/" in bare:
        return f"(?:{anywhere}|(?:[\\s\\S]*/)?{_glob(bare, '[^/]*', '[^/]')})"
    return f"(?:[\\s\\S]*/)?{_glob(bare, '[^/]*', '[^/]')}(?:/[\\s\\S]*)?"


def matches(pattern: str, path: str) -> bool:
    expression = compiled(pattern)
    return expression is not None and re.fullmatch(expression, path) is not None


def is_denied(path: str, rules: Sequence[Rule]) -> bool:
    """Whether the rules leave out a normalised path; the plain form of `denied`."""
    path, out = unicodedata.normalize("NFC", path), False
    for rule in rules:
        if matches(rule.pattern, path):
            if rule.deny:
                return True
            out = not rule.negated
    return out


def denied(path: Column, rules: Sequence[Rule]) -> Column:
    """Any deny rule that fits decides; of the others the last one that fits does. One expression, no Python."""
    found = F.lit(False)
    for rule in rules:
        expression = compiled(rule.pattern)
        if expression is not None and not rule.deny:
            found = F.when(path.rlike(f"^(?:{expression})\\z"), F.lit(not rule.negated)).otherwise(found)
    for rule in rules:
        expression = compiled(rule.pattern)
        if expression is not None and rule.deny:
            # rules that come before an ignore rule of the same list still decide: a deny rule is final wherever it stands
            found = path.rlike(f"^(?:{expression})\\z") | found
    return found
