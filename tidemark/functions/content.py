"""Content predicates and normalisation as column expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of control bytes above which content counts as binary.
MOST_CONTROLS = 0.05


def is_binary(content: Column) -> Column:
    """Any NUL, or more than a twentieth of bytes 0 to 8 and 14 to 31; empty content is text."""
    # as ISO-8859-1 each byte is one character
    plain = F.decode(content, "ISO-8859-1")
    controls = F.regexp_count(plain, F.lit("[\\x00-\\x08\\x0E-\\x1F]"))
    size = F.octet_length(content)
    return F.when(size == 0, F.lit(False)).otherwise((F.instr(plain, "\x00") > 0) | (controls / size > MOST_CONTROLS))


def text_of(content: Column) -> Column:
    """The text of UTF-8 bytes without one leading byte order mark; null if they aren't UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.when(text.startswith("﻿"), text.substr(F.lit(2), F.length(text))).otherwise(text)


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")
