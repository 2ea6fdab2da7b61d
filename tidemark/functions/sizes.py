"""Sizes such as 10MiB: parsing and formatting, as columns and as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigError

#: A number and a unit of 1024 to some power; `i` and `b` are optional.
PATTERN = r"^\s*([0-9]+)\s*(?:([kmgt])i?)?b?\s*$"
_UNITS = "kmgt"


def parse_size(text: str) -> int:
    m = re.match(PATTERN, text, re.IGNORECASE | re.ASCII)
    if not m or int(m[1]) == 0:
        raise ConfigError(f"not a size: {text!r}")
    return int(m[1]) << 10 * (_UNITS.index(m[2].lower()) + 1 if m[2] else 0)


def parsed_size(text: Column) -> Column:
    """The size in bytes, or null for what is none or zero."""
    number, unit = F.regexp_extract(text, f"(?i){PATTERN}", 1), F.lower(F.regexp_extract(text, f"(?i){PATTERN}", 2))
    factor = F.coalesce(*(F.when(unit == u, F.lit(1 << 10 * (k + 1))) for k, u in enumerate(_UNITS)), F.lit(1))
    return F.when((number != "") & (number.try_cast("bigint") > 0), number.try_cast("bigint") * factor)


def format_size(size: int) -> str:
    if size < 1024:
        return f"{size} B"
    unit = min((size.bit_length() - 1) // 10, 3)
    return f"{size / (1 << 10 * unit):.1f} {' KMG'[unit]}iB"


def formatted_size(size: Column) -> Column:
    """As format_size; halves are rounded to even digits, as Python does it."""

    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(1 << 10 * power)), 1))

    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, shown(1, "KiB")).when(size < 1 << 30, shown(2, "MiB")).otherwise(shown(3, "GiB"))
