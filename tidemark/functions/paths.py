"""Path predicates and projections as column expressions; Python only where Unicode tables decide."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import vocabulary as V


def normalized(path: Column) -> Column:
    """Slashes forward, without leading `./`s and without slashes at either end."""
    return F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), F.lit("/"))


def components(path: Column) -> Column:
    """The parts of a path, without empty ones and dots."""
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_suffix(path: Column) -> Column:
    """The last suffix, lower-cased: empty for dotfiles, for names that end in a dot and for those without a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def is_binary_suffix(path: Column) -> Column:
    return last_suffix(path).isin(*V.BINARY_SUFFIXES)


def language(path: Column) -> Column:
    """The language of a path's suffix, or null."""
    suffix = last_suffix(path)
    pairs = [F.lit(x) for item in V.LANGUAGES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix)


def priority(path: Column) -> Column:
    """0 for well-known names and readmes, 1 below docs, 2 near the top, 3 for sources, 4 for tests, 5 for the rest."""
    name, parts = F.lower(base_name(path)), components(path)
    top = F.lower(F.element_at(parts, 1))
    return (
        F.when(name.isin(*V.HIGH_SIGNAL_NAMES) | name.startswith("readme"), 0)
        .when(top.isin("docs", ".github"), 1)
        .when(F.size(parts) <= 2, 2)
        .when(top.isin("src", "app", "lib", "packages"), 3)
        .when(top.isin("test", "tests", "spec", "specs"), 4)
        .otherwise(5)
    )


def _one_of(values: tuple[str, ...]) -> str:
    return "|".join(re.escape(v) for v in values)


def _component(template_allowed: bool) -> str:
    """A regular expression of sensitive components, lower-cased: a credential container, or one backup copy of it."""
    exempt = f"(?!(?:{_one_of(V.ENV_TEMPLATES)})(?:/|$))" if template_allowed else ""
    rest = "[^/]*"
    forms = (_one_of(V.EXCLUDED_NAMES), exempt + r"\.env" + rest, f"(?:{_one_of(V.KEY_PREFIXES)}){rest}", rest + r"\.(?:tfstate|ppk)(?:\." + rest + ")?", f"{rest}(?:{_one_of(V.EXCLUDED_SUFFIXES)})")
    return f"(?:{'|'.join(forms)})(?:{_one_of(V.BACKUP_SUFFIXES)})?"


def is_sensitive_component(name: Column, template_allowed: bool) -> Column:
    """Whether a lower-cased component names a credential container, also as a backup copy."""
    return name.rlike(f"^(?:{_component(template_allowed)})\\z")


#: Of a lower-cased normalised path: an excluded or sensitive folder, or such a name at its end.
_EXCLUDED = (
    f"(?:^|/)(?:(?:{_one_of(V.EXCLUDED_DIRECTORIES)}|[^/]*\\.egg-info|{_component(False)})/"
    f"|(?:{_one_of((*V.EXCLUDED_DIRECTORIES, *V.EXCLUDED_NAMES))}|{_component(True)})\\z)"
)


def is_always_excluded(path: Column) -> Column:
    """Whether a normalised path lies in an excluded or sensitive directory, or has such a name. One expression decides."""
    return F.lower(path).rlike(_EXCLUDED)


def unsafe_label(path: Column) -> Column:
    """How a path that can't be shown is shown: by twelve digits of its hash."""
    return F.concat(F.lit("<unsafe-path:"), F.substring(F.sha2(path.cast("binary"), 256), 1, 12), F.lit(">"))


_UNSAFE = frozenset(V.BIDI_CONTROLS)


def _bad_character(c: str) -> bool:
    return c in _UNSAFE or unicodedata.category(c) in ("Cc", "Cs")


def portable_path(path: str, normalize: bool = True) -> str | None:
    """The path in NFC if every system can hold it, else None."""
    composed = unicodedata.normalize("NFC", path)
    if not path or "\0" in path or "\\" in path or (composed != path and not normalize):
        return None
    parts = composed.split("/")
    try:
        sizes = [len(p.encode("utf-8")) for p in parts]
    except UnicodeEncodeError:
        return None
    fine = sum(sizes) + len(parts) - 1 <= 4096 and max(sizes) <= 255 and not any(p in ("", ".", "..") for p in parts)
    fine = fine and not any(":" in p or p[-1] in " ." or p.split(".")[0].casefold() in V.RESERVED_STEMS for p in parts)
    return composed if fine and ((composed.isascii() and composed.isprintable()) or not any(map(_bad_character, composed))) else None


@F.pandas_udf(T.StringType())
def portable(path: pd.Series) -> pd.Series:
    """portable_path as a column: the composed path or null."""
    return path.map(portable_path, na_action="ignore")


def safe_path(path: Column) -> Column:
    """As `portable`; ASCII paths are decided in the JVM, and only others are sent to Python."""
    plain = ~path.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.when(is_portable_ascii(path), path)).otherwise(portable(F.when(~plain, path)))


@F.pandas_udf(T.StringType())
def folded(path: pd.Series) -> pd.Series:
    """NFC and full case folding: the key of collisions and of orders that ignore case."""
    return path.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def fold_key(path: Column) -> Column:
    """As `folded`; ASCII paths are folded without Python, and only others are sent to it."""
    plain = ~path.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(path)).otherwise(folded(F.when(~plain, path)))


def is_portable_ascii(path: Column) -> Column:
    """portable_path is not None, as a plain expression for ASCII paths; null for others."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | (F.length(p) > 255) | p.contains(":") | p.rlike(r"[ .]$") | F.lower(F.substring_index(p, ".", 1)).isin(*V.RESERVED_STEMS))
    fine = (path != "") & ~path.contains("\\") & ~path.rlike(r"[\x00-\x1F\x7F]") & (F.length(path) <= 4096) & ~bad
    return F.when(~path.rlike(r"[^\x00-\x7F]"), fine)
