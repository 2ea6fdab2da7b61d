"""Secret scans: patterns of well-known forms, and strings in sensitive contexts that a primed compressor can't shorten."""

from __future__ import annotations

import functools
import re

import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.spans import Span, span_table

BASE, KINDS = ("assign", "access", "hex"), ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # leftmost runs of 32 on: the same as all runs less the short ones
#: Candidates for novelty: whole runs of what isn't space, quote, bracket or separator; and what must stand within CONTEXT characters before one.
_APART = r"\s\"'`<>(){}\[\],;:="
_CANDIDATE = re.compile(rf"(?<![^{_APART}])[^{_APART}]{{8,}}={{0,2}}")
_SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|auth|cred|bearer|private|session|signature|pwd", re.IGNORECASE | re.ASCII)
CONTEXT, AROUND = 48, 256
#: Least bytes that a candidate adds for each of its characters; and that one of fewer than SHORT characters does.
LEAST_NOVELTY, SHORT_NOVELTY, SHORT = 0.65, 0.8, 12
LEVEL = 13


#: Words that identifiers are made of, and longer ones of prose about such matters.
_VERBS = "get set add remove create delete update find load save read write parse format build make check validate init start stop open close send receive handle process encode decode encrypt decrypt sign verify is has to from with by on max min new old default total current last next".split()
_NOUNS = "user name id key value token secret password client server session request response header body config option path file line text data list map item index count size type error message code url host port query table column row field object class method result status version date time auth access refresh api app service manager provider factory handler builder controller event state limit retry timeout cache store group role account email login public private certificate credential bean table content contents abstract base context property source target resource node tree string number interface policy address network bucket region cluster endpoint grant scope callback".split()
_PROSE = """about above according across activity additional administration agreement although analysis announcement another application applications appropriate approximately architecture archives associated association attention authentication authorities authority authorization available background beginning
 between business certificate certification characteristics children collection combination commercial committee communication communications community company comparison competition components comprehensive concentration conditions configuration configurations connection connections consequences consideration considerable constitution
 construction contemporary contributions conventional conversation corporation corresponding credentials cryptographic cryptography customers department departments description determination development developments different difficulties direction disappointment distribution documentation documents education effectiveness encryption engineering
 entertainment environment environmental environments equipment established establishment examination exceptional expectations experience experimental explanation extraordinary foundation fundamental generation government identification illustration implementation implementations implications important improvement independence independent individual
 industrial information infrastructure initialization installation institution institutional instructions integration intelligence interesting international internationalization interpretation introduction investigated investigation javascript knowledge laboratory legislation maintenance management manufacturers manufacturing mathematical measurement
 measurements mechanism multinational multiplication municipal necessarily negotiations neighbourhood normalization notifications nevertheless notwithstanding observations occasionally operations opportunities opportunity organization organizational organizations participation particularly passphrase passphrases performance permission permissions personality
 perspective philosophical photography population possibilities possibility potential preparation presentation president previously principal procedures professional proportion protection psychological publication qualifications questions recognition recommendation recommendations reconciliation registration relationship relationships
 representation representative representatives requirements responsibilities responsibility restructuring revolutionary scientific serialization significance significantly signatures situation sometimes somewhere specification specifications specifically standardization straightforward strengthening subsequently substantial successfully
 synchronization technological technologies temperature themselves throughout transaction transactional transactions transformation transformations transportation understanding undocumented unfortunately universities university unprecedented verification vulnerabilities vulnerability""".split()
_PLACES = "src/main/java/com/example/ src/test/java/org/ node_modules/ application/javascript application/json application/x-www-form-urlencoded text/html; multipart/form-data https://www. /usr/local/share/ /usr/local/bin/ /home/user/ /var/lib/ /etc/ssl/certs/ /etc/ssl/private/".split()


@functools.lru_cache(maxsize=1)
def identifier_dictionary() -> bytes:
    """Text that primes the compressor: identifiers, prose and lines as code and configuration files have them, made by rule."""
    words = list(dict.fromkeys(_VERBS + _NOUNS))
    pairs = [(v, n) for v in words for n in _NOUNS]
    joined = [f"_{v}_{n}_" for v, n in pairs] + [v.capitalize() + n.capitalize() for v, n in pairs] + [f"_{v}_{n}_".upper() for v, n in pairs]
    joined += [v + n.capitalize() for v in _VERBS for n in _NOUNS] + [f"-{v}-{n}-" for v, n in pairs]
    prose = [x for w in _PROSE for x in (w, w.capitalize())]
    lines = ["import os\nimport sys\nfrom typing import Any\n", "def main(args):\n    return None\n", "public static final String ", "const config = require('config');\n", "authorization: Bearer ", "api_key = os.environ.get('API_KEY')\n", "private_key_path: /etc/ssl/private/", "session_id=", "signature=", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/="]
    return "\n".join([" ".join(joined), " ".join(prose), *_PLACES, *lines]).encode()


@functools.lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(identifier_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(before: str, candidate: str, after: str) -> float:
    """Bytes that a candidate adds to its compressed surroundings, for each of its characters."""
    size = lambda text: len(_compressor().compress(text.encode("utf-8", "surrogatepass")))
    return (size(before + candidate + after) - size(before + after)) / max(1, len(candidate))


def base_spans(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def novel_spans(text: str, base: list[Span], least: float = LEAST_NOVELTY, short: float = SHORT_NOVELTY) -> list[Span]:
    """Candidates of 8 characters or more apart from base spans, after a sensitive word, that compress badly."""
    out, at = [], 0
    for word in _SENSITIVE.finditer(text):
        at = max(at, word.end())
        while (m := _CANDIDATE.search(text, at)) and m.start() <= word.end() + CONTEXT:
            a, at = m.span()
            if any(x < at and a < y for _, x, y in base):
                continue
            if novelty(text[max(0, a - AROUND) : a], m[0], text[at : at + AROUND]) >= (least if at - a >= SHORT else short):
                out.append(("novel", a, at))
    return out


def find_secrets(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    out = []
    for text in texts:
        base = base_spans(text)
        out.append((base, novel_spans(text, base)))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans and, if wanted, the masked text.

    Spans are in code points, ends exclusive. A null or empty text has none, and then base_sha256 is that of an empty string. Spans of
    different base kinds may overlap; novel ones overlap with no base span nor each other. Texts of any length are scanned whole.
    Repeated rows give equal rows, an empty table gives none; other columns are ignored.
    """
    return span_table(docs, find_secrets, BASE, KINDS, id_col, text_col, mask)
