"""Personal data: patterns of well-known forms, and a character tagger that adds what they miss.

Every kind's span holds a digit, an @ or the word "at", so only windows with one of those are decoded; elsewhere no span of any kind
can be. Windows overlap by half, and the spans of all windows of a text are reconciled at once: the set without overlaps whose scores
add up highest. A span's score is what the best path gains over the same path with the span's characters outside: never negative.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import tidy
from tidemark.llm.spans import Span, masked, span_table
from tidemark.llm.tagger import Tagger, character_ids, fit

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])(?:at|AT)(?![A-Za-z])")
#: Characters of a window and between the starts of windows; windows that are decoded at once.
WINDOW, STRIDE, AT_ONCE = 64, 32, 512
#: What may stand for the @ and the dots of an address.
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[(\[](?:at|AT)[)\]]\x20?|\x20(?:at|AT)\x20)", r"(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?|\x20(?:dot|DOT)\x20)"
_ADDRESS = re.compile(rf"[\w%+-]+(?:(?:\.|{_DOT})[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*")
_SPACED_IP = re.compile(r"[0-9]{1,3}(\x20?\.\x20?[0-9]{1,3}){3}")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20/-]+[0-9]")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [2 * v - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def fits(kind: str, text: str) -> bool:
    """What holds of a match of a kind's pattern besides its form."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(_small, text.split(".")))
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    if not _TRIGGER.search(text):
        return []
    patterns = [("email", _EMAIL)] if "@" in text else []
    patterns += [("ip", _IP), ("card", _CARD)] + [("phone", _PHONE)] * ("+" in text)
    return [(kind, m.start(), m.end()) for kind, pattern in patterns for m in pattern.finditer(text) if fits(kind, m[0])]


def plausible(kind: str, text: str) -> bool:
    """What a span of the tagger must hold to be added: the parts that make it one of its kind."""
    digits = _digits(text)
    if kind == "email":
        found = _ADDRESS.fullmatch(text)
        return found is not None and ("@" in text or re.search(_DOT, text) is not None)
    if kind == "ip":
        return _SPACED_IP.fullmatch(text) is not None and fits("ip", text.replace(" ", ""))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and _NUMBER.fullmatch(text) is not None and re.search(r"[().\x20/-]", text) is not None


def labelled_spans(count: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Windows of made-up text with labelled spans, in the base forms and others, among numbers that are none."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que ä ü é è ñ schen ung mente".split()
    number = lambda low, high: "".join(rng.choice("0123456789") for _ in range(rng.randint(low, high)))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        digits = number(15, 15)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return rng.choice(["", " ", "-", ".", "."]).join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3, 3), number(3, 3), number(4, 4)
        sep = rng.choice("- ./")
        return rng.choice([f"+{number(1, 2)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"{a}{sep}{b}{sep}{c}", f"+{number(1, 2)}{sep}{a}{sep}{b}{sep}{c}"])

    def email() -> str:
        name = lambda: re.sub(r"[^a-z]", "", word()) or "x"
        user = rng.choice([number(1, 4), name(), name()]) + rng.choice(["", ".", ".", "_"]) + rng.choice(["", number(1, 3), "an", name(), name()])
        host = [rng.choice(["mail", "post", "host", "box", name()]) + number(0, 2), *rng.choice(["example.com", "example.org", "net", "test", "org"]).split(".")]
        at, dot = rng.choice([("@", "."), ("@", "."), (" @ ", "."), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", ".")])
        return (user.strip("._") or "x").replace(".", dot if rng.random() < 0.5 else ".") + at + dot.join(host)

    ip = lambda: rng.choice([".", ".", " . "]).join(str(rng.randrange(256)) for _ in range(4))
    plain = [lambda: number(1, 8), lambda: number(16, 16), lambda: f"{number(1, 3)}.{number(1, 2)}", lambda: f"{number(4, 4)}-{number(2, 2)}-{number(2, 2)}", lambda: f"{number(2, 2)}:{number(2, 2)}", lambda: "%x" % rng.getrandbits(128), lambda: f"v{number(1, 1)}.{number(1, 2)}.{number(1, 2)}", lambda: f"@{word()}", lambda: f"{number(2, 3)}%", lambda: f"{number(3, 3)}-{number(2, 4)}", lambda: f"{word()} at {word()}", lambda: f"{word()} at {number(1, 2)}", lambda: rng.choice("abcx") * rng.randint(5, 40)]
    kinds = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 8))), []
        while len(text) < WINDOW:
            text += rng.choice([" ", " ", " ", ". ", ", ", "\n", " | "])
            if rng.random() < 0.3:
                kind = rng.choice(KINDS)
                value = kinds[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + rng.choice(["", "", ".", "###", ","])
            else:
                text += rng.choice(plain)() if rng.random() < 0.3 else word()
        cut = rng.randint(0, max(0, len(text) - WINDOW)) if rng.random() < 0.5 else 0
        out.append((text[cut : cut + WINDOW], [(k, max(a - cut, 0), min(b - cut, WINDOW)) for k, a, b in spans if b > cut and a - cut < WINDOW]))
    return out


def windows_to_arrays(windows: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for row, (text, spans) in enumerate(windows):
        ids[row, : len(text)] = character_ids(text)
        for kind, a, b in spans:
            tags[row, a:b] = 2 + 2 * KINDS.index(kind)
            tags[row, a] = 1 + 2 * KINDS.index(kind)
    return ids, tags


@functools.lru_cache(maxsize=1)
def trained(windows: int = 5000, steps: int = 450) -> Tagger:
    return fit(*windows_to_arrays(labelled_spans(windows)), TAGS, hidden=20, steps=steps)


def window_spans(path: np.ndarray, emissions: np.ndarray, model: Tagger, starts: list[int], ends: list[int]) -> list[tuple[float, str, int, int]]:
    """(score, kind, start, end) of all windows' spans in text positions; a span that touches a cut edge has half its score."""
    steps, out = model.p["transitions"], []
    for row in np.flatnonzero(path.any(axis=1)).tolist():
        tags, t = path[row], 0
        while t < WINDOW:
            if not tags[t]:
                t += 1
                continue
            kind, first = (int(tags[t]) - 1) // 2, t
            t += 1
            while t < WINDOW and tags[t] == 2 + 2 * kind:
                t += 1
            gain = (emissions[row, np.arange(first, t), tags[first:t]] - emissions[row, first:t, 0]).sum() + (steps[tags[first : t - 1], tags[first + 1 : t]] - steps[0, 0]).sum()
            gain += steps[tags[first - 1], tags[first]] - steps[tags[first - 1], 0] if first else model.p["first"][tags[first]] - model.p["first"][0]
            gain += steps[tags[t - 1], tags[t]] - steps[0, tags[t]] if t < WINDOW else model.p["last"][tags[t - 1]] - model.p["last"][0]
            a, b = starts[row] + first, min(starts[row] + t, ends[row])
            if b > a:
                cut = (first == 0 and starts[row] > 0) or (t == WINDOW and starts[row] + WINDOW < ends[row])
                out.append((float(gain) / 2 if cut else float(gain), KINDS[kind], a, b))
    return out


def reconciled(spans: list[tuple[float, str, int, int]]) -> list[Span]:
    """The spans without overlaps whose scores add up highest; of ties, those that end first."""
    spans = sorted(set(spans), key=lambda s: (s[3], s[2], s[1]))
    ends = [s[3] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for k, (score, _, a, _) in enumerate(spans):
        before = int(np.searchsorted(ends[:k], a, "right"))
        taken = best[before][0] + score
        best.append((taken, before, True) if taken > best[k][0] else (best[k][0], k, False))
    out, k = [], len(spans)
    while k:
        _, before, taken = best[k]
        if taken:
            out.append(spans[k - 1][1:])
        k = before
    return out[::-1]


def tagged_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """Each text's reconciled spans; what can't be of its kind takes no part."""
    rows = []
    for n, text in enumerate(texts):
        own = sorted({s for m in _TRIGGER.finditer(text) for s in (m.start() // STRIDE * STRIDE, m.start() // STRIDE * STRIDE - STRIDE) if s >= 0})
        rows += [(n, s) for s in own]
    found: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    for at in range(0, len(rows), AT_ONCE):
        part = rows[at : at + AT_ONCE]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for k, (n, s) in enumerate(part):
            piece = character_ids(texts[n][s : s + WINDOW])
            ids[k, : len(piece)] = piece
        path, emissions = model.decode(ids)
        for k, (n, s) in enumerate(part):
            if path[k].any():
                spans = window_spans(path[k : k + 1], emissions[k : k + 1], model, [s], [len(texts[n])])
                found[n] += [x for x in spans if plausible(x[1], texts[n][x[2] : x[3]])]
    return [reconciled(x) if x else [] for x in found]


def find_personal_data(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, model), strict=True):
        base = base_spans(text)
        more = [s for s in tagged if not any(a < s[2] and s[1] < b for _, a, b in base)]
        out.append((base, more))
    return out


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if wanted, the masked text.

    Spans are in code points, ends exclusive. A null or empty text has none, and then base_sha256 is that of an empty string. Base spans of
    different kinds may overlap; the tagger adds none that overlaps with a base span. Texts of any length are scanned whole; of spans with
    equal scores those that end first are taken. Repeated rows give equal rows, an empty table gives none; other columns are ignored. The tagger's few thousand weights are broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained())
    return span_table(docs, lambda texts: find_personal_data(texts, model.value), KINDS, KINDS, id_col, text_col, mask)


def masked_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data in text_col replaced by [EMAIL], [IP], [CARD] or [PHONE] and length_col set to the new length.

    Other columns are carried along unchanged; a text without personal data stays as it is, and a null one null.
    """
    names = docs.columns
    if names.count(text_col) != 1 or length_col not in names:
        raise ValueError(f"one column {text_col} and a column {length_col} are needed")
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            found = find_personal_data([x or "" for x in texts], model.value)
            texts = [masked(t, [*own, *more], KINDS) if own or more else t for t, (own, more) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(texts, batch.schema.field(names.index(text_col)).type)
            lengths = [None if t is None else len(t) for t in texts]
            columns[names.index(length_col)] = pa.array(lengths, batch.schema.field(names.index(length_col)).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
