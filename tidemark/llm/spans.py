"""Spans (kind, start, end) in texts: joining them to strings, digests, and queries that find them in every text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.common import pick, tidy

Span = tuple[str, int, int]


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then by the order of kinds, then by end; with commas between."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def masked(text: str, spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """The text with every span, or group of spans that overlap, replaced by the first one's kind in brackets."""
    out, done, open_to, kind = [], 0, -1, ""
    for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])):
        if a >= open_to:
            if open_to >= 0:
                out.append(f"[{kind.upper()}]")
                done = open_to
            out.append(text[done:a])
            kind, open_to = k, b
        open_to = max(open_to, b)
    if open_to >= 0:
        out.append(f"[{kind.upper()}]")
        done = open_to
    return "".join([*out, text[done:]])


def span_table(docs: DataFrame, find: Callable[[list[str]], list[tuple[list[Span], list[Span]]]], base: Sequence[str], kinds: Sequence[str], id_col: str, text_col: str, mask: bool = False) -> DataFrame:
    """doc_id, a count n_<kind> of each base kind, base_sha256, spans and, if wanted, the masked text.

    find takes a list of texts and gives each one's base spans and the others.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    form = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"n_{k} long" for k in base), "base_sha256 string", "spans string"] + ["masked string"] * mask)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            found = find(texts)
            out: dict[str, list] = {"doc_id": list(batch["doc_id"])}
            for k in base:
                out[f"n_{k}"] = [sum(s[0] == k for s in own) for own, _ in found]
            out["base_sha256"] = [hashlib.sha256(joined(own, kinds).encode()).hexdigest() for own, _ in found]
            out["spans"] = [joined([*own, *more], kinds) for own, more in found]
            if mask:
                out["masked"] = [masked(t, [*own, *more], kinds) if own or more else t for t, (own, more) in zip(texts, found, strict=True)]
            frame = pd.DataFrame(out)
            frame["doc_id"] = batch["doc_id"].to_numpy()
            yield frame

    return docs.mapInPandas(tidy(run), form)
