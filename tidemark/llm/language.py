"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, tidy

#: n-grams of 1 to 3 characters, hashed into so many buckets each.
SIZES, BITS = (1, 2, 3), 15
#: Labelled documents that training reads at most, about; chosen by a hash of doc_id, by language.
TRAIN_ROWS = 20_000
#: Characters that are worked off at a time.
PIECE = 1 << 18
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


_LETTER: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, anything else as a space."""
    if not _LETTER:
        _LETTER.append(_letters())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTER[0][points], points, np.uint32(32))


def gram_buckets(points: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each size, the bucket of the n-gram that begins at each place; -1 for nothing but spaces."""
    out, total, blank = [], np.zeros(len(points), np.uint32), points == 32
    for k in SIZES:
        n = max(0, len(points) - k + 1)
        total = total[:n] + points[k - 1 : k - 1 + n] * _FACTORS[k - 1]
        blank = blank[:n] & (points[k - 1 : k - 1 + n] == 32)
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = (mixed >> np.uint32(32 - BITS)).astype(np.int32) + np.int32((k - 1) << BITS)
        bucket[blank] = -1
        out.append((k, bucket))
    return out


WIDTH = len(SIZES) << BITS


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """A long text's code points in pieces, each with the following places that n-grams reach into, and its own length. Spaces follow a text."""
    reach = max(SIZES) - 1
    for at in range(0, len(text), PIECE):
        own, after = codes(text[at : at + PIECE]), codes(text[at + PIECE : at + PIECE + reach])
        yield np.concatenate([own, after, np.full(max(0, reach - len(after)), 32, np.uint32)]), len(own)


def gram_counts(text: str) -> np.ndarray:
    counts = np.zeros(WIDTH, np.int64)
    for points, own in pieces(text):
        for _, bucket in gram_buckets(points):
            used = bucket[:own]
            counts += np.bincount(used[used >= 0], minlength=WIDTH)
    return counts


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    """langs: in order; log_probability: a row for each n-gram bucket and one of zeros at the end; prior: logarithms."""

    langs: tuple[str, ...]
    log_probability: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of the highest posterior; and its score, the posterior that 20 letters with the text's mean log-likelihood would have."""
        found, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return found, scores
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        gathered: list[tuple[int, np.ndarray, int]] = []
        held = 0

        def work_off() -> None:
            nonlocal held
            if not gathered:
                return
            rows, points = [i for i, _, _ in gathered], np.concatenate([x for _, x, _ in gathered])
            ends = np.cumsum([len(x) for _, x, _ in gathered])
            starts = ends - [len(x) for _, x, _ in gathered]
            begun = np.zeros(len(points) + 1, np.int8)  # n-grams begin at a piece's own places
            begun[starts] += 1
            begun[starts + [n for _, _, n in gathered]] -= 1
            own = np.cumsum(begun[:-1], dtype=np.int8).view(bool)
            for k, bucket in gram_buckets(points):
                wanted = np.where(own, np.concatenate([bucket, np.full(k - 1, -1, np.int32)]), -1)
                np.add.at(sums, rows, np.add.reduceat(self.log_probability[wanted], starts, axis=0))
            np.add.at(sizes, rows, np.add.reduceat((own & (points != 32)).astype(np.int64), starts))
            gathered.clear()
            held = 0

        for i, text in enumerate(texts):
            for points, own in pieces(text or ""):
                gathered.append((i, points, own))
                held += len(points)
                if held >= PIECE:
                    work_off()
        work_off()
        for i in np.flatnonzero(sizes):
            best = int((sums[i] + self.prior).argmax())  # the first of equals
            value = sums[i] * min(1.0, 20 / sizes[i]) + self.prior
            weight = np.exp(value - value.max())
            found[i], scores[i] = self.langs[best], float(weight[best] / weight.sum())
        return found, scores


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def rates(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The share of each language's documents that makes about `rows` in all: all of those that have few, and equally many of the others."""
    out, left = {}, rows
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota = min(n, max(1.0, left / (len(counts) - k)))
        out[lang], left = quota / n, left - quota
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS, tasks: int = 8, smoothing: float = 0.5) -> LanguageModel:
    """Count n-grams by language over about `rows` labelled documents that aren't held out.

    docs has doc_id, text and lang. The sample of a language is those whose hash of doc_id falls below its rate; languages with few
    documents keep all. Priors are of all usable documents. Each task returns
    one dense vector of counts for a language, so the driver gets tasks * languages of them.
    """
    chosen = docs.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    some = {lang: rate for lang, rate in rates(usable, rows).items() if rate < 1}
    if some:
        bound = F.create_map(*(F.lit(x) for lang, rate in some.items() for x in (lang, int(np.ceil(rate * (1 << 30))))))
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(bound, F.col("lang")), F.lit(1 << 30)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                counts[lang] = counts.get(lang, 0) + gram_counts(text)
        if counts:
            yield pd.DataFrame({"lang": list(counts), "counts": [x.astype("<i8").tobytes() for x in counts.values()]})

    parts = chosen.select("lang", "text").repartition(tasks).mapInPandas(tidy(count), "lang string, counts binary").collect()
    langs = tuple(sorted({r["lang"] for r in parts}))
    sums = np.zeros((len(langs), WIDTH))
    seen = np.array([usable[x] for x in langs], float)
    for r in parts:
        sums[langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    table = np.zeros((WIDTH + 1, len(langs)))
    for k in range(len(SIZES)):  # each size of n-gram is a multinomial of its own
        part = sums[:, k << BITS : (k + 1) << BITS] + smoothing
        table[k << BITS : (k + 1) << BITS] = np.log(part / part.sum(axis=1, keepdims=True)).T
    return LanguageModel(langs, table, np.log((seen + 1) / (seen.sum() + len(langs))) if langs else np.zeros(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score, and the columns that are carried along.

    The model learns from documents that aren't held out; a prediction sees the text alone. A null text, an empty one
    and one without letters give `und` and 0, and so does every text if nothing is labelled. Ties go to the first language in order.
    A null doc_id counts as an empty string for the split. Repeated rows give equal rows; an empty table gives none.
    The matrix (3 * 32768 buckets by language) is broadcast.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, **{c: c for c in carried})
    model = docs.sparkSession.sparkContext.broadcast(train(docs, train_rows))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            found, scores = model.value.predict([x if isinstance(x, str) else None for x in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": found, "score": scores, **{c: batch[c] for c in carried}})

    narrow = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text", *carried)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return narrow.mapInPandas(tidy(predict), f"doc_id {kind}, held_out boolean, lang_pred string, score double{more}")
