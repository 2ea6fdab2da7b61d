"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens that a fixed mask selects; masks ignore some positions, so a substituted token spoils only the
seeds that select it. Seeds of test items and of documents are rows of two tables, which are joined; a document and an item that share a
seed are compared: the item is laid along the document wherever enough tokens meet, and it counts if any run of aligned
tokens is long enough and has enough equal ones.

A table of bits of the items' seeds, of a fixed size, spares the join most seeds of documents that no item has; the join decides. Frequent
seeds are dealt over salts. Equal texts are joined once, by their hash, and each is compared on its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, pick, tidy, work_folder, written
from tidemark.llm.textkernels import PUNCTUATION, mix, word_hashes

#: 1 selects a token, 0 ignores it. Together they hit every run of 13, 15, 20 and 25 tokens with 2, 3, 4 and 5 substitutions,
#: and so every run of at least 13 with 80 % equal ones: a longer one holds one of these, or splits into two of which one has 80 %.
MASKS = ("111111", "1110010111", "11010110011", "110110100011", "1011000110101", "1110111")
#: Least and most size of the table of bits, as a power of two; and rows and MB up to which items' seeds and candidates are broadcast.
BITS, BROADCAST_ROWS, BROADCAST_MB = (16, 24), 300_000, 32
#: Salts over which each seed is dealt; tokens of items that a text is compared with at a time, about.
SALTS, BLOCK_TOKENS = 16, 250_000
#: Least aligned tokens (all, if the item has fewer), and the least share of equal ones among them.
LEAST_OVERLAP, LEAST_EQUAL = 13, 0.8
_GATHER = 1 << 19
#: Aligned tokens that are compared at a time.
_CELLS = 1 << 18
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mask_seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place where the mask fits."""
    n = max(0, len(tokens) - len(mask) + 1)
    total = np.full(n, np.uint64(int("1" + mask, 2)), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += tokens[k : k + n] * _FACTORS[k]
    return mix(total)


def short_masks(n: int, share: float = LEAST_EQUAL) -> list[str]:
    """Masks for items of n tokens, all of which must be aligned: some mask ignores whatever tokens may be substituted."""
    spare = n - int(np.ceil(n * Fraction(share).limit_denominator(1000)))
    groups = n if n <= 7 else spare + 3
    return ["".join("0" if k * groups // n in out else "1" for k in range(n)) for out in itertools.combinations(range(groups), spare)]


def tokens_of(text: str) -> np.ndarray:
    return word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), PUNCTUATION)[0]


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to (item_id, n, tokens); texts without tokens are left out."""
    form = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])
    for batch in batches:
        rows = [(i, tokens) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if len(tokens := tokens_of(text.as_py() or ""))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int32()), pa.array([x.astype("<u8").tobytes() for _, x in rows], pa.binary())], schema=form)


def item_seeds(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, tokens) to the distinct (key, seed); a mask made for short items is for those of its length."""
    form = pa.schema([("key", pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(data, "<u8")
                masks = [*MASKS, *(short_masks(len(tokens), share) if len(tokens) < LEAST_OVERLAP else [])]
                seeds = np.unique(np.concatenate([mask_seeds(tokens, m) for m in masks])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seeds), key)), pa.array(seeds)], schema=form)

    return run


def _places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return seeds & np.uint64((1 << bits) - 1), (seeds >> np.uint64(32)) & np.uint64((1 << bits) - 1)


def bit_table(seeds: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """(bits, table): the two places of every seed are set. The words of 64 bits are put together in Spark; there are at most 2**18."""
    bits = min(BITS[1], max(BITS[0], (64 * rows).bit_length()))
    place = F.explode(F.array(F.col("seed"), F.shiftrightunsigned("seed", 32))).alias("place")
    place = seeds.select(place).select(F.col("place").bitwiseAND(F.lit((1 << bits) - 1)).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits, table.astype("<u8")


def text_seeds(masks: list[str], table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(h, text) to the distinct (h, seed) of seeds whose bits are set."""
    form = pa.schema([("h", pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = table.value
        near = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)

        def found(hashes: list[int], texts: list[bytes]) -> pa.RecordBatch:
            words, start, _ = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8), PUNCTUATION)
            bounds = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in texts)]))
            rows, hits = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for mask in masks:
                seeds = mask_seeds(words, mask)
                first, second = _places(seeds, bits)
                at = np.flatnonzero(near[first])
                at = at[near[second[at]]]
                doc = np.searchsorted(bounds, at, "right") - 1
                inside = at + len(mask) <= bounds[doc + 1]  # a seed lies within one text
                rows.append(doc[inside])
                hits.append(seeds[at[inside]])
            row, seed = np.concatenate(rows), np.concatenate(hits)
            by = np.lexsort((seed, row))
            row, seed = row[by], seed[by]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
            return pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.int64)[row[first]]), pa.array(seed[first].view(np.int64))], schema=form)

        hashes, texts, held = [], [], 0
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data := (text.as_py() or "").encode("utf-8", "surrogatepass"):
                    hashes.append(h)
                    texts.append(data)
                    held += len(data)
                    if held > _GATHER:
                        yield found(hashes, texts)
                        hashes, texts, held = [], [], 0
        if hashes:
            yield found(hashes, texts)

    return run


def scores(share: float) -> tuple[int, int]:
    """What an equal token adds and another takes: a run has the share if its sum isn't negative."""
    exact = Fraction(share).limit_denominator(1000)
    return exact.denominator - exact.numerator, exact.numerator


def best_run(equal: np.ndarray, least: int, share: float = LEAST_EQUAL) -> tuple[int, int, int] | None:
    """(first, past the last, equal ones) of the run of at least so many tokens and that share of equal ones that has most equal ones.

    Of several it is the shortest, of those the first.
    """
    gain, loss = scores(share)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, gain, -loss))])
    equals = np.concatenate([[0], np.cumsum(equal)])
    first = np.arange(len(sums))
    last = np.searchsorted(-np.maximum.accumulate(sums[::-1])[::-1], -sums, "right") - 1  # the last place to which a run from here has the share
    fine = last - first >= max(1, least)
    if not fine.any():
        return None
    first, last = first[fine], last[fine]
    n = equals[last] - equals[first]
    first, last = first[n == n.max()], last[n == n.max()]
    last = np.maximum(first + least, np.searchsorted(equals, equals[last], "left"))
    k = int((last - first).argmin())
    return int(first[k]), int(last[k]), int(n.max())


def overlap(tokens: np.ndarray, item: np.ndarray, diagonal: int, least: int = LEAST_OVERLAP, share: float = LEAST_EQUAL) -> tuple[int, int, int] | None:
    """(first token, past the last, equal ones) of an item laid at a place of a document, if they overlap enough."""
    low, high = max(0, -diagonal), min(len(item), len(tokens) - diagonal)
    if high - low < min(least, len(item)):
        return None
    run = best_run(tokens[low + diagonal : high + diagonal] == item[low:high], min(least, len(item)), share)
    return run and (run[0] + low + diagonal, run[1] + low + diagonal, run[2])


def overlapping(words: np.ndarray, flat: np.ndarray, begin: np.ndarray, at: np.ndarray, size: np.ndarray, need: np.ndarray, share: float) -> np.ndarray:
    """Which laid items overlap enough: `size` tokens, from `begin` of the items' and `at` of the documents' tokens, with a run of `need` or more."""
    gain, loss = scores(share)
    out = np.zeros(len(size), bool)
    order = np.flatnonzero(size >= need)
    order = order[np.argsort(size[order], kind="stable")]
    start = 0
    while start < len(order):
        # sizes ascend, so the last of a chunk is its widest
        stop = min(len(order), start + max(1, _CELLS // int(size[order[start]])))
        stop = start + max(1, min(stop - start, _CELLS // int(size[order[stop - 1]])))
        rows = order[start:stop]
        k = np.arange(int(size[rows].max()))
        inside = k < size[rows, None]
        equal = words[np.minimum(at[rows, None] + k, len(words) - 1)] == flat[np.minimum(begin[rows, None] + k, len(flat) - 1)]
        sums = np.zeros((len(rows), len(k) + 1), np.int64)
        np.cumsum(np.where(equal, gain, -loss), axis=1, out=sums[:, 1:])
        before = np.arange(len(k) + 1) - need[rows, None]
        lowest = np.take_along_axis(np.minimum.accumulate(sums, axis=1), np.maximum(before, 0), axis=1)
        out[rows] = ((before[:, 1:] >= 0) & inside & (sums[:, 1:] >= lowest[:, 1:])).any(axis=1)
        start = stop
    return out


def best_overlap(tokens: np.ndarray, order: np.ndarray, item: np.ndarray, least: int = LEAST_OVERLAP, share: float = LEAST_EQUAL) -> tuple[int, int, int] | None:
    """The best overlap of an item with a text wherever it may be laid: most equal tokens, then the first; None if none is enough.

    order sorts the tokens. Equal tokens are counted by diagonal, one token of the item at a time, so that a token that
    both repeat many times takes time but no memory; only diagonals with enough of them are looked at.
    """
    need, ordered = min(least, len(item)), tokens[order]
    low, high = np.searchsorted(ordered, item, "left"), np.searchsorted(ordered, item, "right")
    met = np.zeros(len(tokens) + len(item), np.int32)
    for j, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        if a < b:
            met[order[a:b] + (len(item) - j)] += 1
    at = np.flatnonzero(met >= int(np.ceil(need * Fraction(share).limit_denominator(1000))))
    diagonals = at - len(item)
    begin = np.maximum(0, -diagonals)
    size = np.minimum(len(item), len(tokens) - diagonals) - begin
    fine = overlapping(tokens, item, begin, diagonals + begin, size, np.full(len(at), need), share)
    left = diagonals[fine][np.argsort(-met[at[fine]], kind="stable")]
    best = None
    while len(left):
        run = overlap(tokens, item, int(left[0]), least, share)
        if run and (best is None or (run[2], -run[0]) > (best[2], -best[0])):
            best = run
        left = left[1:]
        if best:  # what can still be better: more equal tokens, or as many further ahead
            most = met[left + len(item)]
            left = left[(most > best[2]) | ((most == best[2]) & (np.maximum(left, 0) < best[0]))]
    return best


_FORM = "doc_id long, item_id long, first_token long, end_token long, equal_tokens long"


def compare_texts(least: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text, items) to a row for each item that overlaps enough."""
    form = pa.schema([(c.split()[0], pa.int64()) for c in _FORM.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, items in zip(*(batch.column(c) for c in ("id", "text", "items")), strict=True):
                tokens = tokens_of(text.as_py() or "")
                order = np.argsort(tokens, kind="stable")
                for item in items.as_py():
                    if found := best_overlap(tokens, order, np.frombuffer(item["tokens"], "<u8"), least, share):
                        rows.append((doc_id.as_py(), item["item_id"], *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], schema=form)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST_OVERLAP, share: float = LEAST_EQUAL, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and test item that overlap: doc_id, item_id, first_token, end_token, equal_tokens.

    Tokens are runs of ASCII letters, digits and other scripts' characters, A-Z lower-cased. A pair counts if some run of
    at least 13 aligned tokens (the whole item, if shorter) has at least 80 % equal ones; the run with
    most equal tokens is given, of several the first, and there the shortest. Every such pair is found (masks are made for these limits).
    Null and empty texts overlap with nothing; a null doc_id or item_id is carried along; repeated rows give repeated rows; with an empty
    table there are no rows; other columns are ignored. Texts of any length are compared whole.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    docs = pick(docs, id=id_col, text=text_col).where(F.col("text") != "")
    docs = docs.select(F.col("id").cast("bigint").alias("id"), "text", F.xxhash64("text").alias("h"))
    items = pick(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    items = items.mapInArrow(tidy(item_rows), "item_id long, n int, tokens binary").withColumn("key", F.monotonically_increasing_id())
    items = written(items, folder, "items")
    seeds = written(items.select("key", "tokens").mapInArrow(tidy(item_seeds(share)), "key long, seed long"), folder, "item-seeds")
    lengths = sorted(r["n"] for r in items.where(F.col("n") < LEAST_OVERLAP).select("n").distinct().collect())  # 12 at most
    masks = list(dict.fromkeys([*MASKS, *(mask for n in lengths for mask in short_masks(n, share))]))
    rows = seeds.count()
    table = spark.sparkContext.broadcast(bit_table(seeds, rows))
    found = docs.select("h", "text").mapInArrow(tidy(text_seeds(masks, table)), "h long, seed long").distinct()
    if rows <= BROADCAST_ROWS:
        pairs = found.join(F.broadcast(seeds), "seed")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = found.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    pairs = written(pairs.select("h", "key").distinct(), folder, "pairs")

    parts = pairs.join(items.select("key", "n"), "key").groupBy("h").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).alias("parts"))
    dealt = pairs.join(parts, "h").select("h", "key", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")).join(items, "key")
    lists = dealt.groupBy("h", "part").agg(F.collect_list(F.struct("item_id", "tokens")).alias("items"), F.sum(F.octet_length("tokens") + 64).alias("bytes"))
    lists = written(lists, folder, "lists")
    if (lists.agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_MB << 20:
        lists = F.broadcast(lists)
    out = docs.join(lists, "h").select("id", "text", "items").mapInArrow(tidy(compare_texts(least, share)), _FORM)
    discard(spark, folder, "items", "item-seeds", "pairs")
    return out
