"""BPE encoding and decoding through a table of distinct words.

Documents are split into words in blocks of a bounded size. A block keeps each document as places in its own list of
distinct words, and deals that list out by a hash of the word. So each distinct word of the whole table meets all its blocks in
one task, is encoded there once, and its ids go back to the blocks, where they are joined by place. Texts are never
shuffled. A task holds the words of one block; its documents pass one at a time, become ids, and are decoded from those.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, tidy, work_folder, written

#: Characters of text after which a block ends; a longer text is a block of its own.
BLOCK_CHARS = 32_000_000
#: bucket of a row: a document's places, a block's list of buckets by place, or (from 0) words dealt to that bucket.
DOCUMENT, ORDER = -1, -2
#: Words as the tokenizer file's pattern splits lower-cased text, for characters below U+0100, where its classes are these.
_SPACE, _DIGIT, _LETTER = "\\t-\\r \\x85\\xa0", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff"
_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_DIGIT}{_LETTER}]+")


def byte_alphabet() -> str:
    """The characters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(i if i in plain else next(others)) for i in range(256))


_ALPHABET = byte_alphabet()
_BYTES = {ord(c): i for i, c in enumerate(_ALPHABET)}


class WordSplitter:
    """Splits texts as a tokenizer file does; of the file it keeps all but the vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = told["added_tokens"]
        self.tokenizer = Tokenizer.from_str(json.dumps(told | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.special = {x["content"]: x["id"] for x in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.order = list(self.special)

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = self.tokenizer.normalizer.normalize_str(text)
            return [w.translate(_BYTES).encode("latin-1").decode("utf-8") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return _LATIN_WORDS.findall(text.lower())

    def places(self, text: str, known: "Places") -> np.ndarray:
        """Each word's place in `known`; special tokens have the first places."""
        if self.cut is None or not any(x in text for x in self.order):
            words = self.words(text)
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        parts = [[self.order.index(x)] if k % 2 else [known[w] for w in self.words(x)] for k, x in enumerate(self.cut.split(text))]
        return np.array([x for part in parts for x in part], np.int32)



class WordCoder:
    """Encodes words as a tokenizer file does, and knows its pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, word: str) -> list[int]:
        data = word.encode("utf-8").decode("latin-1").translate({i: c for i, c in enumerate(_ALPHABET)})
        return [t.id for t in self.tokenizer.model.tokenize(data)]

    def pieces(self) -> list[str]:
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        return [self.tokenizer.id_to_token(i) or "" for i in range(size)]


@functools.lru_cache(maxsize=2)
def splitter(path: str) -> WordSplitter:
    return WordSplitter(path)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


class Places(dict):
    """Places in the order of first use, from `first` on."""

    def __init__(self, first: int):
        self.first = first

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self) + self.first
        return place


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_places(places: np.ndarray) -> bytes:
    """Little-endian numbers as planes: all lowest bytes first."""
    return pack(np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


#: Numbers below the first take one byte, the next MEDIUM * 256 two and the rest three; places are numbered by falling frequency.
_SHORT, _MEDIUM = 128, 112
_TWO, _THREE = _SHORT + _MEDIUM * 256, _SHORT + _MEDIUM * 256 + (256 - _SHORT - _MEDIUM) * 65536


def pack_ranks(places: np.ndarray) -> bytes:
    """Numbers of which most are small: all first bytes, then the second ones of those that have two, then the two more of the rest."""
    if len(places) and places.max() >= _THREE:
        return b"\0" + pack_places(places)
    two, three = (places >= _SHORT) & (places < _TWO), places >= _TWO
    first = np.where(three, _SHORT + _MEDIUM + ((places - _TWO) >> 16), np.where(two, _SHORT + ((places - _SHORT) >> 8), places)).astype(np.uint8)
    middle, long = places[two] - _SHORT, places[three] - _TWO
    parts = (np.array([len(places)], "<i8"), first, (middle & 255).astype(np.uint8), (long & 255).astype(np.uint8), (long >> 8 & 255).astype(np.uint8))
    return b"\1" + pack(b"".join(x.tobytes() for x in parts))


def unpack_ranks(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return unpack_places(data[1:])
    raw = unpack(data[1:])
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    values = np.frombuffer(raw, np.uint8, offset=8).astype(np.int32)
    out = values[:n].copy()
    two, three = np.flatnonzero((out >= _SHORT) & (out < _SHORT + _MEDIUM)), np.flatnonzero(out >= _SHORT + _MEDIUM)
    a, b = n + len(two), n + len(two) + len(three)
    out[two] = ((out[two] - _SHORT) << 8) + values[n:a] + _SHORT
    out[three] = ((out[three] - _SHORT - _MEDIUM) << 16) + values[a:b] + (values[b:] << 8) + _TWO
    return out


_LINK = "block long, bucket int, doc_id {kind}, data binary"


def split_blocks(path: str, buckets: int, block_chars: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to the rows of their blocks."""
    form = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", id_type), ("data", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = splitter(path), TaskContext.get().partitionId(), 0
        known, ids, streams, chars = Places(len(own.special)), [], [], 0

        def close() -> pa.RecordBatch:
            block = (part << 32) + seq
            words, fixed = list(known), len(own.special)
            uses = np.zeros(fixed + len(words), np.int64)
            for x in streams:
                np.add.at(uses, x, 1)
            by = np.argsort(-uses[fixed:], kind="stable")
            words, rank = [words[i] for i in by], np.arange(len(uses), dtype=np.int32)
            rank[by + fixed] = np.arange(fixed, len(uses))
            rows = [(DOCUMENT, i, pack_ranks(rank[x])) for i, x in zip(ids, streams, strict=True)]
            if words:
                # a bucket by the hash of the word's bytes
                bucket = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") for w in words), np.int64, len(words)) % buckets
                rows.append((ORDER, None, pack(bucket.astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes())))
                by = np.argsort(bucket, kind="stable")
                for x in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                    rows.append((int(bucket[x[0]]), None, pack("\n".join([words[i] for i in x]).encode())))
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.binary())], schema=form)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if ids and chars + len(text) > block_chars:
                    yield close()
                    known, ids, streams, chars, seq = Places(len(own.special)), [], [], 0, seq + 1
                ids.append(doc_id)
                streams.append(own.places(text, known))
                chars += len(text)
        if ids:
            yield close()

    return split


def encode_words(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of words to rows of their ids: for each word how many, then all ids. A word that several blocks have is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = coder(path), {}
        for batch in batches:
            out = []
            for data in batch.column("data"):
                counts, ids = [], []
                for word in unpack(data.as_py()).decode().split("\n"):
                    if (found := done.get(word)) is None:
                        found = done[word] = np.array(own.encode(word), "<i4").tobytes()
                    counts.append(len(found) >> 2)
                    ids.append(found)
                flat = np.frombuffer(b"".join(ids), "<i4")
                out.append(pack_places(np.concatenate([np.array([len(counts), *counts], "<i4"), flat])))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), batch.column("doc_id"), pa.array(out, pa.binary())], schema=batch.schema)

    return encode


def block_tokens(parts: dict[int, bytes], special: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all places one after another, where each place's ids begin) from a block's list of buckets and its words' ids by bucket."""
    order = unpack(parts[ORDER]) if ORDER in parts else b""
    found = {b: unpack_places(data) for b, data in parts.items() if b >= 0}
    size = sum(int(x[0]) for x in found.values())
    order = np.frombuffer(order, "<u2" if len(order) == 2 * size else "<u4")
    counts = np.ones(len(special) + size, np.int64)
    for b, x in found.items():
        counts[np.flatnonzero(order == b) + len(special)] = x[1 : 1 + x[0]]
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(starts[-1], np.int32)
    flat[: len(special)] = special
    for b, x in found.items():
        at = np.flatnonzero(order == b) + len(special)
        n = counts[at]
        flat[np.repeat(starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] = x[1 + x[0] :]
    return flat, starts


def ids_at(places: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of a document from the places of its words."""
    n = starts[places + 1] - starts[places]
    before = np.cumsum(n) - n
    return flat[np.repeat(starts[places] - before, n) + np.arange(n.sum())]


def encoded_blocks(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of all blocks: block, bucket, doc_id, data; words have become ids."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    docs = pick(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    form = _LINK.format(kind=kind)
    blocks = written(docs.mapInArrow(tidy(split_blocks(path, buckets, block_chars, id_type)), form), folder, "blocks")
    dealt = blocks.where("bucket >= 0").repartition(buckets, "bucket")
    return blocks.where("bucket < 0").unionByName(dealt.mapInArrow(tidy(encode_words(path)), form))


def encode_documents(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids as array<int>.

    The ids are those of the tokenizers library without added special tokens; special tokens in a text are found before
    anything is normalised. The decoded text is the ids' pieces with a space between, as the library joins them for
    files without a decoder. A null or empty text has no tokens. Texts of any length are taken whole, a long one as a block of its
    own. Repeated rows give repeated rows, an empty table gives none; other columns are ignored.
    """
    special = list(splitter(path).special.values())
    pieces = docs.sparkSession.sparkContext.broadcast(coder(path).pieces())  # one for each id of the file
    rows = encoded_blocks(docs, path, block_chars, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        number = [str(i) for i in range(len(table))]
        block, parts, known = None, {}, None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for now, bucket, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "doc_id", "data")), strict=True):
                if now != block:
                    block, parts, known = now, {}, None
                if bucket != DOCUMENT:
                    parts[bucket] = data
                    continue
                if known is None:
                    known, parts = block_tokens(parts, special), {}
                own = ids_at(unpack_ranks(data), *known)
                listed = own.tolist()
                values = (doc_id, len(own), hashlib.sha256(" ".join(map(number.__getitem__, listed)).encode()).hexdigest(), hashlib.sha256(" ".join(map(table.__getitem__, listed)).encode()).hexdigest(), own)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=False)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(kinds)])

    # a block's words come before its documents, which then pass one by one
    return rows.repartition("block").sortWithinPartitions("block", F.col("bucket") == DOCUMENT).mapInArrow(tidy(join), form)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `decoded`: ids joined by position with the table of pieces. Null ids give null.

    The table has a row for each id of the file, so its size is fixed and it is broadcast. Each row's ids are looked up in place of an exploded join.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(coder(path).pieces())
    names = [*keep, "ids"]
    rows = pick(encoded, **{k: k for k in keep}, ids=ids_col)
    form = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep) + ", decoded string"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            batch["decoded"] = [None if x is None else " ".join([pieces.value[i] for i in x]) for x in batch["ids"]]
            yield batch[[*names[:-1], "decoded"]]

    return rows.mapInPandas(tidy(decode), form)
