"""Texts as PNG images in a binary column, and cosine-transform hashes of the images."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import pick, tidy, work_folder, written

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 20
#: Lines of an image that are filtered at a time.
LINES = 4096


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered_lines(samples: np.ndarray, filters: int | None = None) -> np.ndarray:
    """(height, 1 + width) lines: 0 as they are, 1 less the sample to the left, 2 less the one above.

    Without a wish each line gets the filter with the least sum of absolute differences, as the format advises; of equals the first.
    """
    height, width = samples.shape
    lines = np.empty((height, width + 1), np.uint8)
    for at in range(0, height, LINES):
        part = samples[at : at + LINES]
        ways = np.zeros((3, len(part), width), np.uint8)
        ways[:] = part
        ways[1, :, 1:] -= part[:, :-1]
        ways[2, 1:] -= part[:-1]
        if at:
            ways[2, 0] -= samples[at - 1]
        kinds = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0) if filters is None else np.full(len(part), filters)
        lines[at : at + len(part), 0] = kinds
        lines[at : at + len(part), 1:] = ways[kinds, np.arange(len(part))]
    return lines


def write_png(samples: np.ndarray, level: int = 6, filters: int | None = 0) -> bytes:
    """An 8-bit grey PNG of a (height, width) array; filters: 0 for none, 1 for left, 2 for up, on all lines; None chooses by line."""
    height, width = samples.shape
    lines = filtered_lines(samples, filters)
    press, parts = zlib.compressobj(level), [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    flat = memoryview(lines.reshape(-1))
    for at in range(0, len(flat), CHUNK):
        if data := press.compress(flat[at : at + CHUNK]):
            parts.append(chunk(b"IDAT", data))
    parts += [chunk(b"IDAT", press.flush()), chunk(b"IEND", b"")]
    return b"".join(parts)


def _predicted(kinds: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each line's filter foretells from the samples to the left, above, and above to the left."""
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    paeth = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
    return np.choose(kinds, (np.zeros_like(a), a, b, (a + b) >> 1, paeth))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """The samples of (height, 1 + width) filtered lines of one byte a pixel.

    Lines of the first three filters are sums along a line or down a run of lines. With the others, a sample needs its neighbours to the left
    and above, so that all samples of an antidiagonal are found at once.
    """
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown line filter")
    if not kinds.any():
        return out
    if kinds.max() <= 2:
        left = kinds == 1
        out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], kinds == 2, [0]]).astype(np.int8)))
        for first, last in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            before = max(0, first - 1)
            out[before:last] = np.cumsum(out[before:last], axis=0, dtype=np.uint8)
        return out
    height, width = out.shape
    known = np.zeros((height + 1, width + 1), np.int16)  # with a line above and a column to the left
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        known[y + 1, x + 1] = (out[y, x] + _predicted(kinds[y], known[y + 1, x], known[y, x + 1], known[y, x])) & 255
    return known[1:, 1:].astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG; ValueError if a checksum, a length or the header is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("bytes outside chunks")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], at + 12 + size
        if end > len(data) or struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(data[at + 4 : end - 4]):
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at = end
    if header is None or not ended:
        raise ValueError("the header or the end is missing")
    width, height, *form = header
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit grey images without interlace are read")
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


_GRID = 32
_COSINES = np.cos(np.pi / _GRID * np.outer(np.arange(8), np.arange(_GRID) + 0.5))


def _averages(samples: np.ndarray, axis: int) -> np.ndarray:
    """32 means along an axis; where it is shorter, samples repeat."""
    size = samples.shape[axis]
    edges = np.arange(_GRID) * size // _GRID
    if size < _GRID:
        return np.take(samples, edges, axis=axis).astype(float)
    return np.add.reduceat(samples, edges, axis=axis, dtype=float) / np.expand_dims(np.diff(edges, append=size), 1 - axis)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine frequencies lie above the median of all but the mean."""
    low = (_COSINES @ _averages(_averages(samples, 0), 1) @ _COSINES.T).reshape(-1)
    low[np.abs(low) < 1e-6] = 0
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_samples(text: str) -> tuple[np.ndarray, int]:
    """UTF-8, padded with spaces to a positive multiple of 192, as lines of 192 samples; and the unpadded length."""
    data = text.encode("utf-8", "surrogatepass")
    padded = np.full(max(1, -(-len(data) // WIDTH)) * WIDTH, 32, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(-1, WIDTH), len(data)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the column `media` with a PNG of each text; null counts as empty."""
    docs = pick(docs, doc_id=id_col, text=text_col)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            images = [to_samples(x if isinstance(x, str) else "") for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [n for _, n in images], "media": [write_png(x, filters=None) for x, _ in images]})

    return docs.mapInPandas(tidy(store), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold: digests of the samples that were read back, and the cosine hash."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            rows = []
            for data in batch["media"]:
                samples = read_png(bytes(data))
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            yield pd.concat([batch[["doc_id", "n_bytes"]].reset_index(drop=True), pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])], axis=1)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInPandas(tidy(read), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a PNG in a table of the shared folder, then read that table back for its features.

    A null or empty text is one line of 192 spaces. Equal texts give equal bytes and features; repeated rows give
    repeated rows; an empty table gives none; other columns are ignored. One text at a time is in memory besides its batch, whole
    however long. Each line of an image has the filter that suits it best.
    """
    spark: SparkSession = docs.sparkSession
    return media_features(written(store_texts(docs, id_col, text_col), work_folder(spark), "media"))
