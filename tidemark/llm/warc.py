"""WARC archives: one gzip member for each record, and a sequential reader."""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, tidy, work_folder, written

#: Bytes of payload from which equal ones are stored once.
LEAST_REVISIT = 1000
#: Compressed bytes after which an archive ends.
ARCHIVE_BYTES = 8 << 20
#: Fixed value: without it, equal records would differ from run to run.
DATE = "2024-01-01T00:00:00Z"
_READ = 1 << 16


@dataclasses.dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    def header(self, name: str) -> str | None:
        return self.headers.get(name.lower())


def digest(data: bytes) -> str:
    """The label of a SHA-1 digest as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_record(headers: list[tuple[str, str]], payload: bytes, level: int = 6) -> bytes:
    """A record as one gzip member."""
    for name, value in headers:
        if "\r" in value or "\n" in value:
            raise ValueError(f"line break in {name}")
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(head.encode("utf-8", "surrogatepass")) + press.compress(payload) + press.compress(b"\r\n\r\n") + press.flush()


def read_archive(chunks: Iterable[bytes]) -> Iterator[Record]:
    """The records of an archive whose bytes come in pieces of any size; one record is in memory at a time.

    ValueError if a member, a header, the Content-Length, the end of a record or a block digest is wrong.
    """
    source, left = iter(chunks), b""
    while True:
        while not left:
            left = next(source, None)
            if left is None:
                return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not left:
                left = next(source, None)
                if left is None:
                    raise ValueError("a gzip member ends early")
            try:
                parts.append(inflate.decompress(left))
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from e
            left = inflate.unused_data if inflate.eof else b""
        yield parse_record(b"".join(parts))


def parse_record(data: bytes) -> Record:
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode("utf-8", "surrogatepass").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or len(data) != end + 4 + int(size) + 4 or not data.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length doesn't fit the record")
    record = Record(headers, data[end + 4 : -4])
    if (told := record.header("WARC-Block-Digest")) and told != digest(record.payload):
        raise ValueError("the block doesn't have its digest")
    return record


def page_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, original: int | None, row: int = 0) -> bytes:
    """A response with the payload as its block, or a revisit of `original` with an empty block; the row's number names a page without an id."""
    name = record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}')}>"
    headers = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    headers.append(("WARC-Payload-Digest", payload_digest))
    if original is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(original)), ("WARC-Refers-To-Page", str(original))]
    headers += [("WARC-Page", str(page_id))] if page_id is not None else []
    headers += [("WARC-Payload-Length", str(len(payload)))]
    block = payload if original is None else b""
    headers += [("Content-Type", "text/html; charset=utf-8"), ("WARC-Block-Digest", digest(block))]
    return write_record(headers, block)


def build_archives(pages: DataFrame, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, unnamed: bool = False) -> DataFrame:
    """(archive, content): archives of the pages (page_id, url, html) as binary rows of at most about `archive_bytes`.

    Equal payloads of at least `least` bytes are found by their digest: partial maxima go through the shuffle, and only
    digests that occur twice are joined back, by a join that adaptive execution can split.
    """
    spark, folder = pages.sparkSession, work_folder(pages.sparkSession)
    pages = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.withColumn("sha1", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    shared = keyed.where("sha1 is not null").groupBy("sha1").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("sha1", "original")
    joined = keyed.join(written(shared, folder, "shared"), "sha1", "left")
    joined = joined.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("original"), F.col("original")).alias("original"))
    # ids as strings, since pandas would make floats of numbers among nulls
    joined = (joined if unnamed else joined.where("page_id is not null")).withColumns({c: F.col(c).cast("string") for c in ("page_id", "original")})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held, size, row = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in filter(len, batches):
            for page_id, url, payload, original in zip(*(batch[c] for c in ("page_id", "url", "payload", "original")), strict=True):
                payload = bytes(payload)
                held.append(page_record(None if pd.isna(page_id) else int(page_id), url, payload, digest(payload), None if pd.isna(original) else int(original), (part << 33) + row))
                row += 1
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [f"part-{part:06d}-{seq:05d}.warc.gz"], "content": [b"".join(held)]})
                    seq, held, size = seq + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [f"part-{part:06d}-{seq:05d}.warc.gz"], "content": [b"".join(held)]})

    return written(joined.mapInPandas(tidy(build), "archive string, content binary"), folder, "archives")


_FORM = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(archives: DataFrame) -> DataFrame:
    """What the records of (content) rows say: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's length and digest are taken from the bytes that were read and held against its headers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            rows = []
            for content in batch["content"]:
                view = memoryview(content)
                for record in read_archive(bytes(view[k : k + _READ]) for k in range(0, len(view), _READ)):
                    kind, told, size = record.header("WARC-Type"), record.header("WARC-Payload-Digest"), int(record.header("WARC-Payload-Length"))
                    if kind == "response" and (told != digest(record.payload) or size != len(record.payload)):
                        raise ValueError("the payload doesn't have its digest or length")
                    refers = record.header("WARC-Refers-To-Page")
                    rows.append((None if (page := record.header("WARC-Page")) is None else int(page), size, hex_digest(told), kind, None if refers is None else int(refers), record.header("WARC-Target-URI")))
            if rows:
                columns = zip((c.split()[0] for c in _FORM.split(", ")), zip(*rows, strict=True), strict=True)
                yield pd.DataFrame({c: pd.array(x, "Int64") if c in ("page_id", "refers_to") else list(x) for c, x in columns})

    return archives.mapInPandas(tidy(read), _FORM)


def write_files(archives: DataFrame, folder: str) -> list[str]:
    """Write (archive, content) rows as files below a local folder, one at a time through the driver; returns their paths."""
    import os

    os.makedirs(folder, exist_ok=True)
    paths = []
    for row in archives.toLocalIterator():
        paths.append(os.path.join(folder, row["archive"]))
        with open(paths[-1] + ".new", "wb") as f:
            f.write(row["content"])
        os.replace(paths[-1] + ".new", paths[-1])
    return paths


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, unnamed: bool = False) -> DataFrame:
    """One row for each page, read back from archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Of pages with equal payloads of at least `least` bytes that with the largest page_id is the response, and the others
    revisit it. A null html has an empty payload; a null url has no target; a page without an id is a response
    with a null page_id if `unnamed`, else it is left out. Rows repeated with one page_id and payload are all responses. An empty table gives no rows.
    """
    pages = pick(pages, page_id=id_col, url=url_col, html=html_col)
    return read_archives(build_archives(pages.withColumn("page_id", F.col("page_id").cast("bigint")), least, unnamed=unnamed))
