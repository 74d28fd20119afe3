"""Content-addressed WARC archive.

`records` keeps each record's exact header bytes; `payloads` keeps each distinct payload once, under its SHA-256.
Joined, they give the original records byte for byte; every digest is verified when they are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import batches, join_hot_apart, new_path, numbered_copies, stored, utf8

#: The date that records carry where the pages have none; archives of the same pages are then the same.
EPOCH = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs

_PACKED = pa.schema([("sha256", pa.string()), ("packed", pa.binary())])
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()), ("head", pa.binary()), ("sha256", pa.string())])
_VERIFIED = pa.schema([("sha256", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("packed", pa.binary())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record", pa.binary())])


def record_id(page_id: int | None, url: str | None, digest: str, ordinal: int) -> str:
    """Of rows alike in page, url and payload each has its own by the ordinal."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{url}:{digest}:{ordinal}')}>"


def record_head(page_id: int | None, url: str | None, ordinal: int, digest: str, size: int, first: int | None, first_url: str | None, response: bool) -> bytes:
    """WARC header block and HTTP header block of a record, as they stand before the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest, ordinal)}", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, first_url, digest, 1)}"]
        if first is not None:
            lines.append(f"X-Refers-To-Page: {first}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (size if response else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + http


@F.pandas_udf(T.StringType())
def _base32(digests: pd.Series) -> pd.Series:
    return digests.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


@F.pandas_udf(T.BinaryType())
def _heads(rows: pd.DataFrame) -> pd.Series:
    def whole(x: str | None) -> int | None:  # ids come as text: pandas would make numbers with nulls inexact
        return None if x is None else int(x)

    names = ("page_id", "url", "ordinal", "digest", "size", "first_id", "first_url", "response")
    return pd.Series([record_head(whole(p), u, int(o), d, int(s), whole(f), v, bool(r)) for p, u, o, d, s, f, v, r in zip(*(rows[c] for c in names), strict=True)], dtype=object)


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads with their digest, compressed; what repeats inside a partition is dropped before the shuffle."""
    press, seen = zstandard.ZstdCompressor(level=6), set()

    def rows() -> Iterator[tuple]:
        for part in parts:
            for html in part.column(0):
                data = utf8(html.as_py())
                if (digest := hashlib.sha256(data).digest()) not in seen:
                    if len(seen) < 1_000_000:  # what repeats beyond it goes in the shuffle
                        seen.add(digest)
                    yield digest.hex(), press.compress(data)

    yield from batches(rows(), _PACKED)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes path/records and path/payloads.

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of min_bytes or more, the one
    with the smallest id is the response and the others revisit it; of rows that repeat id and payload, one. A null id
    comes after all others. Smaller payloads are all responses. No pages give two empty tables. Other columns are not kept.
    """
    html = F.col(f"`{html_col}`")
    data = F.coalesce(html, F.lit("")).cast("binary")
    keyed = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.sha2(data, 256).alias("sha256"),
        F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("size"),
    )
    # Rows alike in all of this are one with a count, whose copies are numbered when they are written.
    known = stored(keyed.groupBy("page_id", "url", "sha256", "sha1", "size").agg(F.count("*").alias("copies")), "pages")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    firsts = stored(known.groupBy("sha256").agg(F.min(order).alias("first"), F.count("*").alias("n_rows")), "firsts")
    met = join_hot_apart(known, firsts, "sha256", "n_rows")
    records = numbered_copies(met.select("page_id", "url", "sha256", "sha1", "size", "copies", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "copies", "ordinal")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("ordinal") == 1)
    records = records.withColumn("response", (F.col("size") < min_bytes) | is_first).withColumn("digest", _base32("sha1"))
    head = _heads(F.struct(F.col("page_id").cast("string").alias("page_id"), "url", "ordinal", "digest", "size", F.col("first_id").cast("string").alias("first_id"), "first_url", "response"))
    records.select(head.alias("head"), "sha256").write.option("compression", "zstd").parquet(f"{path}/records")
    packed = pages.select(html.alias("html")).mapInArrow(_pack, "sha256 string, packed binary")
    packed.dropDuplicates(["sha256"]).write.option("compression", "none").parquet(f"{path}/payloads")


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields of a record's WARC header block."""
    lines = head.partition(b"\r\n\r\n")[0].decode("utf-8", "surrogatepass").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:])


def _parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for head, sha256 in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                fields = parse_head(head := head.as_py())
                page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                yield page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], first and int(first), fields["WARC-Payload-Digest"].removeprefix("sha1:"), head, sha256

    yield from batches(rows(), _PARSED)


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload's SHA-1 and length; a payload that is not the one of its SHA-256 stops the job."""
    unpack = zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for part in parts:
            for sha256, packed in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                data = unpack.decompress(packed := packed.as_py())
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"a payload does not have its digest {sha256}")
                yield sha256, base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), packed

    yield from batches(rows(), _VERIFIED)


def _rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The record's bytes, from its head and, for a response, its payload."""
    unpack = zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for part in parts:
            for page, url, kind, first, declared, head, digest, size, packed in zip(*(part.column(k) for k in range(9)), strict=True):
                if declared.as_py() != digest.as_py():
                    raise ValueError(f"the payload of {parse_head(head.as_py())['WARC-Record-ID']} does not have its digest")
                body = unpack.decompress(packed.as_py()) if packed.is_valid else b""
                yield page.as_py(), url.as_py(), kind.as_py(), first.as_py(), digest.as_py(), size.as_py(), head.as_py() + body + b"\r\n\r\n"

    yield from batches(rows(), _RECORD)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, record): the records as they were written,
    rebuilt by joins of heads and payloads. Payload figures are of the full payload, for revisits too. A payload that
    does not have its digests stops the job.

    Payloads are verified before they meet their records, so once for all revisits together. Revisits only meet their
    figures; those of the few payloads that very many of them have are broadcast."""
    parsed = spark.read.schema("head binary, sha256 string").parquet(f"{path}/records").mapInArrow(
        _parse, "page_id long, url string, record_type string, refers_to long, declared string, head binary, sha256 string"
    )
    payloads = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads").mapInArrow(_verify, "sha256 string, payload_digest string, payload_bytes long, packed binary")
    names = ["page_id", "url", "record_type", "refers_to", "declared", "head", "payload_digest", "payload_bytes", "packed"]
    responses = parsed.where("record_type = 'response'").join(payloads, "sha256").select(*names)
    again = stored(parsed.where("record_type <> 'response'"), "revisits")
    figures = payloads.select("sha256", "payload_digest", "payload_bytes").join(again.groupBy("sha256").agg(F.count("*").alias("n_revisits")), "sha256")
    revisits = join_hot_apart(again, stored(figures, "figures"), "sha256", "n_revisits").withColumn("packed", F.lit(None).cast("binary")).select(*names)
    return responses.unionByName(revisits).mapInArrow(_rebuild, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, record binary")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to a new archive in the shared folder and reads it back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(pages.sparkSession, path)
