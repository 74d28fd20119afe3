"""Exact deduplication by Grace hashing.

Records are collapsed per input partition, shuffled by a hash of their content, and each task partitions what it
gets to spill files, recursively, until a bucket fits an open-addressing table that compares complete contents.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, batches, free_name, join_hot_apart, numbered_copies, quoted, stored, utf8

#: Bytes of content that one table holds before it is spilled.
TABLE_BYTES = 48 << 20
#: Spill files per level, and the bits of the hash that choose one.
FAN_OUT, FAN_BITS = 16, 4

Record = tuple[int, bytes, int | None, int, int]  # hash, content, largest id, count, count of rows with that id

_HEADER = struct.Struct("<QqB3xIQQ")  # hash, largest id, has id, length, counts
_COLLAPSED = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("top", pa.int64()), ("n", pa.int64()), ("n_top", pa.int64())])
_GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_top", pa.int64())])
_MEMBERS = pa.schema([("id", pa.int64()), ("digest", pa.binary())])


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by the complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.entries: list[list] = []
        self.held = 0

    def _slot(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == h and entry[1] == content:
                break
            at = (at + 1) & mask
        return at

    def add(self, record: Record) -> None:
        h, content, top, n, n_top = record
        at = self._slot(h, content)
        e = self.slots[at]
        if e >= 0:
            entry = self.entries[e]
            entry[3] += n
            if top == entry[2]:
                entry[4] += n_top
            elif entry[2] is None or (top is not None and top > entry[2]):
                entry[2], entry[4] = top, n_top
            return
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, top, n, n_top])
        self.held += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, entry in enumerate(self.entries):
            at = entry[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while head := f.read(_HEADER.size):
            h, top, has, size, n, n_top = _HEADER.unpack(head)
            yield h, f.read(size), top if has else None, n, n_top


def grace(records: Iterable[Record], table_bytes: int, folder: str, level: int = 0) -> Iterator[Record]:
    """One record per distinct content. Past table_bytes, what the table holds and the rest go to spill files by the
    next bits of the hash, and each file is done in the same way. At the last level, where a bucket's records have one
    hash in common, the table grows instead."""
    table, files = ContentTable(), []
    last = (level + 1) * FAN_BITS > 64

    def spill(record: Record) -> None:
        h, content, top, n, n_top = record
        f = files[(h >> (level * FAN_BITS)) % FAN_OUT]
        f.write(_HEADER.pack(h, top or 0, top is not None, len(content), n, n_top))
        f.write(content)

    for record in records:
        if files:
            spill(record)
            continue
        table.add(record)
        if table.held > table_bytes and not last:
            base = tempfile.mkdtemp(dir=folder)
            files = [open(os.path.join(base, str(i)), "wb") for i in range(FAN_OUT)]  # noqa: SIM115
            for entry in table.entries:
                spill(tuple(entry))
            table = ContentTable()
    yield from map(tuple, table.entries)
    for f in files:
        f.close()
    for f in files:
        yield from grace(_read(f.name), table_bytes, folder, level + 1)
        os.unlink(f.name)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _collapse(table_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per input partition: distinct contents with their largest id and count; a full table is passed on and emptied."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            table = ContentTable()
            for part in parts:
                for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    content = utf8(text.as_py()).lower()
                    table.add((xxhash.xxh3_64_intdigest(content), content, i, 1, 1))
                    if table.held > table_bytes:
                        yield from ((_signed(h), *rest) for h, *rest in table.entries)
                        table = ContentTable()
            yield from ((_signed(h), *rest) for h, *rest in table.entries)

        yield from batches(rows(), _COLLAPSED)

    return run


def _merge(table_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for part in parts:
                for h, *rest in zip(*(part.column(k) for k in range(5)), strict=True):
                    yield h.as_py() % (1 << 64), *(x.as_py() for x in rest)

        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            found = grace(records(), table_bytes, folder)
            yield from batches(((hashlib.sha256(content).digest(), *rest) for _, content, *rest in found), _GROUPS)

    return run


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        digests = [hashlib.sha256(utf8(text.as_py()).lower()).digest() for text in part.column(1)]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(digests, pa.binary())], schema=_MEMBERS)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, digest), one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the group's largest id.
    A null id is smaller than any other, and keep_id is null where a group has no other. Of rows that repeat both the
    id and the text exactly one is kept. An empty table gives no rows; other columns are not read.

    Contents are collapsed before the shuffle, so a text that fills a third of the table crosses it once per input
    partition. The rows themselves are written as (id, digest). Those of the few hot groups meet their group where they
    are, the others by a shuffle. Rows that repeat the kept id are alike in all that is returned, so they are made anew
    from their number, and no group is numbered row by row.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    groups = stored(
        rows.mapInArrow(_collapse(table_bytes), "h long, content binary, top long, n long, n_top long")
        .repartition("h")
        .mapInArrow(_merge(table_bytes), "digest binary, keep_id long, group_size long, n_top long"),
        "groups",
    )
    members = stored(rows.mapInArrow(_digests, "id long, digest binary"), "members")
    is_top = F.col("id").eqNullSafe(F.col("keep_id"))
    met = join_hot_apart(members, groups, "digest", "group_size").where(~is_top | (F.col("n_top") == 1))
    again = numbered_copies(groups.where("n_top > 1").withColumn("id", F.col("keep_id")), "n_top", "number")
    both = met.select("id", "keep_id", "group_size", is_top.alias("kept"), "digest")
    return both.unionByName(again.select("id", "keep_id", "group_size", (F.col("number") == 1).alias("kept"), "digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest id.

    Rows that repeat an id and a text are kept once. Null ids: see exact_groups.
    """
    own, digest, times = (free_name(docs, n) for n in ("kept_id", "digest", "times"))
    tops = exact_groups(docs, id_col, text_col, table_bytes).where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("id").alias(own), F.col("digest").alias(digest)).agg(F.count("*").alias(times))
    content = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("binary"), 256))
    joined = docs.join(tops, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (content == F.col(digest)))
    # Only rows that repeat need another look; they are combined before they are shuffled.
    again = joined.where(F.col(times) > 1).dropDuplicates([own, digest])
    return joined.where(F.col(times) == 1).unionByName(again).select(*quoted(docs.columns))
