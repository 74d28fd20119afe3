"""What the operators of this subpackage share: text normalisation, record batches, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.graph import components
from folioscope.storage import checkpointed, free_name, new_path, quoted, shared_dir, stored

__all__ = ["alnum_words", "ascii_lower", "batches", "checkpointed", "components", "free_name", "join_hot_apart", "new_path", "numbered_copies", "quoted", "shared_dir", "space_words", "stored", "utf8"]

#: A key with more than one in so many of all rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Words of the alphanumeric kind, on text whose A-Z are lower-cased: runs without ASCII other than 0-9 and a-z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Maps every byte that cannot be in such a word to a space.
SEPARATORS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits into words of WORD_PATTERN."""
    return utf8(text).lower().translate(SEPARATORS).split()


def space_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at the six ASCII white-space characters."""
    return utf8(text).lower().split()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; `lower` alone would change other letters."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def batches(rows: Iterator[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded rows and bytes from an iterator of tuples."""
    kept: list[tuple] = []
    held = 0
    for row in rows:
        kept.append(row)
        held += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(kept) >= max_rows or held >= max_bytes:
            yield _batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def join_hot_apart(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with table, which has one row for each key and in `count` how many rows the key has.

    Both are read twice, so they are stored tables. Keys with more than one in HOT_KEYS of all rows are broadcast, as there
    are fewer than HOT_KEYS of them; their rows stay where they are. The others are shuffled. Rows without a key are left out.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total / HOT_KEYS
    hot = table.where(is_hot)
    if hot.isEmpty():
        return rows.join(table, key)
    apart = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~is_hot), key)
    return apart.unionByName(rest)


def numbered_copies(rows: DataFrame, count: str, number: str, chunk: int = 10_000) -> DataFrame:
    """Each row as often as `count` says, numbered from 1; rows of very many copies are dealt out to several tasks."""
    own = free_name(rows, "chunk")
    one = rows.where(F.col(count) == 1).withColumn(number, F.lit(1).cast("long"))
    parts = rows.where(F.col(count) > 1).withColumn(own, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{count}` - 1) div {chunk}"))))
    first = F.col(own) * chunk + 1
    many = parts.repartition(own).withColumn(number, F.explode(F.sequence(first, F.least(first + (chunk - 1), F.col(count).cast("long"))))).drop(own)
    return one.unionByName(many)
