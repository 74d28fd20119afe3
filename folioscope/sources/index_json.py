"""An index's JSON object, of any size, read by many tasks.

The file is cut at every `]`, so that Spark's reader can split it anywhere. A cut is within a string if the quotes before it are
odd; these are counted for each split first. Each split's pieces are then read in their order, without a shuffle. Only the
first unit of a split and what is left at its end may go on in another split or file: these few pieces are put together, and say which
entry a split begins in. So no task reads a file or an entry as a whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.storage import stored

_KEY = re.compile(r'[\s,{}]*("(?:[^"\\]|\\.)*")\s*:', re.S)
_ESCAPE = re.compile(r"\\.", re.S)
#: A pair without escapes, as most are.
_PLAIN = re.compile(r'[\s,\[]*\[\s*(-?[0-9]+)\s*,\s*"([^"\\]*)"\s*')
_decoded = json.JSONDecoder(strict=False, parse_int=str, parse_float=str).decode
#: step: 0 a split's first unit, 1 what is left at its end, null a pair between. closes: quotes are paired up to the text's end.
#: term: of a pair; at a split's end the last one that began after its first unit. asks: some pairs have the term of a split before.
_FOUND = pa.schema(
    [("book_id", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("step", pa.int32()), ("text", pa.string()), ("closes", pa.bool_()), ("asks", pa.bool_()), ("term", pa.string()), ("place", pa.string()), ("label", pa.string())]
)
_FOUND_SQL = "book_id string, file string, block long, step int, text string, closes boolean, asks boolean, term string, place string, label string"


def _sound(text: object) -> str | None:
    """A value as text; halves of a character that stand alone become a question mark of their own."""
    if text is None or isinstance(text, str):
        return text if text is None or text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return json.dumps(text)


def _unit(text: str) -> tuple[str | None, list[str | None] | None]:
    """The key that begins in a unit, and its pair of place and label, if it has them."""
    if plain := _PLAIN.fullmatch(text):
        return None, list(plain.groups())
    found = _KEY.match(text)
    rest = text[found.end() :] if found else text
    pair = rest.lstrip(" \t\r\n\f\v,[")
    inside = "[" in rest[: len(rest) - len(pair)]
    values = _decoded(f"[{pair}]") if inside and pair else None
    return (_sound(_decoded(found[1])) if found else None), ([_sound(v) for v in [*values, None][:2]] if values else None)


class _Split:
    """The pieces of one split, taken in order. The last one is held back, as it may be a file's end."""

    def __init__(self, book: str, file: str, block: int, odd: bool):
        self.at, self.odd, self.begins = (book, file, block), odd, block == 0 and not odd
        self.held, self.pending, self.headed, self.asks = None, [], False, False
        self.key = self.last_key = None

    def add(self, text: str, rows: list[tuple]) -> None:
        if self.held is not None:
            self._take(self.held)
            if not self.odd:
                self._close(rows)
        self.held = text

    def _take(self, text: str) -> None:
        self.pending.append(text)
        self.odd ^= (_ESCAPE.sub("", text) if "\\" in text else text).count('"') % 2 == 1

    def _close(self, rows: list[tuple]) -> None:
        unit, self.pending = "]".join(self.pending), []
        if not self.headed:
            self.headed = True
            rows.append((*self.at, 0, unit, True, None, None, None, None))
            if self.begins and (found := _KEY.match(unit)):
                self.key = _sound(_decoded(found[1]))
            return
        key, pair = _unit(unit)
        if key is not None:
            self.key = self.last_key = key
        if pair:
            self.asks |= self.key is None
            rows.append((*self.at, None, None, None, None, self.key, *pair))

    def end(self, rows: list[tuple]) -> None:
        self._take(self.held)
        rows.append((*self.at, 1, "]".join(self.pending), not self.odd, self.asks, self.last_key, None, None))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _runs(part: pa.RecordBatch) -> Iterator[tuple[tuple, list[str]]]:
    """((book_id, file, block, odd), texts) of neighbouring pieces of one split."""
    block, file = part.column(2).to_numpy(), part.column(1).dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1).tolist(), len(block)]
    texts = part.column(4).to_pylist()
    for begin, end in zip(cuts, cuts[1:]):
        if begin < end:
            yield tuple(c[begin].as_py() for c in part.columns[:4]), texts[begin:end]


def _read_splits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _FOUND has, of pieces (book_id, file, block, odd, text) in the order of the scan."""
    split = None
    for part in parts:
        rows: list[tuple] = []
        for (book, file, block, odd), texts in _runs(part):
            if split is None or split.at != (book, file, block):
                if split:
                    split.end(rows)
                split = _Split(book, file, block, odd)
            for text in texts:
                split.add(text, rows)
        yield _batch(rows)
    if split:
        rows = []
        split.end(rows)
        yield _batch(rows)


def _read_units(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _FOUND has, with term, place and label, of units (book_id, file, block, step, text)."""
    for part in parts:
        rows = []
        for *at, text in zip(*(c.to_pylist() for c in part.columns)):
            key, pair = _unit(text)
            rows.append((*at, None, None, pair is not None, key, *(pair or (None, None))))
        yield _batch(rows)


def read_index(spark: SparkSession, path: str, book_id: str = "book") -> DataFrame:
    """occ(book_id, term, page_idx, page_label) of an index's JSON object {term: [[place, label], ...]}, or of a folder that
    render.write_json made, with its books. Terms and labels may have any characters; entries without pages give no rows.
    A book's files are read as one text, in the order of their names; each ends outside of strings."""
    raw = spark.read.option("lineSep", "]").text(path)
    own = F.col("book_id").cast("string") if "book_id" in raw.columns else F.lit(book_id)
    pieces = raw.select(own.alias("book_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    bare = F.when(F.col("text").contains("\\"), F.regexp_replace("text", r"(?s)\\.", "")).otherwise(F.col("text"))
    quotes = F.char_length(bare) - F.char_length(F.replace(bare, F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")).withColumn("odd", F.sum("quotes").over(before) % 2 == 1)
    inside = stored(counts.where("odd").select("file", "block", "odd"), "open-splits")  # splits that begin in a string
    marked = pieces.join(F.broadcast(inside), ["file", "block"], "left").select("book_id", "file", "block", F.coalesce("odd", F.lit(False)).alias("odd"), "text")
    found = stored(marked.mapInArrow(_read_splits, _FOUND_SQL), "pairs")

    # What crosses splits, two pieces for each. One that closes ends a unit, unless its file ends there.
    order = Window.partitionBy("book_id").orderBy("file", "block", "step")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = found.where("step is not null").withColumn("file_ends", F.coalesce(F.lead("file").over(order) != F.col("file"), F.lit(True)))
    closed = edges.withColumn("ends", F.col("closes") & ~F.col("file_ends")).withColumn("unit", F.coalesce(F.sum(F.col("ends").cast("long")).over(earlier), F.lit(0)))
    text = F.concat("text", F.when(F.col("ends") | F.col("file_ends"), "").otherwise("]"))
    units = closed.groupBy("book_id", "unit").agg(F.array_sort(F.collect_list(F.struct("file", "block", "step", text.alias("text")))).alias("p"))
    at = F.element_at("p", -1)
    whole = units.select("book_id", at["file"].alias("file"), at["block"].alias("block"), at["step"].alias("step"), F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
    crossing = whole.mapInArrow(_read_units, _FOUND_SQL).select("book_id", "file", "block", (2 * F.col("step")).alias("step"), F.col("asks").alias("paired"), "term", "place", "label")
    between = edges.where("step = 1").select("book_id", "file", "block", F.lit(1).alias("step"), F.lit(False).alias("paired"), "term", *[F.lit(None).cast("string").alias(c) for c in ("place", "label")])
    up_to = Window.partitionBy("book_id").orderBy("file", "block", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = stored(crossing.unionByName(between).withColumn("known", F.last("term", ignorenulls=True).over(up_to)), "crossing")
    asking = edges.where("step = 1 and asks").select("file", "block")
    entered = events.join(asking, ["file", "block"]).where("step <= 1 and (step = 0 or term is null)")
    entered = stored(entered.groupBy("file", "block").agg(F.max_by("known", F.when(F.col("step") == 0, 1).otherwise(0)).alias("entered")), "entered")

    named = found.where("step is null").join(F.broadcast(entered), ["file", "block"], "left").select("book_id", F.coalesce("term", "entered").alias("term"), "place", "label")
    both = named.unionByName(events.where("paired").select("book_id", F.col("known").alias("term"), "place", "label"))
    return both.select("book_id", "term", F.col("place").cast("int").alias("page_idx"), F.col("label").alias("page_label"))
