"""A positional index of pages in the shared store, and searches that read only the words that they need.

A word is a run without white space, as in the viewer; its posting says where it stands: the number of the word on the page,
the character that it begins at, and the white space on both sides, so that a text can be put together from its postings.
Postings lie in parts by a hash of the word. In a part they are sorted by word, page and place, and Parquet writes their
numbers as differences in small blocks. The dictionary has every spelling once; patterns are tried on it, not on texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import nfkc
from folioscope.operators.search import EDGE, highlight_forms
from folioscope.storage import free_name, new_path, stored

#: Bytes of text for each part of the postings, and the most parts.
PART_BYTES, MOST_PARTS = 64 << 20, 4096
#: Rows of one word that a task writes: a frequent word's postings are dealt over several files of its part.
FILE_ROWS = 2_000_000
#: Spellings up to which a search names them, so that the scan leaves out other parts and row groups; more are joined.
MOST_NAMED = 2000
#: White space that ends a word.
SPACE = r"[ \t\n\x0B\f\r]"
_POSTINGS = "term string, book_id string, page_idx int, at int, start int, before string, after string, part int"


@dataclass(frozen=True)
class PositionalIndex:
    """Stored relations: dictionary(term, n, part), postings(term, book_id, page_idx, at, start, before, after, part) and
    books(book_id)."""

    spark: SparkSession
    path: str

    def dictionary(self) -> DataFrame:
        return self.spark.read.schema("term string, part int, n long").parquet(f"{self.path}/dictionary")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    def books(self) -> DataFrame:
        return self.spark.read.schema("book_id string").parquet(f"{self.path}/books")

    def named(self, wanted: DataFrame) -> DataFrame:
        """Postings of the wanted spellings (term, part), which are distinct."""
        some = wanted.select("term", "part").limit(MOST_NAMED + 1).collect()
        if len(some) > MOST_NAMED:
            return self.postings().join(wanted.select("term", "part"), ["part", "term"])
        parts = sorted({r["part"] for r in some})
        return self.postings().where(F.col("part").isin(parts) & F.col("term").isin([r["term"] for r in some]))


#: Words of a batch that a task hands on.
BATCH_WORDS = 100_000
_WORD = re.compile(r"([^ \t\n\x0b\f\r]+)([ \t\n\x0b\f\r]*)")
_ROWS = pa.schema([("term", pa.string()), ("book_id", pa.string()), ("page_idx", pa.int32()), ("at", pa.int32()), ("start", pa.int32()), ("before", pa.string()), ("after", pa.string())])


def _word_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of pages (book_id, page_idx, text), some BATCH_WORDS at a time."""
    for part in parts:
        page, rows = [], []

        def batch() -> pa.RecordBatch:
            term, at, start, before, after = (pa.array(c, _ROWS.field(n).type) for c, n in zip(zip(*rows), ("term", "at", "start", "before", "after")))
            book_id, page_idx = (part.column(k).take(pa.array(page, pa.int32())) for k in (0, 1))
            return pa.RecordBatch.from_arrays([term, book_id, page_idx, at, start, before, after], schema=_ROWS)  # noqa: B023

        for k, text in enumerate(part.column(2)):
            before = None
            for at, found in enumerate(_WORD.finditer(text.as_py())):
                if before is None:
                    before = found.string[: found.start()]
                term, after = found.groups()
                rows.append((term, at, found.start(), before, after))
                page.append(k)
                before = after
                if len(rows) >= BATCH_WORDS:
                    yield batch()
                    page, rows = [], []
        if rows:
            yield batch()


def word_postings(pages: DataFrame) -> DataFrame:
    """(term, book_id, page_idx, at, start, before, after) of pages(book_id, page_idx, text); places are in code points."""
    own = pages.select(F.col("book_id").cast("string"), F.col("page_idx").cast("int"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_word_rows, _POSTINGS.removesuffix(", part int"))


def build_index(pages: DataFrame, path: str | None = None, normal: bool = False, part_bytes: int = PART_BYTES) -> PositionalIndex:
    """Writes the index of pages(book_id, page_idx, text) to a new folder. normal: of the texts' NFKC forms.

    Texts are cut into words once, and the postings are stored as they come. One shuffle of them then, by word; a word's postings
    beyond FILE_ROWS or so go to several tasks. Null texts have no words.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "positions")
    own = pages.withColumn("text", nfkc(F.col("text"))) if normal else pages
    size = pages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, min(MOST_PARTS, -(-size // part_bytes)))
    postings = stored(word_postings(own).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(n_parts)).cast("int")), "words")
    counts = postings.groupBy("term", "part").agg(F.count("*").alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "term").write.parquet(f"{path}/dictionary")
    # Frequent words only; there are fewer than all postings / FILE_ROWS of them.
    frequent = {r["term"]: r["n"] for r in spark.read.parquet(f"{path}/dictionary").where(F.col("n") > FILE_ROWS).select("term", "n").collect()}
    files = F.lit(0)
    if frequent:
        table = spark.createDataFrame([(t, -(-n // FILE_ROWS)) for t, n in frequent.items()], "term string, files long")
        postings = postings.join(F.broadcast(table), "term", "left")
        files = F.pmod(F.xxhash64("book_id", F.expr("page_idx div 64")), F.coalesce("files", F.lit(1)))
    deal = free_name(postings, "deal")
    ordered = postings.withColumn(deal, files).repartition("part", deal).drop(deal, "files").sortWithinPartitions("part", "term", "book_id", "page_idx", "at")
    ordered.write.partitionBy("part").option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(f"{path}/postings")
    pages.select("book_id").distinct().write.parquet(f"{path}/books")
    return PositionalIndex(spark, path)


@dataclass(frozen=True)
class Phrase:
    """A phrase's words, and the white space before, between and after them."""

    words: list[str]
    spaces: list[str]

    @classmethod
    def of(cls, phrase: str) -> Phrase:
        words = re.findall(r"[^ \t\n\x0b\f\r]+", phrase)
        if not words:
            raise ValueError("a phrase has a character other than white space")
        return cls(words, re.split(r"[^ \t\n\x0b\f\r]+", phrase))

    def pattern(self, k: int) -> str:
        """Of spellings that can be the k-th word: a phrase may begin and end within a word."""
        word = "(?iu)\\Q" + self.words[k].replace("\\E", "\\E\\\\E\\Q") + "\\E"
        from_start, to_end = k > 0 or self.spaces[0], k < len(self.words) - 1 or self.spaces[-1]
        return ("(?s)^" if from_start else "(?s)") + word + ("$" if to_end else "")


def _offsets(term: Column, phrase: Phrase) -> Column:
    """Places in a word at which the first word of a phrase begins, overlapping ones too."""
    length, wanted = F.char_length(term), len(phrase.words[0])
    if phrase.spaces[0]:
        return F.array(F.lit(0))
    if len(phrase.words) > 1 or phrase.spaces[-1]:
        return F.array(length - wanted)
    found = phrase.pattern(0).replace("(?s)", "(?s)^", 1)
    return F.filter(F.sequence(F.lit(0), length - wanted), lambda i: F.substr(term, i + 1, F.lit(wanted)).rlike(found))


def phrase_search(index: PositionalIndex, phrase: str) -> DataFrame:
    """(book_id, page_idx, match_ord, start): as search.phrase_search has them, from the index.

    Spellings that fit the phrase's words are found in the dictionary, and their postings meet where they stand side by side. A
    phrase of white space only raises ValueError."""
    wanted = Phrase.of(phrase)
    known = index.dictionary()
    places = ["book_id", "page_idx", "at"]

    def side(k: int) -> DataFrame:
        found = index.named(known.where(F.col("term").rlike(wanted.pattern(k))))
        after = F.col("after").startswith(wanted.spaces[-1]) if k == len(wanted.words) - 1 else F.col("after") == wanted.spaces[k + 1]
        fits = found.where(after)
        if k:
            return fits.select("book_id", "page_idx", (F.col("at") - k).alias("at"))
        return fits.where(F.col("before").endswith(wanted.spaces[0])).select(*places, "start", "term")

    met = reduce(lambda a, b: a.join(b, places), [side(k) for k in range(len(wanted.words))])
    starts = met.select("book_id", "page_idx", "start", F.explode(_offsets(F.col("term"), wanted)).alias("offset"))
    at = F.col("start") + F.col("offset") - len(wanted.spaces[0])
    grouped = starts.groupBy("book_id", "page_idx").agg(F.array_sort(F.collect_list(at.cast("int"))).alias("all"))
    return grouped.select("book_id", "page_idx", F.posexplode(_apart(F.col("all"), len(phrase))).alias("match_ord", "start"))


def _apart(starts: Column, length: int) -> Column:
    """Of sorted starts, each that begins after the last one kept has ended."""
    near = F.exists(F.zip_with(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: b - a < length), lambda x: x)
    none = F.array().cast("array<int>")

    def add(kept: Column, start: Column) -> Column:
        return F.when((F.size(kept) == 0) | (start >= F.element_at(kept, -1) + length), F.concat(kept, F.array(start))).otherwise(kept)

    return F.when(near, F.aggregate(starts, none, add)).otherwise(starts)


def phrase_count(index: PositionalIndex, phrase: str) -> DataFrame:
    """(book_id, matches): a row for each book, from the index."""
    found = phrase_search(index, phrase).groupBy("book_id").agg(F.count("*").alias("matches"))
    return index.books().join(found, "book_id", "left").select("book_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def highlights(index: PositionalIndex, terms: DataFrame) -> DataFrame:
    """(book_id, page_idx, at, term): as search.highlights has them, from an index of NFKC forms.

    A term is found where the postings of all its words lie at consecutive places."""
    forms = stored(highlight_forms(terms).withColumn("form", F.monotonically_increasing_id()), "forms")
    words = forms.select("form", "ord", "term", "n", F.posexplode(F.arrays_zip(F.col("words").alias("key"), F.col("caps").alias("caps"))).alias("i", "w")).select("form", "ord", "term", "n", "i", "w.key", "w.caps")
    key = F.lower(F.btrim("term", F.lit(EDGE)))
    spellings = index.dictionary().withColumn("key", key).join(words.select("key").distinct(), "key", "left_semi")
    has_caps = F.btrim("term", F.lit(EDGE)).rlike(r"^\p{Lu}")
    found = index.named(spellings).select("book_id", "page_idx", F.col("at").alias("place"), key.alias("key"), has_caps.alias("has"))
    met = found.join(words, "key").where(~F.col("caps") | F.col("has"))
    whole = met.groupBy("book_id", "page_idx", "form", (F.col("place") - F.col("i")).alias("first")).agg(F.count("*").alias("got"), F.first("n").alias("n"), F.first("ord").alias("ord"), F.first("term").alias("term"))
    hit = whole.where(F.col("got") == F.col("n")).where(F.col("first") >= 0)
    each = hit.select("book_id", "page_idx", "ord", "term", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
    return each.groupBy("book_id", "page_idx", "at").agg(F.max_by("term", "ord").alias("term"))
