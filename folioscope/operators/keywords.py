"""Keyword index: which pages have a keyword as whole words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.config import IndexConfig
from folioscope.functions.text import keyword_pattern, nfkc, nfkc_text, stripped
from folioscope.sources.tables import labelled_pages
from folioscope.storage import stored

#: Patterns that are tried in one projection; longer lists are matched in several.
PATTERNS = 200


def normalised(keywords: list[str]) -> list[tuple[str, str]]:
    """(spelling, NFKC form) of the keywords that are not blank: of one form the last spelling, in the first's place."""
    kept: dict[str, str] = {}
    for raw in keywords:
        if raw.strip():
            kept[nfkc_text(raw.strip())] = raw.strip()
    return [(spelling, form) for form, spelling in kept.items()]


def keyword_hits(pages: DataFrame, keywords: list[str], config: IndexConfig | None = None) -> DataFrame:
    """occ(book_id, term, page_idx, page_label, ord): each keyword once for each page that has it. No shuffle."""
    config = config or IndexConfig()
    own = labelled_pages(pages, config).withColumn("text", nfkc(F.coalesce("text", F.lit("")))).withColumn("low", F.translate(F.lower("text"), "ı", "i"))
    names = normalised(keywords)

    def has(form: str) -> Column:
        found = F.col("text").rlike(keyword_pattern(form))
        # A dotless i is the only letter that matches one of ASCII and does not become it in lower case.
        return F.col("low").contains(form.lower()) & found if form.isascii() else found

    def some(begin: int) -> DataFrame:
        found = [F.when(has(form), F.struct(F.lit(begin + k).alias("ord"), F.lit(spelling).alias("term"))) for k, (spelling, form) in enumerate(names[begin : begin + PATTERNS])]
        hits = own.select("book_id", "page_idx", "page_label", F.explode(F.array_compact(F.array(*found))).alias("hit"))
        return hits.select("book_id", F.col("hit.term").alias("term"), "page_idx", "page_label", F.col("hit.ord").alias("ord"))

    if not names:
        return own.select("book_id", F.lit("").alias("term"), "page_idx", "page_label", F.lit(0).alias("ord")).where(F.lit(False))
    return reduce(DataFrame.unionByName, [some(b) for b in range(0, len(names), PATTERNS)])


#: Keywords that are matched in one pass over the pages: their table is sent to every task. Of more, single words are joined to
#: the pages' words, and the others are matched in several passes.
MOST_LISTED = 500_000
_RUNS = re.compile(r"\w+|\W+")
_LISTED = pa.schema([("book_id", pa.string()), ("page_idx", pa.int32()), ("page_label", pa.string()), ("ords", pa.list_(pa.int64()))])


class _Folds(dict):
    """Each character in lower case of its upper case, where these are one character: what a pattern without case compares."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        upper = char.upper() if len(char.upper()) == 1 else char
        self[code] = found = "i" if upper == "İ" else upper.lower()
        return found


_FOLDS = _Folds()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def is_word(run: str) -> bool:
    return run[0].isalnum() or run[0] == "_"


def _listed(table: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(book_id, page_idx, page_label, ords) of pages with the numbers of the keywords on them; table: (ord, NFKC form).

    A keyword stands as whole words where its runs of word characters and of others are whole runs of the page: it begins and
    ends where the kind of character changes. So pages and keywords meet by their first run and number of runs; one that
    begins with another character than a word's needs a word before it, and likewise at its end."""
    words: dict[str, list[int]] = {}
    longer: dict[str, dict[int, dict[str, list[int]]]] = {}
    for number, form in table:
        runs = _RUNS.findall(folded(form))
        if len(runs) == 1 and is_word(runs[0]):
            words.setdefault(runs[0], []).append(number)
        else:
            longer.setdefault(runs[0], {}).setdefault(len(runs), {}).setdefault("".join(runs), []).append(number)

    def on_page(text: str) -> list[int]:
        runs = _RUNS.findall(folded(text))
        found = {n for run in words.keys() & set(runs) for n in words[run]}
        for at, first in enumerate(runs):
            for size, forms in longer.get(first, {}).items():
                own = runs[at : at + size]
                if len(own) == size and (numbers := forms.get("".join(own))) and (at or is_word(first)) and (at + size < len(runs) or is_word(own[-1])):
                    found.update(numbers)
        return sorted(found)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ords = [on_page(text.as_py()) for text in part.column(3)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ords, _LISTED.field(3).type)], schema=_LISTED)

    return run


_PAGE_WORDS = pa.schema([*[_LISTED.field(k) for k in range(3)], ("words", pa.list_(pa.string()))])
_KEYED = pa.schema([("ord", pa.int64()), ("term", pa.string()), ("form", pa.string()), ("key", pa.string())])


def _page_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(book_id, page_idx, page_label, words): a page's words, each once."""
    for part in parts:
        words = [[run for run in set(_RUNS.findall(folded(text.as_py()))) if is_word(run)] for text in part.column(3)]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(words, _PAGE_WORDS.field(3).type)], schema=_PAGE_WORDS)


def _keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, term, form, key): key is what a page's word must be for a keyword of one word; others have none."""
    for part in parts:
        runs = [_RUNS.findall(folded(form.as_py())) for form in part.column(2)]
        keys = [r[0] if len(r) == 1 and is_word(r[0]) else None for r in runs]
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.string())], schema=_KEYED)


def keyword_list_hits(pages: DataFrame, words: DataFrame, config: IndexConfig | None = None, most: int = MOST_LISTED) -> DataFrame:
    """occ(book_id, term, page_idx, page_label, ord), as keyword_hits has it, of a long list: words(ord, word), distinct ords.

    Up to `most` keywords take one pass over the pages and no shuffle of them. Of more, those of one word are joined to the pages'
    words, however many they are, and each `most` of the others take a pass. Blank keywords are left out; of one NFKC form the
    last spelling counts, in the first's place."""
    config = config or IndexConfig()
    text = nfkc(F.coalesce("text", F.lit("")))
    own = labelled_pages(pages, config).select(F.col("book_id").cast("string"), F.col("page_idx").cast("int"), "page_label", text.alias("text"))
    trimmed = words.select("ord", stripped(F.col("word")).alias("word")).where(F.length("word") > 0)
    names = trimmed.groupBy(nfkc(F.col("word")).alias("form")).agg(F.max_by("word", "ord").alias("term"), F.min("ord").cast("long").alias("ord"))
    names = stored(names, "keywords")
    found, rest = [], names
    if names.count() > most:
        keyed = stored(names.select("ord", "term", "form").mapInArrow(_keyed, "ord long, term string, form string, key string"), "keys")
        each = own.mapInArrow(_page_words, "book_id string, page_idx int, page_label string, words array<string>").select("book_id", "page_idx", "page_label", F.explode("words").alias("key"))
        found.append(each.join(keyed.where("key is not null").select("key", "ord", "term"), "key").select("book_id", "term", "page_idx", "page_label", "ord"))
        rest = keyed.where("key is null")
    blocks = max(0 if found else 1, -(-rest.count() // most))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("form"), F.lit(blocks)))
    for k in range(blocks):
        table = [(r["ord"], r["form"]) for r in dealt.where(F.col("block") == k).select("ord", "form").collect()]
        hits = own.mapInArrow(_listed(table), "book_id string, page_idx int, page_label string, ords array<long>").select("book_id", "page_idx", "page_label", F.explode("ords").alias("ord"))
        found.append(hits.join(rest.select("ord", "term"), "ord").select("book_id", "term", "page_idx", "page_label", "ord"))
    return reduce(DataFrame.unionByName, found)


def sort_and_dedup(words: DataFrame) -> DataFrame:
    """(ord, word): of words alike but for case the first spelling, sorted by lower case. words: (ord, word)."""
    trimmed = words.select("ord", stripped(F.col("word")).alias("word")).where(F.length("word") > 0)
    first = F.row_number().over(Window.partitionBy(F.lower("word")).orderBy("ord"))
    kept = trimmed.withColumn("nth", first).where("nth = 1")
    return kept.select("word", F.lower("word").alias("key")).orderBy("key").select("word")


def add_if_absent(words: DataFrame, more: DataFrame) -> DataFrame:
    """words (word) with those of more that it does not have in any case. more: (word), or (ord, word); of those alike but for
    case the first spelling is added, by ord, else the smallest."""
    order = F.struct("ord", "word") if "ord" in more.columns else F.struct("word")
    fresh = more.withColumn("word", stripped(F.col("word"))).where(F.length("word") > 0).groupBy(F.lower("word").alias("key")).agg(F.min_by("word", order).alias("word"))
    known = words.select(F.lower("word").alias("key")).distinct()
    return words.select("word").unionByName(fresh.join(known, "key", "left_anti").select("word"))


def from_selection(selection: str) -> str:
    """A keyword from selected text: without ASCII punctuation at its end."""
    return selection.strip().rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def literal_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(ord, word) of a user's list."""
    return spark.createDataFrame(list(enumerate(terms)), "ord int, word string")
