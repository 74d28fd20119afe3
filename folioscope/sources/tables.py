"""Adapters from tables and files to the engine's relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.config import IndexConfig
from folioscope.functions.text import stripped
from folioscope.sources.index_json import read_index  # noqa: F401


def documents_as_book(docs: DataFrame) -> DataFrame:
    """pages(book_id, page_idx, page_label, text): one book, a document is a page."""
    return docs.select(F.lit("documents").alias("book_id"), F.col("doc_id").cast("int").alias("page_idx"), (F.col("doc_id") + 1).cast("string").alias("page_label"), "text")


def documents_as_books(docs: DataFrame) -> DataFrame:
    """A book for each source, its documents in the order of their ids."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select(F.col("source").alias("book_id"), nth.alias("page_idx"), "text").withColumn("page_label", (F.col("page_idx") + 1).cast("string"))


def conversations_as_books(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("page_idx"), (F.col("turn") + 1).cast("string").alias("page_label"), "text")


def page_label(config: IndexConfig, idx: Column, label: Column) -> Column:
    """What a page is called in the index. Logical labels ignore the offset."""
    if config.page_strategy == "physical":
        return (idx + 1 + config.page_offset).cast("string")
    return F.coalesce(F.nullif(label, F.lit("")), (idx + 1).cast("string"))


def labelled_pages(pages: DataFrame, config: IndexConfig) -> DataFrame:
    """Pages from the first that is read on, with their labels."""
    return pages.where(F.col("page_idx") >= config.start_page).withColumn("page_label", page_label(config, F.col("page_idx"), F.col("page_label")))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: stripped lines that are not empty (exclude, stop-word and place lists)."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("word")).where(F.length("word") > 0)


def keyword_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a keyword list as they are, blank ones too, in their order. The list is a user's, so it comes to the driver."""
    text = spark.read.text(path, wholetext=True).first()
    return text[0].splitlines() if text else []


def split_excludes(text: str) -> list[str]:
    """Entries of an exclude list on one line."""
    return [x.strip() for x in text.split(",") if x.strip()]


def legacy_types(words: DataFrame) -> DataFrame:
    """(name, type) of the older list of proper names (word), all of which are places and things."""
    return words.select(F.lower("word").alias("name"), F.lit("place_thing").alias("type")).distinct()


def html_as_blocks(pages: DataFrame) -> DataFrame:
    """styled tokens' source from html: text outside tags, bold where the last b tag before it opens one.

    (page_idx, spans array<struct<text, flags>>); flags 16 is bold, as in the layout relation.
    """
    pieces = F.split(F.regexp_replace("html", r"(?s)<(?!/?b>)[^>]*>", " "), "(?=</?b>)")
    span = F.transform(pieces, lambda p: F.struct(F.regexp_replace(p, "^</?b>", "").alias("text"), F.when(p.startswith("<b>"), 16).otherwise(0).alias("flags")))
    return pages.select(F.lit("pages").alias("book_id"), F.col("page_id").cast("int").alias("page_idx"), (F.col("page_id") + 1).cast("string").alias("page_label"), span.alias("spans"))


def name_types(overrides: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(name, type) of known types. An edited place list replaces all places and keeps the persons."""
    known = overrides.where(F.col("type").isin("person", "place_thing")).select(F.lower("name").alias("name"), "type")
    if places is None:
        return known
    return known.where("type = 'person'").unionByName(places.select(F.lower("word").alias("name"), F.lit("place_thing").alias("type")).distinct())
