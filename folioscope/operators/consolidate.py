"""Names that stand inside longer names: groups under the longest form, and the pages that each form keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.operators.names import classify, display_name
from folioscope.storage import stored

#: Groups' rows up to which they are sent to every task.
MOST_SENT = 100_000


def words_of(term: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(term), r"\s+"), lambda w: w != "")


def belongs(short: Column, long: Column) -> Column:
    """Whether a run of words (arrays, lower case) inside a longer name is a form of it.

    Two words or more always are. One word is if it comes last; elsewhere only if no other word is one of places and bodies.
    """
    at = F.array_position(long, F.element_at(short, 1))
    generic = F.array(*[F.lit(w) for w in sorted(lexicon.NOT_PERSONS)])
    others = F.filter(long, lambda w, i: i != at - 1)
    return (F.size(short) >= 2) | ((at > 0) & ((at == F.size(long)) | ~F.arrays_overlap(others, generic)))


def name_groups(terms: DataFrame) -> DataFrame:
    """(book_id, term, longest_form): each distinct (book_id, term) with the form that leads its group, maybe itself.

    Among forms that a term belongs to, the one with most words leads, then by lower case and spelling. A form of several
    words that is inside another never leads, since what is inside it is inside that too; so two joins by the words' key
    settle all groups. Null terms are left out; a term without words is a group of its own.
    """
    # Stored, as it is read three times, and so that joins go by the terms' own size, not by that of the file they come from.
    own = stored(terms.where("term is not null").select("book_id", "term").distinct(), "terms").withColumn("words", words_of(F.col("term")))
    n = F.size("words")
    # A name is short, so its runs of words are few.
    lengths = F.sequence(F.lit(1), n - 1)
    runs = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    inner = own.where(n >= 2).select("book_id", F.col("term").alias("long"), F.col("words").alias("long_words"), F.explode(F.array_distinct(runs)).alias("key"))
    short = own.where(n >= 1).select("book_id", "term", "words", F.array_join("words", " ").alias("key"))
    pairs = inner.hint("merge").join(short, ["book_id", "key"]).where(belongs(F.col("words"), F.col("long_words")))
    held = pairs.where(n >= 2).select("book_id", F.col("term").alias("long")).distinct()
    order = F.struct(-F.size("long_words"), F.lower("long"), F.col("long"))
    chosen = pairs.join(held, ["book_id", "long"], "left_anti").groupBy("book_id", "term").agg(F.min_by("long", order).alias("long"))
    return own.select("book_id", "term").join(chosen, ["book_id", "term"], "left").select("book_id", "term", F.coalesce("long", "term").alias("longest_form"))


def group_pages(occ: DataFrame, groups: DataFrame) -> DataFrame:
    """(book_id, longest_form, term, page_idx, page_label): the pages of each form under its group.

    The longest form has all its pages, under its display key; another form has those on which the longest is not. Of a
    page's labels the smallest is used.
    """
    # Occurrences are never the side that is sent to all tasks, however small the file that they come from: groups are, if few.
    groups = stored(groups.select("book_id", "term", "longest_form"), "groups")
    few = groups.limit(MOST_SENT + 1).count() <= MOST_SENT
    met = occ.join(F.broadcast(groups), ["book_id", "term"]) if few else occ.hint("merge").join(groups, ["book_id", "term"])
    placed = met.groupBy("book_id", "longest_form", "term", "page_idx").agg(F.min("page_label").alias("page_label"))
    lead = F.col("term") == F.col("longest_form")
    taken = F.max(lead).over(Window.partitionBy("book_id", "longest_form", "page_idx"))
    kept = placed.withColumn("taken", taken).where(lead | ~F.col("taken"))
    shown = F.when(lead, display_name(F.col("term"), classify(F.col("term")))).otherwise(F.col("term"))
    return kept.select("book_id", "longest_form", shown.alias("term"), "page_idx", "page_label")
