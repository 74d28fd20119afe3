"""User merges, suggestions from containment, decisions and their undoing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import word_tokens
from folioscope.operators.index import page_counts
from folioscope.storage import stored


def contained_pairs(terms: DataFrame) -> DataFrame:
    """(book_id, a, b): the words of a are among those of b, and b has more words, or as many and more characters.

    Terms meet by their rarest word only: a contains it, so b must.
    """
    own = terms.select("book_id", "term", word_tokens(F.col("term")).alias("words")).where(F.size("words") > 0)
    each = own.select("book_id", "term", "words", F.explode("words").alias("word"))
    count = each.groupBy("book_id", "word").agg(F.count("*").alias("n"))
    rare = each.join(count, ["book_id", "word"]).groupBy("book_id", "term", "words").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    a = rare.select("book_id", F.col("term").alias("a"), F.col("words").alias("wa"), "word")
    b = each.select("book_id", F.col("term").alias("b"), F.col("words").alias("wb"), "word")
    more = (F.size("wa") < F.size("wb")) | ((F.size("wa") == F.size("wb")) & (F.length("a") < F.length("b")))
    return a.join(b, ["book_id", "word"]).where((F.size(F.array_except("wa", "wb")) == 0) & more).select("book_id", "a", "b", "wa", "wb")


def merge_suggestions(index: DataFrame) -> DataFrame:
    """(book_id, source, source_pages, containers array<struct<entry, pages>>, target, target_pages) of an index (occ, a raw
    index, or their page counts).

    A source's words are all in each container: strictly fewer, or the same words with the source inside as a whole."""
    size = page_counts(index).withColumnRenamed("n_pages", "pages")
    inside = F.concat(F.lit(" "), F.regexp_replace(F.lower("b"), rf"[^\p{{L}}\p{{N}}_]", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace(F.lower("a"), rf"[^\p{{L}}\p{{N}}_]", " "), F.lit(" "))) & F.lower("b").contains(F.lower("a"))
    pairs = contained_pairs(size).where((F.size("wa") < F.size("wb")) | inside)
    joined = pairs.join(size.select("book_id", F.col("term").alias("b"), F.col("pages").alias("pages_b")), ["book_id", "b"])
    entry = F.struct((-F.length("b")).alias("order"), F.lower("b").alias("low"), F.col("b").alias("entry"), F.col("pages_b").alias("pages"))
    per = joined.groupBy("book_id", "a").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    named = per.join(size.select("book_id", F.col("term").alias("a"), F.col("pages").alias("source_pages")), ["book_id", "a"])
    containers = F.transform("c", lambda x: F.struct(x["entry"].alias("entry"), x["pages"].alias("pages")))
    return named.select("book_id", F.col("a").alias("source"), "source_pages", containers.alias("containers"), F.col("c")[0]["entry"].alias("target"), F.col("c")[0]["pages"].alias("target_pages"))


def resolve(merges: list[tuple[str, str]], present: set[str]) -> dict[str, tuple[str, int]]:
    """source: (final target, order) of merges in their order; one whose source or target is not there then is skipped."""
    now, final = set(present), {}
    for k, (source, target) in enumerate(merges):
        if source == target or source not in now or target not in now:
            continue
        now.discard(source)
        for s, (t, o) in list(final.items()):
            if t == source:
                final[s] = (target, o)
        final[source] = (target, k + 1)
    return final


def apply_merges(occ: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """occ with sources' pages given to their targets; of a page's labels the target's wins, then the earlier source's.

    All books share the list. Each book resolves it by the listed terms that it has, where its row is.
    """
    return _merged(stored(occ, "occurrences"), merges)


def _merged(occ: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """apply_merges of an occ that is read twice, and so is stored."""
    named = sorted({x for pair in merges for x in pair})
    own = occ.where(F.col("term").isin(*named) if named else F.lit(False)).groupBy("book_id").agg(F.collect_set("term").alias("present"))

    def resolved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(book, s, t, o) for book, present in zip(part["book_id"], part["present"], strict=True) for s, (t, o) in resolve(merges, set(present)).items()]
            yield pd.DataFrame(rows, columns=["book_id", "term", "target", "rank"])

    mapped = own.mapInPandas(resolved, "book_id string, term string, target string, rank int")
    moved = occ.join(mapped, ["book_id", "term"], "left")
    target = moved.select("book_id", F.coalesce("target", "term").alias("term"), "page_idx", "page_label", F.coalesce("rank", F.lit(0)).alias("rank"))
    return target.groupBy("book_id", "term", "page_idx").agg(F.min_by("page_label", "rank").alias("page_label"))


def pending(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions without a decision (source, decision, target)."""
    return suggestions.join(decisions.select("source"), "source", "left_anti").select(*suggestions.columns)


def decided(suggestions: DataFrame, decisions: DataFrame, index: DataFrame) -> DataFrame:
    """The suggestions that are decided, with their decision, and merges whose source is no longer in the index.

    decisions: (source, decision, target, and, for merges, n_pages: how many pages the source had). A merged-away source
    has its target as its only container, in each book that has it (a null book if none has). index: occ, a raw index, or their page counts. Decisions to keep apart of what is
    suggested no more are left out."""
    known = suggestions.join(decisions.select("source", "decision"), "source").select(*suggestions.columns, "decision")
    counts = page_counts(index)
    pages = F.col("n_pages").cast("int") if "n_pages" in decisions.columns else F.lit(0)
    gone = decisions.where("decision = 'merged'").select("source", "target", pages.alias("source_pages")).join(counts.select(F.col("term").alias("source")).distinct(), "source", "left_anti")
    target = gone.join(counts.select("book_id", F.col("term").alias("target"), F.col("n_pages").alias("target_pages")), "target", "left")
    size = F.coalesce("target_pages", F.lit(0))
    rows = target.select("book_id", "source", "source_pages", F.array(F.struct(F.col("target").alias("entry"), size.alias("pages"))).alias("containers"), "target", size.alias("target_pages"), F.lit("merged").alias("decision"))
    return known.unionByName(rows.select(*known.columns))


def keep_separate(decisions: DataFrame, source: str, target: str) -> DataFrame:
    fresh = decisions.sparkSession.createDataFrame([(source, "separate", target)], "source string, decision string, target string")
    return decisions.where(F.col("source") != source).select("source", "decision", "target").unionByName(fresh)


def merge_with_undo(occ: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occ after the merge, the source's pages, the pages that are new to the target)."""
    cols = ["book_id", "page_idx"]
    occ = stored(occ, "occurrences")
    original = occ.where(F.col("term") == source)
    added = original.join(occ.where(F.col("term") == target).select(*cols), cols, "left_anti")
    return _merged(occ, [(source, target)]), original, added


def undo(occ: DataFrame, original: DataFrame, added: DataFrame, target: str) -> DataFrame:
    """The source's pages are back, and what the merge added to the target is gone."""
    gone = added.select("book_id", "page_idx", F.lit(target).alias("term"))
    return occ.join(gone, ["book_id", "page_idx", "term"], "left_anti").select("book_id", "term", "page_idx", "page_label").unionByName(original.select("book_id", "term", "page_idx", "page_label"))
