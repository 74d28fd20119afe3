"""A versioned log of merge decisions, and the index as it was, or would be, at any version.

A log is a relation (version, action, source, target, undoes): action is `merge`, `separate` or `undo`; an undo names in
`undoes` the version of the entry that it takes back, any earlier one and not only the last. Nothing is ever changed in a log:
entries are added, and the state is what replaying the entries that stand gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import word_tokens
from folioscope.operators.index import page_counts
from folioscope.operators.merge import resolve
from folioscope.storage import stored

SCHEMA = "version long, action string, source string, target string, undoes long"


def empty_log(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], SCHEMA)


def added(log: DataFrame, action: str, source: str | None = None, target: str | None = None, undoes: int | None = None) -> DataFrame:
    """The log with one more entry, of the next version. Raises ValueError if the entry is none of the kinds, or undoes what
    the log does not have, or another undo."""
    if action == "undo":
        if undoes is None or log.where((F.col("version") == undoes) & (F.col("action") != "undo")).isEmpty():
            raise ValueError(f"the log has no decision of version {undoes}")
        source = target = None
    elif action not in ("merge", "separate") or not source or not target or source == target or undoes is not None:
        raise ValueError(f"{action} of {source!r} with {target!r}")
    last = log.agg(F.max("version")).first()[0] or 0
    fresh = log.sparkSession.createDataFrame([(last + 1, action, source, target, undoes)], SCHEMA)
    return log.unionByName(fresh)


def standing(log: DataFrame, version: int | None = None) -> DataFrame:
    """(version, action, source, target): decisions up to a version that no entry up to it takes back. Of several decisions on one
    source the last counts, as a source is decided once."""
    known = log if version is None else log.where(F.col("version") <= version)
    gone = known.where("action = 'undo'").select(F.col("undoes").alias("version")).distinct()
    kept = known.where("action <> 'undo'").join(gone, "version", "left_anti")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("version")))
    return kept.withColumn("nth", nth).where("nth = 1").select("version", "action", "source", "target")


def state(occ: DataFrame, log: DataFrame, version: int | None = None) -> DataFrame:
    """occ(book_id, term, page_idx, page_label) after the merges that stand at a version, in their order; None is the last.

    A merge whose source or target the book does not have when its turn comes is passed over. A page that several terms bring
    to a target keeps the target's own label, else that of the earlier merge. The log is a user's list of decisions and
    is resolved for each book by the terms it has, where its row is.
    """
    return _state(stored(occ, "occurrences"), log, version)


def _state(occ: DataFrame, log: DataFrame, version: int | None) -> DataFrame:
    """state of an occ that is read twice, and so is stored."""
    merges = standing(log, version).where("action = 'merge'")
    listed = [(r["source"], r["target"]) for r in merges.orderBy("version").collect()]
    named = stored(merges.select(F.explode(F.array("source", "target")).alias("term")).distinct(), "merged-terms")
    own = occ.select("book_id", "term").join(F.broadcast(named), "term", "left_semi").groupBy("book_id").agg(F.collect_set("term").alias("present"))

    def resolved(parts):  # noqa: ANN001, ANN202
        import pandas as pd

        for part in parts:
            rows = [(b, s, t, o) for b, present in zip(part["book_id"], part["present"], strict=True) for s, (t, o) in resolve(listed, set(present)).items()]
            yield pd.DataFrame(rows, columns=["book_id", "term", "target", "turn"])

    moves = stored(own.mapInPandas(resolved, "book_id string, term string, target string, turn int"), "merge-moves")
    moved = occ.join(moves, ["book_id", "term"], "left")
    target = moved.select("book_id", F.coalesce("target", "term").alias("term"), "page_idx", "page_label", F.coalesce("turn", F.lit(0)).alias("turn"))
    return target.groupBy("book_id", "term", "page_idx").agg(F.min_by("page_label", "turn").alias("page_label"))


def changes(occ: DataFrame, log: DataFrame, before: int, after: int) -> DataFrame:
    """(book_id, term, page_idx, change): pages that the entries after version `before` up to `after` give to terms, `added`, and
    take from them, `gone`."""
    pages = ["book_id", "term", "page_idx"]
    kept = stored(occ, "occurrences")
    old, new = (_state(kept, log, v).select(*pages, F.lit(change).alias("change")) for v, change in ((before, "gone"), (after, "added")))
    # A state has a page of a term once, so one that both have is there twice.
    return old.unionByName(new).groupBy(*pages).agg(F.count("*").alias("n"), F.min("change").alias("change")).where("n = 1").drop("n")


def candidates(index: DataFrame, source: str, most: int | None = None) -> DataFrame:
    """(book_id, target, pages, common, rank): terms to merge a source with, of the books that have it.

    A target shares a word with the source, or its whole text within; those with more words in common come first, then those that
    have the source within, then of more pages, then by spelling. most bounds the list of a book; None gives all."""
    size = page_counts(index).withColumnRenamed("n_pages", "pages")
    low = F.lower(F.lit(source))
    books = size.where(F.col("term") == source).select("book_id").distinct()
    words = F.array_distinct(word_tokens(low))
    common = F.size(F.array_intersect(word_tokens(F.lower("term")), words))
    within = F.lower("term").contains(low)
    found = size.where(F.col("term") != source).join(books, "book_id", "left_semi").withColumn("common", common).withColumn("within", within).where((F.col("common") > 0) | F.col("within"))
    order = Window.partitionBy("book_id").orderBy(F.desc("common"), F.desc("within"), F.desc("pages"), "term")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("book_id", F.col("term").alias("target"), "pages", "common", "rank")
