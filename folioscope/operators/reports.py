"""Nine reports on an index's quality, each as its own relation, and `findings` of them all as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import lexicon
from folioscope.functions.text import W, casefold, word_tokens
from folioscope.operators.graph import components
from folioscope.operators.index import page_counts
from folioscope.operators.merge import contained_pairs
from folioscope.storage import stored

REPORTS = ("similar_terms", "overlapping_terms", "capitalization_variants", "formatting_variants", "unused_include_terms", "thin_entries", "dense_entries", "shared_page_sets", "acronym_pairs")
MOST_SIMILAR, MOST_SHARED = 600, 2000
#: Pages that are numbered together where a term's pages are put in order.
PAGE_BLOCK = 4096


def _subset(a: str | Column, b: str | Column) -> Column:
    """All words of one are among the other's; so are no words."""
    both_none = (F.size(a) == 0) | (F.size(b) == 0)
    return both_none | (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def _books(terms: DataFrame, most: int | None, over: bool = False) -> DataFrame:
    """book_id of the books of at most `most` entries, or of those over it."""
    counts = terms.groupBy("book_id").agg(F.countDistinct("term").alias("n"))
    return counts.where(F.lit(False) if most is None else (F.col("n") > most if over else F.col("n") <= most)).select("book_id")


def similar_pairs(terms: DataFrame, max_entries: int | None = MOST_SIMILAR) -> DataFrame:
    """(book_id, a, b): spellings at most three edits apart, neither's words all among the other's.

    Pairs meet by pieces: a text cut into four has a piece that three edits leave whole, moved by three places at most. Texts
    are cut by their own length, so candidates come from lengths within three. None if a book has more than max_entries.
    """
    own = terms.select("book_id", "term", casefold(F.col("term")).alias("f")).withColumn("words", F.array_distinct(F.regexp_extract_all("f", F.lit(f"{W}+"), F.lit(0)))).withColumn("n", F.length("f"))
    if max_entries is not None:
        own = own.join(_books(terms, max_entries), "book_id", "left_semi")
    # Pieces of a: (its length, which piece, its text). Pieces of b at every length and place that a may have.
    size = lambda n, k: F.floor((n + k) / 4).cast("int")
    start = lambda n, k: sum((size(n, j) for j in range(k)), F.lit(0)) + 1
    cut = own.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("f", start(F.col("n"), k), size(F.col("n"), k)).alias("piece")) for k in range(4)])).alias("p"))
    a = cut.select("book_id", F.col("term").alias("a"), F.col("f").alias("fa"), F.col("words").alias("wa"), F.col("n").alias("len"), F.col("p.k").alias("k"), F.col("p.piece").alias("piece"))
    lengths = own.select("*", F.explode(F.sequence(F.greatest(F.col("n") - 3, F.lit(0)), F.col("n") + 3)).alias("len"))
    placed = lengths.select("*", F.explode(F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(-3), F.lit(3)), _piece(k, start(F.col("len"), k), size(F.col("len"), k))) for k in range(4)
    ]))).alias("p"))
    b = placed.select("book_id", F.col("term").alias("b"), F.col("f").alias("fb"), F.col("words").alias("wb"), "len", F.col("p.k").alias("k"), F.col("p.piece").alias("piece")).where("piece is not null").distinct()
    near = a.join(b, ["book_id", "len", "k", "piece"]).where("a <> b").where((F.levenshtein("fa", "fb", 3) >= 0) & ~_subset("wa", "wb"))
    return near.select("book_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _piece(k: int, start: Column, size: Column):  # noqa: ANN202
    def at(shift: Column) -> Column:
        begin = start + shift
        return F.struct(F.lit(k).alias("k"), F.when(begin >= 1, F.substring("f", begin, size)).alias("piece"))

    return at


def similar_clusters(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(book_id, term, cluster): the smallest term that each of a pair is connected with. An error if that does not settle
    within `rounds`."""
    node = lambda c: F.struct("book_id", F.col(c).alias("term"))
    found = components(pairs.where("a <> b").select(node("a").alias("a"), node("b").alias("b")), max_rounds=rounds)
    return found.select("node.book_id", "node.term", F.col("root.term").alias("cluster"))


def overlapping(terms: DataFrame) -> DataFrame:
    """(book_id, term, containers): each term with those that have all its words, by number of words and lower case."""
    order = F.struct(F.size("wb").alias("n"), F.lower("b").alias("low"), F.col("b").alias("b"))
    return contained_pairs(terms).groupBy("book_id", F.col("a").alias("term")).agg(F.array_sort(F.collect_list(order)).alias("c")).select("book_id", "term", F.transform("c", lambda x: x["b"]).alias("containers"))


def capitalization_variants(terms: DataFrame) -> DataFrame:
    return terms.groupBy("book_id", casefold(F.col("term")).alias("folded")).agg(F.array_sort(F.collect_set("term")).alias("variants")).where(F.size("variants") >= 2)


def formatting_variants(terms: DataFrame) -> DataFrame:
    """(book_id, variants): the same words in another order, or alike but for hyphens and spaces; no group inside another."""
    folded = terms.select("book_id", "term", casefold(F.col("term")).alias("f")).withColumn("words", F.array_sort(F.regexp_extract_all("f", F.lit(f"{W}+"), F.lit(0))))
    by_words = folded.where(F.size("words") >= 2).select("book_id", "term", F.concat(F.lit("w:"), F.array_join("words", " ")).alias("key"))
    by_shape = folded.select("book_id", "term", F.concat(F.lit("h:"), F.regexp_replace("f", r"[-\s]", "")).alias("key")).where("key <> 'h:'")
    groups = by_words.unionByName(by_shape).groupBy("book_id", "key").agg(F.array_sort(F.collect_set("term")).alias("variants")).where(F.size("variants") >= 2)
    distinct = groups.select("book_id", "variants").distinct()
    # A term is in two groups at most, so meeting by terms is enough to see one inside another.
    each = distinct.select("book_id", "variants", F.explode("variants").alias("term"))
    inside = each.join(each.select("book_id", "term", F.col("variants").alias("other")), ["book_id", "term"]).where((F.size("variants") < F.size("other")) & (F.size(F.array_except("variants", "other")) == 0))
    return distinct.join(inside.select("book_id", "variants").distinct(), ["book_id", "variants"], "left_anti")


def unused_keywords(terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """word: keywords as they are written, blank ones too, that are no term of any book but for case."""
    known = terms.select(casefold(F.col("term")).alias("f")).distinct()
    return keywords.withColumn("f", casefold(F.col("word"))).join(known, "f", "left_anti").select("word")


def thin(index: DataFrame, most: int = 1) -> DataFrame:
    """index: occ, or what page_counts makes of it."""
    return page_counts(index).where(F.col("n_pages") <= most)


def dense(index: DataFrame, least: int = 20) -> DataFrame:
    counts = page_counts(index).where(F.col("n_pages") >= least)
    return counts.withColumn("note", F.concat(F.col("n_pages").cast("string"), F.lit(" pages")))


def _ranked(rows: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """rows (book_id, term, page_idx, busy, ...) with `nth`, a page's number from 1 among its term's pages by busy and page_idx.

    Pages are numbered within blocks, and blocks by how many pages are before them, so that no task orders all of a term."""
    dealt = rows.withColumn("block", F.expr(f"page_idx div {int(block)}"))
    keys = ["book_id", "term", "busy", "block"]
    before = Window.partitionBy("book_id", "term").orderBy("busy", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys).agg(F.count("*").alias("size"))
    starts = stored(sizes.select(*keys, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), "page-blocks")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("page_idx"))
    return dealt.withColumn("inside", inside).join(starts, keys).withColumn("nth", F.col("start") + F.col("inside")).drop("block", "inside", "start")


def shared_pages(occ: DataFrame, least: float = 0.8, max_entries: int | None = MOST_SHARED) -> DataFrame:
    """(book_id, a, b, note): terms whose page sets have a Jaccard similarity of `least` or more and none of whose words are all
    the other's. A term without words is left out, as its words are among all others'.

    Pages are ordered by how few terms they have; similar sets share a page among each one's first pages, so only those meet.
    Pairs that have met are one, and are sifted by their sizes and words, before their common pages are counted by a join.
    """
    # Counts are stored, so that their joins with a term or page of very many rows are between scans, and can split it.
    pages = stored(occ.select("book_id", "term", "page_idx").distinct(), "occurrences")
    counts = stored(pages.groupBy("book_id", "term").agg(F.count("page_idx").alias("n")), "term-pages")
    sized = pages.join(counts, ["book_id", "term"])
    if max_entries is not None:
        sized = sized.join(_books(pages, max_entries), "book_id", "left_semi")
    sized = stored(sized, "sized-pages")  # read five times
    busy = stored(sized.groupBy("book_id", "page_idx").agg(F.count("*").alias("busy")), "page-terms")
    ranked = _ranked(stored(sized.join(busy, ["book_id", "page_idx"]), "busy-pages"))
    first = ranked.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    x = first.select("book_id", "page_idx", F.col("term").alias("a"), F.col("n").alias("na"))
    y = first.select("book_id", "page_idx", F.col("term").alias("b"), F.col("n").alias("nb"))
    met = x.join(y, ["book_id", "page_idx"]).where("a < b").where(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("book_id", "a", "b", "na", "nb").distinct()
    apart = met.where(~_subset(word_tokens(F.col("a")), word_tokens(F.col("b"))))
    pages_a = sized.select("book_id", F.col("term").alias("a"), "page_idx")
    pages_b = sized.select("book_id", F.col("term").alias("b"), "page_idx")
    counted = apart.join(pages_a, ["book_id", "a"]).join(pages_b, ["book_id", "b", "page_idx"]).groupBy("book_id", "a", "b", "na", "nb").agg(F.count("*").alias("both"))
    score = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return counted.where(score >= least).select("book_id", "a", "b", F.concat(F.floor(score * 100).cast("string"), F.lit("% overlap")).alias("note"))


def acronyms(terms: DataFrame) -> DataFrame:
    """(book_id, acronym, expansion): capitals that are the initials of a longer term's words."""
    words = F.regexp_extract_all("term", F.lit(f"{W}+"), F.lit(0))
    skip = F.array(*[F.lit(w) for w in lexicon.ACRONYM_SKIP])
    initials = F.array_join(F.transform(F.filter(words, lambda w: ~F.array_contains(skip, F.lower(w))), lambda w: F.lower(F.substring(w, 1, 1))), "")
    long = terms.where(F.size(words) >= 2).select("book_id", F.col("term").alias("expansion"), initials.alias("initials"))
    short = terms.where(F.col("term").rlike("^[A-Z]{2,6}$")).select("book_id", F.col("term").alias("acronym"), F.lower("term").alias("initials"))
    return short.join(long, ["book_id", "initials"]).select("book_id", "acronym", "expansion")


def findings(
    occ: DataFrame, keywords: DataFrame, most: int = 1, least: int = 20, reports: tuple[str, ...] = REPORTS, most_similar: int | None = MOST_SIMILAR, most_shared: int | None = MOST_SHARED,
) -> DataFrame:
    """(report_id, book_id, key, terms array<string>, note) of the chosen reports; the key is the first term.

    Books over most_similar or most_shared entries have no findings in those two reports; `sections` names them. Unused
    keywords belong to no book. A null limit is none."""
    terms = occ.select("book_id", "term").distinct()
    none = F.lit("")

    def of(df: DataFrame, found: Column, note: Column = none, book: Column | None = None) -> DataFrame:
        return df.select((F.col("book_id") if book is None else book).alias("book_id"), found.alias("terms"), note.alias("note"))

    def clusters() -> DataFrame:
        return similar_clusters(similar_pairs(terms, most_similar)).groupBy("book_id", "cluster").agg(F.array_sort(F.collect_list("term")).alias("terms"))

    makers = {
        "similar_terms": lambda: of(clusters(), F.col("terms")), "overlapping_terms": lambda: of(overlapping(terms), F.concat(F.array("term"), "containers")),
        "capitalization_variants": lambda: of(capitalization_variants(terms), F.col("variants")), "formatting_variants": lambda: of(formatting_variants(terms), F.col("variants")),
        "unused_include_terms": lambda: of(unused_keywords(terms, keywords), F.array("word"), book=F.lit(None).cast("string")),
        "thin_entries": lambda: of(thin(occ, most), F.array("term")), "dense_entries": lambda: of(dense(occ, least), F.array("term"), F.col("note")),
        "shared_page_sets": lambda: of(shared_pages(occ, max_entries=most_shared), F.array("a", "b"), F.col("note")), "acronym_pairs": lambda: of(acronyms(terms), F.array("acronym", "expansion")),
    }
    each = [makers[r]().select(F.lit(r).alias("report_id"), "book_id", F.col("terms")[0].alias("key"), "terms", "note") for r in REPORTS if r in reports]
    return reduce(DataFrame.unionByName, each)


def sections(occ: DataFrame, reports: tuple[str, ...] | None = None, most_similar: int | None = MOST_SIMILAR, most_shared: int | None = MOST_SHARED) -> DataFrame:
    """(report_id, ord, book_id, not_run): all reports of each book in their fixed order. A report is not run where it is not
    chosen, or where the book has too many entries for it. An empty index has no books, so no sections."""
    books = occ.groupBy("book_id").agg(F.countDistinct("term").alias("n"))
    limit = {"similar_terms": most_similar, "shared_page_sets": most_shared}
    rows = []
    for k, r in enumerate(REPORTS):
        over = F.lit(True) if reports is not None and r not in reports else (F.col("n") > limit[r]) if limit.get(r) is not None else F.lit(False)
        rows.append(F.struct(F.lit(r).alias("report_id"), F.lit(k).alias("ord"), over.alias("not_run")))
    return books.select("book_id", F.explode(F.array(*rows)).alias("s")).select("s.report_id", "s.ord", "book_id", "s.not_run")


def summary(
    occ: DataFrame, keywords: DataFrame, most: int = 1, least: int = 20, reports: tuple[str, ...] = REPORTS, most_similar: int | None = None, most_shared: int | None = None,
) -> DataFrame:
    """(report_id, findings, not_run): how many findings each chosen report has, and for how many books it was not run. Without
    limits, as by default, books of any size are looked through."""
    counts = findings(occ, keywords, most, least, reports, most_similar, most_shared).groupBy("report_id").agg(F.count("*").alias("findings"))
    left_out = sections(occ, None, most_similar, most_shared).groupBy("report_id").agg(F.count_if("not_run").alias("not_run"))
    chosen = occ.sparkSession.createDataFrame([(r,) for r in REPORTS if r in reports], "report_id string")
    both = chosen.join(F.broadcast(counts), "report_id", "left").join(F.broadcast(left_out), "report_id", "left")  # a row for each report
    return both.select("report_id", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("not_run", F.lit(0)).cast("long").alias("not_run"))
