"""The index itself: union, suppression, page ranges, order, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import upper_first
from folioscope.storage import stored

#: Pages of a block in which runs are found.
BLOCK = 1 << 16


def unite(keyword_occ: DataFrame, name_occ: DataFrame) -> DataFrame:
    """occ of both, one row for each term and page; the keyword's label wins."""
    cols = ["book_id", "term", "page_idx", "page_label"]
    both = keyword_occ.select(*cols, F.lit(0).alias("src")).unionByName(name_occ.select(*cols, F.lit(1).alias("src")))
    return both.groupBy("book_id", "term", "page_idx").agg(F.min_by("page_label", "src").alias("page_label"))


def suppress_covered(occ: DataFrame) -> DataFrame:
    """Entries of one word lose the pages on which an entry of several words (or with a comma) has that word."""
    occ = stored(occ, "occurrences")  # read three times
    compound = F.col("term").rlike("[ ,]")
    parts = occ.where(compound).select("book_id", F.explode(F.array_distinct(F.split(F.lower("term"), r"[\s,]+"))).alias("word"), "page_idx").where("word <> ''").distinct()
    single = occ.where(~compound).withColumn("word", F.lower("term")).join(parts, ["book_id", "word", "page_idx"], "left_anti").drop("word")
    return occ.where(compound).unionByName(single.select(*occ.columns))


def nested(occ: DataFrame) -> DataFrame:
    """raw_index(book_id, term, pages): pages sorted by place."""
    return occ.groupBy("book_id", "term").agg(F.array_sort(F.collect_list(F.struct("page_idx", "page_label"))).alias("pages"))


def page_counts(index: DataFrame) -> DataFrame:
    """(book_id, term, n_pages) of occ, of a raw index, or of itself. Pages of occ are counted before the shuffle, not listed."""
    if "n_pages" in index.columns:
        return index.select("book_id", "term", "n_pages")
    if "pages" in index.columns:
        return index.select("book_id", "term", F.size("pages").alias("n_pages"))
    return index.groupBy("book_id", "term").agg(F.count("*").cast("int").alias("n_pages"))


def page_runs(occ: DataFrame, block: int = BLOCK) -> DataFrame:
    """(book_id, term, first_idx, first_label, last_idx, last_label): consecutive pages of a term.

    Runs are found in blocks of pages, so that a term of very many pages goes to several tasks; only runs that touch a
    block's border are then stitched together.
    """
    ends = [F.min("first_idx").alias("first_idx"), F.min_by("first_label", "first_idx").alias("first_label"), F.max("last_idx").alias("last_idx"), F.max_by("last_label", "last_idx").alias("last_label")]
    island = F.col("page_idx") - F.row_number().over(Window.partitionBy("book_id", "term", "block").orderBy("page_idx"))
    placed = occ.withColumn("block", F.expr(f"page_idx div {int(block)}")).withColumn("island", island)
    each = placed.select("book_id", "term", "block", "island", *[F.col(c).alias(f"{e}_{n}") for e in ("first", "last") for c, n in (("page_idx", "idx"), ("page_label", "label"))])
    runs = each.groupBy("book_id", "term", "block", "island").agg(*ends)
    border = (F.col("first_idx") % block == 0) | (F.col("last_idx") % block == block - 1)
    in_order = Window.partitionBy("book_id", "term").orderBy("first_idx")
    opens = F.coalesce(F.lag("last_idx").over(in_order) != F.col("first_idx") - 1, F.lit(True))
    edge = runs.where(border).withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(in_order))
    names = ["book_id", "term", "first_idx", "first_label", "last_idx", "last_label"]
    return runs.where(~border).select(*names).unionByName(edge.groupBy("book_id", "term", "run").agg(*ends).select(*names))


def joined_runs(runs: DataFrame, text: Column, block: int = BLOCK) -> DataFrame:
    """(book_id, term, pages) of page_runs: their texts in order, joined by commas. They are joined within blocks of pages first, so
    that what is put in order for a whole term is one text for each block, and not a row for each run."""
    place = F.expr(f"first_idx div {int(block)}").alias("block")
    inner = runs.groupBy("book_id", "term", place).agg(F.array_sort(F.collect_list(F.struct("first_idx", text.alias("text")))).alias("runs"))
    texts = inner.select("book_id", "term", "block", F.array_join(F.transform("runs", lambda r: r["text"]), ", ").alias("text"))
    blocks = texts.groupBy("book_id", "term").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("blocks"))
    return blocks.select("book_id", "term", F.array_join(F.transform("blocks", lambda b: b["text"]), ", ").alias("pages"))


def formatted(occ: DataFrame, capitalize: bool = False, merge_on_collision: bool = False) -> DataFrame:
    """(book_id, display_term, pages): runs as `first-last`, joined by commas.

    Capitalised terms that then meet: the one that came last into the index (by its first page, then by `ord` if occ has
    it, then by spelling) stands alone, or with merge_on_collision their pages unite.
    """
    shown = upper_first(F.col("term")) if capitalize else F.col("term")
    if capitalize and merge_on_collision:
        return formatted(occ.withColumn("term", shown).groupBy("book_id", "term", "page_idx").agg(F.min("page_label").alias("page_label")))
    if capitalize:
        occ = stored(occ, "occurrences")  # read twice
        first = occ.groupBy("book_id", "term").agg(F.min("page_idx").alias("came"), F.min("ord" if "ord" in occ.columns else F.lit(0)).alias("ord"))
        last = first.groupBy("book_id", shown.alias("shown")).agg(F.max_by("term", F.struct("came", "ord", "term")).alias("term"))
        occ = occ.join(last, ["book_id", "term"], "left_semi")
    label = F.when(F.col("first_idx") == F.col("last_idx"), F.col("first_label")).otherwise(F.concat_ws("-", "first_label", "last_label"))
    return joined_runs(page_runs(occ), label).select("book_id", shown.alias("display_term"), "pages")


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy("book_id", F.lower("display_term"), "display_term")


def terms_on_page(occ: DataFrame, page_idx: int) -> DataFrame:
    return occ.where(F.col("page_idx") == page_idx).select("book_id", "term").distinct()


def lookup(lines: DataFrame, wanted: str) -> DataFrame:
    """The line that a term leads to: its heading, else one with it as a whole word, else one that contains it."""
    heading, key = F.lower("display_term"), wanted.lower()
    from folioscope.functions.text import keyword_pattern

    tier = F.when(heading == key, 0).when(F.col("display_term").rlike(keyword_pattern(wanted)), 1).when(heading.contains(key), 2)
    return lines.withColumn("tier", tier).where("tier is not null").orderBy("tier", heading, "display_term").limit(1).drop("tier")


def goto(pages: DataFrame, number: int) -> DataFrame:
    """The page of a 1-based number; no row outside the book."""
    return pages.where(F.col("page_idx") == number - 1)


def parse_link(link: str) -> tuple[int, str]:
    idx, _, term = link.lstrip("#").partition("|")
    return int(idx), term
