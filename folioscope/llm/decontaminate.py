"""Benchmark decontamination, in DataFrame operations only.

The benchmark's word windows become a hash table that is broadcast while it stays under a bound. Each document is read
once: every window of its words looks its 64-bit hash up, and a hit is verified against the window's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD_PATTERN, ascii_lower, free_name, quoted, stored

#: Words of a window.
WINDOW = 10
#: Most distinct benchmark windows (some 200 bytes each) and ids of items in them that are broadcast, together; with more the
#: windows are shuffled by hash.
BROADCAST_WINDOWS = 1_000_000


def text_words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words, size, items, hash): each distinct window with the items that have it. An item of fewer words than a
    window, but not none, is one window."""
    item, text = quoted([id_col, text_col])
    words = benchmark.select(item.cast("string").alias("item"), text_words(text).alias("words")).where(F.size("words") > 0)
    sized = words.withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    each = sized.select("item", "size", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.col("size")))).alias("words"))
    return each.groupBy("words", "size").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("words"))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS, keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns of docs (all by default) with n_words long, hit_words array<long> (places of hit words, from 0,
    ascending) and items array<string> (ids of the items with occurring windows, ascending; a null id is not listed).

    A row for each row of docs: repeated rows and null ids stay apart. Null and empty texts, and any text if the benchmark
    is empty, have no hit. Columns of docs with the names of results are replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("n_words", "hit_words", "items")]
    windows = benchmark_windows(benchmark, window, item_id, item_text)
    sizes, total = [], 0
    for size, n in sorted(windows.groupBy("size").agg(F.sum(1 + F.size("items"))).collect()):  # a row for each size, `window` of them at most
        sizes.append(size)
        total += n
    row = F.struct(*[c.alias(n) for c, n in zip(quoted(names), names, strict=True)]) if names else F.struct(F.lit(0).alias("none"))
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), *[c.alias("text") for c in quoted([text_col])])
    if total > broadcast_windows:  # read twice below, so the numbers are written down: a task that runs again must not give others
        numbered = stored(numbered, "numbered")
    texts = numbered.select("rid", "row", text_words(F.col("text")).alias("words"))

    # A look has its own window's words and no more. The first one of a text has its row instead, and keeps it in the result:
    # it matches the empty window of the table.
    def look(at: Column, size: int, own: Column, row: Column, n: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(size).alias("size"), own.alias("own"), row.alias("row"), n.cast("long").alias("n"))

    no_row, no_words = F.when(F.lit(False), F.col("row")), F.lit(None).cast("array<string>")

    def looks_of(size: int) -> Column:
        starts = F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: look(i, size, F.slice("words", i, F.lit(size)), no_row, F.lit(None)))

    looks = F.concat(F.array(look(F.lit(0), 0, no_words, F.col("row"), F.size("words"))), *[looks_of(size) for size in sizes])
    probes = texts.select("rid", F.explode(looks).alias("look")).select("rid", "look.*")
    probes = probes.withColumn("hash", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("own")))
    none = windows.sparkSession.range(1).selectExpr("cast(array() as array<string>) as words", "0 as size", "cast(array() as array<string>) as items", "0L as hash")
    table = windows.select("words", "size", "items", "hash").unionByName(none).select(*[F.col(c).alias(f"w_{c}") for c in ("words", "size", "items", "hash")])
    same = (F.col("hash") == F.col("w_hash")) & (F.col("size") == F.col("w_size")) & ((F.col("w_size") == 0) | (F.col("own") == F.col("w_words")))
    if total <= broadcast_windows:
        found = probes.join(F.broadcast(table), same)
    else:  # first looks have one hash, so they stay out of the shuffle
        first = probes.where("size = 0").select("*", F.array().cast("array<string>").alias("w_words"), F.lit(0).alias("w_size"), F.array().cast("array<string>").alias("w_items"), F.lit(0).cast("long").alias("w_hash"))
        found = probes.where("size > 0").join(table.where("w_size > 0").hint("merge"), same).unionByName(first)
    hit = F.col("w_size") > 0
    gathered = found.select("rid", "row", "n", F.when(hit, F.struct("at", "size")).alias("hit"), "w_items")
    per = gathered.groupBy("rid").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("w_items").alias("sets")
    )
    places = F.flatten(F.transform("hits", lambda h: F.sequence(h["at"].cast("long") - 1, h["at"].cast("long") + h["size"] - 2)))
    result = per.select("row", "n_words", F.array_sort(F.array_distinct(places)).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    return result.select(*(["row.*"] if names else []), "n_words", "hit_words", "items")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents without a hit, with their columns."""
    kept = free_name(docs, "kept")
    marked = docs.withColumn(kept, F.lit(True))
    return find_hits(marked, benchmark, **options).where(F.size("hit_words") == 0).select(*quoted(docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """All documents, their hit words taken out; what stands between words stays. Texts without a hit are unchanged."""
    found = find_hits(docs, benchmark, text_col=text_col, **options)
    text = F.col(f"`{text_col}`")
    folded = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
    gaps, words = F.split(text, folded, -1), F.regexp_extract_all(text, F.lit(folded), F.lit(0))
    left = F.transform(words, lambda w, i: F.when(F.array_contains("hit_words", i.cast("long")), F.lit("")).otherwise(w))
    whole = F.concat_ws("", F.flatten(F.zip_with(gaps, left, lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))))
    cleaned = found.withColumn(text_col, F.when(F.size("hit_words") > 0, whole).otherwise(text))
    return cleaned.select(*quoted(docs.columns))
