"""Ranked lexical search by dense blocked multiplication.

The items' words are a compact vocabulary. A first pass keeps, of each document, its length and how often it holds words of
that vocabulary. The second multiplies tiles of item weights by tiles of document impacts in float64, whose sums stay below
2^53 and so are exact whole numbers, adds the tiles up in 64-bit integers, and keeps each item's best documents of a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import alnum_words, free_name, stored

#: Bytes of item texts that are searched for together: their vocabulary is broadcast. More items are dealt into groups.
GROUP_BYTES = 32 << 20
#: Rows and columns of the tiles: items, words and documents.
ITEM_TILE, WORD_TILE, DOCUMENT_TILE = 256, 2048, 1024
#: Largest weight of a word: 1000 * ln(2^64), and largest impact of a word in a document.
MOST_WEIGHT, MOST_IMPACT = 44_400, 1_000_000
#: Groups of tasks whose best documents are merged before those of all are.
MERGES = 64
_NO_ID = np.iinfo(np.int64).max

# A tile's sums are exact: whole numbers below 2^53, in whatever order BLAS adds them.
assert WORD_TILE * MOST_WEIGHT * MOST_IMPACT < 1 << 53

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

Batches = Iterator[pa.RecordBatch]


def _counted(vocabulary: dict[bytes, int]) -> Callable[[Batches], Batches]:
    """(doc_id, n, terms, tfs) of (doc_id, text): terms in the vocabulary's order of numbers."""

    def run(parts: Batches) -> Batches:
        for part in parts:
            lengths, terms, tfs = [], [], []
            for text in part.column(1):
                words = alnum_words(text.as_py())
                own = sorted((vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary)
                lengths.append(len(words))
                terms.append([t for t, _ in own])
                tfs.append([n for _, n in own])
            columns = [part.column(0), pa.array(lengths, pa.int64()), pa.array(terms, _COUNTS.field(2).type), pa.array(tfs, _COUNTS.field(3).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    return run


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each of tf occurrences in a document of n terms is worth, in whole numbers."""
    if len(n) and 50 * n_docs * int(n.max()) >= 1 << 63:
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _best(items: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `top` of each item by falling score and rising id."""
    order = np.lexsort((ids, -scores, items))
    items, ids, scores = items[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
    within = np.arange(len(items)) - np.repeat(starts, np.diff(np.r_[starts, len(items)]))
    kept = within < top
    return items[kept], ids[kept], scores[kept]


def _ranked(weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_items: int, n_words: int, n_docs: int, n_terms: int, top: int) -> Callable[[Batches], Batches]:
    """(item, doc_id, score): each item's best documents of a task. weights: for each tile of items (row, term, weight)."""

    def tile_scores(ids: np.ndarray, n: np.ndarray, place: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        impact = impacts(tfs, n[place], n_docs, n_terms).astype(np.float64)
        scores = np.zeros((n_items, len(ids)), np.int64)
        for low in range(0, n_words, WORD_TILE):
            here = (terms >= low) & (terms < low + WORD_TILE)
            if not here.any():
                continue
            used, row = np.unique(terms[here], return_inverse=True)
            dense = np.zeros((len(used), len(ids)))
            dense[row, place[here]] = impact[here]
            for k, (rows, words, values) in enumerate(weights):
                at = np.minimum(np.searchsorted(used, words), len(used) - 1)
                fits = used[at] == words
                block = np.zeros((min(ITEM_TILE, n_items - k * ITEM_TILE), len(used)))
                block[rows[fits], at[fits]] = values[fits]
                scores[k * ITEM_TILE : k * ITEM_TILE + len(block)] += (block @ dense).astype(np.int64)
        return scores

    def run(parts: Batches) -> Batches:
        bar = np.ones(n_items, np.int64)  # no lower score of an item can still be among its best
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for part in parts:
            every = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            n = part.column(1).to_numpy(zero_copy_only=False)
            for low in range(0, part.num_rows, DOCUMENT_TILE):
                tile = part.slice(low, DOCUMENT_TILE)
                ids = every[low : low + DOCUMENT_TILE]
                terms, tfs = (tile.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                sizes = tile.column(2).value_lengths().to_numpy(zero_copy_only=False)
                scores = tile_scores(ids, n[low : low + DOCUMENT_TILE], np.repeat(np.arange(len(ids)), sizes), terms, tfs)
                if len(ids) > top:  # ties with the last of the best stay until ids decide
                    bar = np.maximum(bar, np.partition(scores, len(ids) - top, axis=1)[:, len(ids) - top])
                rows, at = np.nonzero(scores >= bar[:, None])
                kept = tuple(np.concatenate(x) for x in zip(kept, (rows, ids[at], scores[rows, at]), strict=True))
                kept = _best(*kept, top)
                counts = np.bincount(kept[0], minlength=n_items)
                full = counts >= top
                bar[full] = np.maximum(bar[full], kept[2][np.cumsum(counts)[full] - 1])
        if len(kept[0]):
            ids = pa.array(kept[1], pa.int64(), mask=kept[1] == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), ids, pa.array(kept[2], pa.int64())], schema=_FOUND)

    return run


def _first(found: DataFrame, keys: list[str | Column], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _searched(docs: DataFrame, items: list[tuple[object, str | None]], top: int) -> DataFrame:
    """(item int, doc_id, score, rank) for items whose vocabulary may be broadcast."""
    words = [sorted(set(alnum_words(text))) for _, text in items]
    vocabulary = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
    empty = docs.sparkSession.createDataFrame([], "item int, doc_id long, score long, rank int")
    if not vocabulary:
        return empty
    counted = stored(docs.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), "term-counts")
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"] or 0
    if not n_docs:
        return empty
    df = np.zeros(len(vocabulary), np.int64)  # one number for each word of the items
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    tiles = []
    for low in range(0, len(items), ITEM_TILE):
        pairs = [(k, vocabulary[w]) for k, own in enumerate(words[low : low + ITEM_TILE]) for w in own]
        rows, terms = np.array(pairs, np.int64).reshape(-1, 2).T
        tiles.append((rows, terms, weight[terms].astype(np.float64)))
    rank = _ranked(tiles, len(items), len(vocabulary), n_docs, n_terms, top)
    found = counted.where(F.size("terms") > 0).mapInArrow(rank, "item int, doc_id long, score long")
    # Tasks' best are merged in MERGES groups first, so that no task takes those of all tasks.
    some = _first(found.withColumn("merge", F.spark_partition_id() % MERGES), ["item", "merge"], top)
    return _first(some.select("item", "doc_id", "score"), ["item"], top)


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank int, doc_id, score long): each item's `top` documents of the highest score above 0.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased. Equal scores go by
    rising id, null ids last; rows that repeat an id stand for themselves. Null and empty texts have no words: such a
    document is not found and does not count, such an item finds nothing. An item that repeats an id has a ranking of its own
    under that id. Empty tables give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    wanted = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // GROUP_BYTES) or 1
    part, found = free_name(wanted, "part"), None
    dealt = wanted.withColumn(part, F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    for k in range(groups):
        own = [(r[0], r[1]) for r in dealt.where(F.col(part) == k).select("item_id", "text").collect()]
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(own)], f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
        ranked = _searched(rows, own, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return found
