"""Near-duplicate detection by MinHash with odd sketches.

Documents become sets of word shingles. Bands of MinHash samples propose pairs; each document also folds its samples into
a parity bitmap, an odd sketch, and the population count of two sketches' XOR estimates how many samples differ (Mitzenmacher,
Pagh and Pham 2014). Pairs that the sketches don't rule out are confirmed on the full sets.

Equal sets are one node from the start. In a bucket of a band each node is first compared with the smallest one only. What
that links is contracted, and only buckets that still hold more than one component are searched for pairs across
components. So no bucket's pairs are all emitted, and links that decide nothing are not looked for.

Sets are known by 64-bit hashes of their shingles, and nodes by 128-bit hashes of these; neither is cryptographic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import batches, components, free_name, join_hot_apart, quoted, space_words, stored

#: A similarity s is missed with probability (1 - s**ROWS)**BANDS: 2e-8 at 0.85, 3e-6 at 0.8.
BANDS, ROWS = 24, 4
#: Bits of an odd sketch, in words of 64.
SKETCH_WORDS = 8
#: How far below the threshold a sketch's estimate may be; over six standard deviations.
SLACK = 0.25
#: Nodes of one bucket that one task compares with as many others.
BLOCK = 256
#: Buckets of at most so many nodes are searched by a join.
FEW = 16

_SIGNED = pa.schema([
    ("id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
])
_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all shingles, repeated ones too; with fewer words than size, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for i in range(min(size, len(words))):
        out = _mix(out + each[i : i + n])
    return out


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The full set itself."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _sign(size: int, bands: int, rows: int, sketch_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(11)
        k, bits = bands * rows, 64 * sketch_words
        mult = draw.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        plus = draw.integers(0, 1 << 63, k, np.uint64)

        def signed(ids: list[tuple[int | None, int]], sets: list[np.ndarray]) -> Iterator[tuple]:
            """Of documents that have shingles; the samples are taken for all of them at once."""
            flat = np.concatenate(sets)
            starts = np.cumsum([0, *map(len, sets)])[:-1]
            sample = np.empty((k, len(sets)), np.uint64)
            for j in range(k):
                sample[j] = np.minimum.reduceat(flat * mult[j] + plus[j], starts)
            keys = np.zeros((bands, len(sets)), np.uint64)
            for r in range(rows):
                keys = _mix(keys + sample[r::rows])
            keys = _mix(keys + np.arange(bands, dtype=np.uint64)[:, None])  # a key is of one band only
            places = (_mix(sample + np.arange(1, k + 1, dtype=np.uint64)[:, None]) % np.uint64(bits)).astype(np.int64)
            counts = np.bincount((places + bits * np.arange(len(sets))[None, :]).ravel(), minlength=bits * len(sets))
            sketch = np.packbits((counts & 1).astype(np.uint8).reshape(len(sets), bits), axis=1, bitorder="little").view(np.int64)
            for d, (i, key) in enumerate(ids):
                yield i, key, len(sets[d]), xxhash.xxh3_128_digest(sets[d].tobytes()), keys[:, d].view(np.int64).tolist(), sketch[d].tolist()

        def out() -> Iterator[tuple]:
            for part in parts:
                ids: list[tuple[int | None, int]] = []
                sets: list[np.ndarray] = []
                held = 0
                for i, text, key in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    own = np.unique(shingle_hashes(space_words(text.as_py()), size))
                    if not len(own):
                        yield i, key, 0, None, None, None
                        continue
                    ids.append((i, key))
                    sets.append(own)
                    held += len(own)
                    if held > 100_000:  # so that the arrays stay in the processor's cache
                        yield from signed(ids, sets)
                        ids, sets, held = [], [], 0
                if sets:
                    yield from signed(ids, sets)

        yield from batches(out(), _SIGNED)

    return run


def _confirm(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of (a, b, text_a, text_b) whose full sets are similar; in whole numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, own = None, set()
            for part in parts:
                for a, b, text_a, text_b in zip(*(part.column(c) for c in range(4)), strict=True):
                    a = a.as_py()
                    if a != last:
                        last, own = a, shingles(space_words(text_a.as_py()), size)
                    other = shingles(space_words(text_b.as_py()), size)
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        yield a, b.as_py()

        yield from batches(rows(), _EDGES)

    return run


def _sift(percent: int, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From a cell's (band, i, j, node, root, own, n_shingles, sketch): the nodes that may be linked with one of another root
    in it, by the population counts of the sketches' XOR and the sets' sizes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, roots = rows["own"].to_numpy(), pd.factorize(rows["root"])[0]
        left, right = np.flatnonzero(own == rows["i"].iloc[0]), np.flatnonzero(own == rows["j"].iloc[0])
        sketches = np.stack(rows["sketch"].to_list()).view(np.uint64)
        counts = rows["n_shingles"].to_numpy()
        kept = np.zeros(len(rows), bool)
        for x in left:  # a row of the cell at a time
            small, large = np.minimum(counts[x], counts[right]), np.maximum(counts[x], counts[right])
            differ = np.bitwise_count(sketches[x] ^ sketches[right]).sum(1, dtype=np.int64)
            partners = right[(differ <= most) & (100 * small >= percent * large) & (roots[right] != roots[x])]
            kept[partners] = True
            kept[x] |= len(partners) > 0
        return rows.loc[kept, ["band", "i", "j", "node", "root", "own"]]

    return run


def _cell(size: int, percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From a cell's (i, j, own, node, root, text): linked pairs that join components, one for each joining at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(space_words(t), size)) for t in rows["text"]]
        own, i, j = rows["own"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        counts = np.array([len(x) for x in sets])
        both = common_counts(sets, left, right)
        linked = 100 * both >= percent * (counts[left][:, None] + counts[right][None, :] - both)
        nodes, roots = rows["node"].tolist(), rows["root"].tolist()
        parent = {r: r for r in roots}

        def find(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            a, b = left[x], right[y]
            if (ra := find(roots[a])) != (rb := find(roots[b])):
                parent[max(ra, rb)] = min(ra, rb)
                out.append((nodes[a], nodes[b]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of incidence matrices, some columns at a time."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1 if len(left) != len(right) or (left != right).any() else n > 0
    renamed = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], renamed[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, int(shared.sum()), columns):
        part = slice(*np.searchsorted(column, [begin, begin + columns]))
        matrix = np.zeros((len(sets), columns), np.float32)
        matrix[owner[part], column[part] - begin] = 1
        out += (matrix[left] @ matrix[right].T).astype(np.int64)
    return out


def most_differing(threshold: float, samples: int, bits: int, slack: float = SLACK) -> int:
    """The largest XOR population count at which the estimated similarity is threshold - slack or more.

    d differing samples toggle 2 d places, which leave bits / 2 * (1 - (1 - 2 / bits) ** (2 d)) of them odd on average.
    """
    differing = samples * (1 - max(0.0, threshold - slack))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * differing)))


def _plausible(a: str, b: str, percent: int, most: int) -> Column:
    """The sizes allow the similarity, and the sketches don't rule it out."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    differ = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    return (100 * small >= percent * large) & (differ <= most)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 5, bands: int = BANDS, rows: int = ROWS,
    sketch_words: int = SKETCH_WORDS, block: int = BLOCK, few_members: int = FEW,
) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_key), a row for each row of docs; text_key is xxhash64 of the text.

    Sets: distinct shingles of `size` words of the text after lower-casing A-Z; with fewer words the whole sequence is
    one. Documents are linked when 100 * intersection >= percent * union of their full sets. component_id is the smallest
    id reachable, kept whether it is the row's own. Null and empty texts have no shingles and are linked with nothing.
    Rows that repeat an id and text get the same result. A null id counts as larger than any other. An empty table gives
    no rows. Other columns are not read. A pair at the threshold is missed with the probability given at BANDS.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sign = _sign(size, bands, rows, sketch_words)
    signed = stored(texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(sign, "id long, text_key long, n_shingles long, node binary, bands array<long>, sketch array<long>"), "signatures")
    full = signed.where("node is not null")
    # Rows of one node have equal bands and sketches; they are combined before the shuffle.
    chosen = full.groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
    nodes = stored(full.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n_rows")), "nodes")
    banded = chosen.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(banded.join(shared, "band"), "buckets")
    wanted = buckets.select("node").distinct()
    sketches = stored(chosen.select("node", "id", "n_shingles", "sketch").join(wanted, "node", "left_semi"), "sketches")
    # One text for each node of a bucket that is shared; the digest guards against ids that repeat with another text.
    found = texts.join(sketches.select("id").distinct(), texts["id"].eqNullSafe(sketches["id"]), "left_semi")
    candidates = stored(found.mapInArrow(_nodes(size), "node binary, text string").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "candidates")
    most = most_differing(percent / 100, bands * rows, 64 * sketch_words)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = candidates.select(F.col("node").alias("a"), F.col("text").alias("text_a")), candidates.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a binary, b binary")

    stars = buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    x, y = sketches.select(F.col("node").alias("a"), F.struct("n_shingles", "sketch").alias("x")), sketches.select(F.col("node").alias("b"), F.struct("n_shingles", "sketch").alias("y"))
    near = stored(confirmed(stars.join(x, "a").join(y, "b").where(_plausible("x", "y", percent, most)).select("a", "b")), "links")
    roots = components(near)

    # Buckets that are still of more than one component: pairs across them.
    placed = buckets.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high").select("band", "members")
    contested = placed.join(mixed, "band").join(sketches.select("node", "n_shingles", "sketch"), "node")
    # Small buckets: pairs that the sketches allow, confirmed like those of the stars.
    few = contested.where(F.col("members") <= few_members).select("band", "node", "root", F.struct("n_shingles", "sketch").alias("s"))
    left = few.select("band", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("s").alias("x"))
    right = few.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("s").alias("y"))
    across = left.join(right, "band").where("root_a <> root_b and a < b").where(_plausible("x", "y", percent, most)).select("a", "b").distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = across.join(tried, ["a", "b"], "left_anti")
    # Large buckets: cells of two blocks. Sketches alone are dealt first; only nodes that they leave a partner in a cell
    # bring their text to it, where full sets are compared without listing the pairs.
    many = contested.where(F.col("members") > few_members).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "own", "n_shingles", "sketch")
    left_over = cells.groupBy("band", "i", "j").applyInPandas(_sift(percent, most), "band long, i int, j int, node binary, root binary, own int")
    within = left_over.join(candidates, "node").groupBy("band", "i", "j").applyInPandas(_cell(size, percent), "a binary, b binary").distinct()
    links = stored(near.unionByName(confirmed(fresh)).unionByName(within), "links")
    roots = components(links)

    lowest = nodes.join(roots, "node").groupBy("root").agg(F.min("first").alias("least"))
    least = roots.join(lowest, "root").select("node", "least")
    known = stored(nodes.join(least, "node", "left").select("node", "n_rows", F.coalesce("least", "first").alias("component_id")), "components")
    alone = signed.where("node is null").withColumn("component_id", F.col("id"))
    result = join_hot_apart(full.select("id", "text_key", "n_shingles", "node"), known, "node", "n_rows").unionByName(alone, allowMissingColumns=True)
    return result.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def _nodes(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, text) of (id, text) that have shingles."""
    schema = pa.schema([("node", pa.binary()), ("text", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for text in part.column(1):
                    text = text.as_py()
                    if len(own := np.unique(shingle_hashes(space_words(text), size))):
                        yield xxhash.xxh3_128_digest(own.tobytes()), text

        yield from batches(rows(), schema)

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, **options: int) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group of near-duplicates the one with the smallest id.

    Rows that repeat a kept id and text stay once. Null ids: rows whose group has no other id all stay, unless they
    repeat the text.
    """
    own, key, times = (free_name(docs, n) for n in ("kept_id", "kept_key", "times"))
    rows = near_groups(docs, id_col, text_col, percent, **options).where("kept").groupBy(F.col("id").alias(own), F.col("text_key").alias(key)).agg(F.count("*").alias(times))
    joined = docs.join(rows, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(key)))
    # Only rows that repeat need another look.
    again = joined.where(F.col(times) > 1).dropDuplicates([id_col, text_col])
    return joined.where(F.col(times) == 1).unionByName(again).select(*quoted(docs.columns))
