"""Phrase collocations by vertical partitioning of the texts' suffixes.

A suffix is what begins at a word, cut off after the longest phrase's words and at the end of its piece. Suffixes are dealt
into groups by their first words: prefixes with more suffixes than a group's memory budget are lengthened by a word until
they fit, and short prefixes share a group. Each group builds its own subtree from its sorted suffixes, whose nodes' counts are
the totals of the leaves below them; only a prefix that was lengthened is added up over groups.

Suffixes that no frequent phrase begins are cut before they are dealt: tables of hashed runs of words, which are never too low,
show which runs may reach the least count, and a run may only if those within it may.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import stored, utf8

#: Words of the longest phrase, and so the depth of the subtrees.
DEPTH = 4
#: Suffixes, counted once for each batch of texts, that a group holds on average at most, while groups are fewer than MOST_GROUPS.
GROUP_ROWS = 200_000
#: Most groups, each a partition of its own. Beyond, groups grow, and their sort spills.
MOST_GROUPS = 20_000
#: Words of texts that are counted together, and different suffixes that a task adds up before they leave it.
BATCH_WORDS, HELD_SUFFIXES = 1_000_000, 1_500_000
#: Hash buckets for runs of words: about as many as there are words, between these powers of two. The bits are broadcast (64 MB).
LEAST_BITS, MOST_BITS = 16, 29
#: One in so many texts shows how suffixes fall to prefixes. This decides how they are dealt, not what is counted.
SHOWN = 16
#: Parts of the buckets; each is added up on its own.
RANGES = 256
_WORDS = [f"w{k}" for k in range(1, DEPTH + 1)]

#: Ends of pieces become line feeds, tabs become spaces, A-Z become a-z.
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 0x0A
_TABLE[0x09] = 0x20
for _c in range(0x41, 0x5B):
    _TABLE[_c] += 32
_TABLE = bytes(_TABLE)

Batches = Iterator[pa.RecordBatch]


def pieces(text: str | None) -> list[list[bytes]]:
    """Words of each piece of a text, without pieces that have none."""
    return [words for piece in utf8(text).translate(_TABLE).split(b"\n") if (words := [w for w in piece.split(b" ") if w])]


class _Numbers(dict):
    """Words' numbers from 1, in the order that they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) + 1
        return found


def _chunks(parts: Batches) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(lang, words, numbers): texts of one language as numbers of words, 0 between pieces, BATCH_WORDS or so at a time."""
    held: dict[str, tuple[_Numbers, list[np.ndarray], list[int]]] = {}

    def done(lang: str) -> tuple[str, list[bytes], np.ndarray]:
        numbers, arrays, _ = held.pop(lang)
        return lang, list(numbers), np.concatenate(arrays)

    for part in parts:
        for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            numbers, arrays, size = held.setdefault(lang, (_Numbers(), [], [0]))
            flat: list[int] = []
            for words in pieces(text.as_py()):
                flat += map(numbers.__getitem__, words)
                flat.append(0)
            arrays.append(np.array(flat, np.int64))
            size[0] += len(flat)
            if size[0] >= BATCH_WORDS or len(arrays) >= 100_000:
                yield done(lang)
            elif len(held) > 8 and sum(s[0] for _, _, s in held.values()) >= 2 * BATCH_WORDS:
                yield done(max(held, key=lambda k: held[k][2][0]))
    for lang in list(held):
        yield done(lang)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """64-bit hashes by number, of a polynomial over the bytes; number 0 has 0."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.uint64)
    seed = np.uint64(int.from_bytes(utf8(lang)[:7], "little") + 1)
    sums = np.add.reduceat(_mixed(flat + (place << np.uint64(8)) + _mixed(np.array([seed]))), starts) if len(words) else np.zeros(0, np.uint64)
    return np.r_[np.uint64(0), _mixed(sums)]


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    return np.r_[x[k:], np.zeros(min(k, len(x)), x.dtype)]


def _runs(hashes: np.ndarray, at: np.ndarray, bits: int) -> list[np.ndarray]:
    """Buckets of the runs of 1 to DEPTH words that begin at each place."""
    own = hashes[at]
    so_far, out = own, []
    for k in range(DEPTH):
        if k:
            so_far = _mixed(so_far * np.uint64(3) + _ahead(own, k))
        out.append((so_far >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _may(flags: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (flags[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8) & 1).astype(bool)


def _short(at: np.ndarray, runs: list[np.ndarray], flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where a word, and where a pair of words of one piece, begins that may be frequent."""
    words, pairs = at > 0, (at > 0) & (_ahead(at, 1) > 0)
    return (words, pairs) if flags is None else (words & _may(flags, runs[0]), pairs & _may(flags, runs[1]))


def _long(pairs: np.ndarray, runs: list[np.ndarray], flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where three, and where four words begin that may be frequent, by the pairs that may."""
    three = pairs & _ahead(pairs, 1)
    if flags is not None:
        three &= _may(flags, runs[2])
    four = three & _ahead(three, 1)
    return three, four if flags is None else four & _may(flags, runs[3])


_PACKED = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("data", pa.binary())])


def _packed(used: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers as differences, and their counts."""
    return pa.compress(np.diff(used, prepend=0).astype(np.uint32).tobytes() + counts.tobytes(), codec="zstd", asbytes=True)


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = pa.decompress(data, decompressed_size=5 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(plain, np.uint32, n).astype(np.int64)), np.frombuffer(plain, np.uint8, n, 4 * n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)


def _hashed_counts(bits: int, least: int, short: bytes | None = None) -> Callable[[Batches], Batches]:
    """(range, lang, n, data): for each part of the buckets the n in use with their counts (`least` at most). Without `short`
    the buckets are those of words and pairs, and there are, with range -1, the numbers of words of the languages; with the
    bits of these, those of longer runs."""
    width = (1 << bits) // RANGES
    most = min(least, 255)

    def run(parts: Batches) -> Batches:
        flags = None if short is None else np.frombuffer(short, np.uint8)
        for lang, words, at in _chunks(parts):
            runs = _runs(_hashes(lang, words), at, bits)
            begins = _short(at, runs, flags)
            places = list(zip(runs[:2], begins, strict=True)) if flags is None else list(zip(runs[2:], _long(begins[1], runs, None), strict=True))
            used, counts = np.unique(np.concatenate([buckets[here] for buckets, here in places]), return_counts=True)
            counts = np.minimum(counts, most).astype(np.uint8)
            cuts = np.searchsorted(used, np.arange(RANGES + 1) * width)
            rows = [(r, None, int(b - a), _packed(used[a:b] % width, counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            if flags is None:
                rows.append((-1, lang, int((at > 0).sum()), None))
            if rows:
                yield _batch(rows)

    return run


def _frequent_bits(bits: int, least: int) -> Callable[[Batches], Batches]:
    """(range, lang, n, data): a bit for each bucket, set where the counts add up to `least`, or to 255 if that is less. Rows of
    languages stay as they are."""
    width = (1 << bits) // RANGES

    def run(parts: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        rows = []
        for part in parts:
            for r, lang, n, data in zip(*[part.column(k).to_pylist() for k in range(4)], strict=True):
                if r < 0:
                    rows.append((r, lang, n, None))
                    continue
                at, counts = _unpacked(n, data)  # buckets in a row differ
                total = sums.setdefault(r, np.zeros(width, np.uint16))
                total[at] = np.minimum(total[at] + counts, 1000)
        rows += [(r, None, None, np.packbits(total >= min(least, 255)).tobytes()) for r, total in sums.items()]
        if rows:
            yield _batch(rows)

    return run


_SUFFIXES = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in _WORDS], ("n", pa.int64()), ("deep", pa.int32()), ("part", pa.int32())])
_SUFFIX_KIND = ", ".join(["lang string", *[f"{w} string" for w in _WORDS], "n long", "deep int", "part int"])
#: Prefixes that are lengthened, as (language, words), by their number of words.
Prefixes = list[set[tuple]]


class _Held:
    """Suffixes of one language as numbers of words that hold for a task, with their counts; added up when there are twice as
    many as there were."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.last = 0

    def add(self, halves: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((*halves, counts))
        self.size += len(counts)
        if self.size > 2 * self.last:
            self.merge()

    def merge(self) -> None:
        first, second, counts = map(np.concatenate, zip(*self.parts, strict=True))
        order = np.lexsort((second, first))
        first, second, counts = first[order], second[order], counts[order]
        starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        self.parts = [(first[starts], second[starts], np.add.reduceat(counts, starts))]
        self.size = self.last = len(starts)

    def _deep(self, lang: str, first: np.ndarray, second: np.ndarray, large: Prefixes) -> np.ndarray:
        """The words of each suffix's prefix."""
        own = [[tuple(map(self.numbers.get, p[1:])) for p in some if p[0] == lang] for some in large]
        known = [sorted(p for p in some if None not in p) for some in own]
        deep = np.ones(len(first), np.int64)
        if known and known[0]:
            deep += np.isin(first >> 32, [a for (a,) in known[0]])
        if len(known) > 1 and known[1]:
            pairs = np.array([a << 32 | b for a, b in known[1]], np.int64)
            deep += np.isin(first, pairs)
            if len(known) > 2 and known[2]:
                place = np.minimum(np.searchsorted(pairs, first), len(pairs) - 1)
                at = {p: k for k, p in enumerate(pairs.tolist())}
                three = [at[a << 32 | b] << 32 | c for a, b, c in known[2] if a << 32 | b in at]
                deep += (pairs[place] == first) & np.isin(place << 32 | second >> 32, three)
        return deep

    def rows(self, lang: str, large: Prefixes, groups: int) -> Batches:
        self.merge()
        first, second, counts = self.parts[0]
        deep = self._deep(lang, first, second, large)
        names, hashes = np.array([None, *self.numbers], object), _hashes(lang, list(self.numbers))
        numbers = [first >> 32, first & 0xFFFFFFFF, second >> 32, second & 0xFFFFFFFF]
        prefix = np.zeros(len(first), np.uint64)
        for k, own in enumerate(numbers):
            prefix = np.where(deep > k, _mixed(prefix * np.uint64(3) + hashes[own]), prefix)
        part = (prefix % np.uint64(groups)).astype(np.int32)
        for low in range(0, len(counts), 65536):
            cut = slice(low, low + 65536)
            words = [pa.array(names[own[cut]].tolist(), pa.string()) for own in numbers]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts[cut]), pa.string()), *words, pa.array(counts[cut], pa.int64()), pa.array(deep[cut], pa.int32()), pa.array(part[cut], pa.int32())], schema=_SUFFIXES)


def _suffixes(bits: int, short: bytes, long: bytes, large: Prefixes, groups: int) -> Callable[[Batches], Batches]:
    """(lang, w1 to w4, n, deep, part): suffixes as long as they may be frequent, with how often a task has them, or a part of one
    that has very many; deep is how many words their group's prefix has, and part the group."""

    def run(parts: Batches) -> Batches:
        flags = [np.frombuffer(x, np.uint8) for x in (short, long)]
        held: dict[str, _Held] = {}
        for lang, words, at in _chunks(parts):
            runs = _runs(_hashes(lang, words), at, bits)
            begins, pairs = _short(at, runs, flags[0])
            if not begins.any():
                continue
            own = held.setdefault(lang, _Held())
            # Of words that are in suffixes, the numbers that hold for the task.
            used = np.unique(at[begins])
            numbers = np.zeros(len(words) + 1, np.int64)
            numbers[used] = [own.numbers[words[k - 1]] for k in used.tolist()]
            lasting = numbers[at]
            reached = [pairs, *_long(pairs, runs, flags[1])]
            columns = [lasting[begins], *[np.where(going, _ahead(lasting, k), 0)[begins] for k, going in enumerate(reached, 1)]]
            # Numbers of halves make a whole number of each suffix.
            halves = [np.unique(columns[k] << 32 | columns[k + 1], return_inverse=True) for k in (0, 2)]
            whole, counts = np.unique(halves[0][1] << 32 | halves[1][1], return_counts=True)
            own.add(np.array([halves[0][0][whole >> 32], halves[1][0][whole & 0xFFFFFFFF]]), counts)
            if sum(x.size for x in held.values()) > HELD_SUFFIXES:
                most = max(held, key=lambda k: held[k].size)
                yield from held.pop(most).rows(most, large, groups)
        for lang, own in held.items():
            yield from own.rows(lang, large, groups)

    return run


_NODES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _subtrees(least: int) -> Callable[[Batches], Batches]:
    """(lang, phrase, words, n) of (lang, w1 to w4, n, deep), sorted: the nodes of the groups' subtrees.

    Suffixes come in the order of the tree, so the leaves below a node are a run of rows, and its count is their total; of
    each depth only the node whose run goes on into the next batch is held. A node that is less deep than its group's prefix has
    leaves in other groups too and is given whatever its count; others where they have `least`."""

    def run(parts: Batches) -> Batches:
        held: list[tuple[list[str | None], int, int] | None] = [None] * DEPTH  # of each depth: language and words, count, deep

        def node(depth: int, key: list[str | None], n: int, deep: int) -> list[tuple]:
            return [(key[0], " ".join(key[1:]), depth, n)] if key[-1] is not None and (n >= least or depth < deep) else []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)

        for part in parts:
            if not part.num_rows:
                continue
            n, below = (part.column(DEPTH + k).to_numpy(zero_copy_only=False) for k in (1, 2))
            changed = np.zeros(part.num_rows, bool)
            changed[0] = True
            out: list[tuple] = []
            for depth in range(DEPTH + 1):
                codes = part.column(depth).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
                if not depth:
                    continue
                starts = np.flatnonzero(changed)
                sums = np.add.reduceat(n, starts)
                first, last = ([part.column(k)[int(at)].as_py() for k in range(depth + 1)] for at in (0, starts[-1]))
                if (before := held[depth - 1]) is not None:
                    if before[0] == first:
                        sums[0] += before[1]
                    else:
                        out += node(depth, *before)
                held[depth - 1] = (last, int(sums[-1]), int(below[starts[-1]]))
                wanted = (codes[starts] >= 0) & ((sums >= least) | (below[starts] > depth))
                wanted[-1] = False
                rows = pa.array(starts[wanted])
                columns = [part.column(k).take(rows).to_pylist() for k in range(depth + 1)]
                out += zip(columns[0], map(" ".join, zip(*columns[1:], strict=True)), [depth] * len(rows), sums[wanted].tolist(), strict=True)
            if out:
                yield batch(out)
        if out := [x for depth, last in enumerate(held, 1) if last is not None for x in node(depth, *last)]:
            yield batch(out)

    return run


def _prefixes(shown: DataFrame, share: int, group_rows: int) -> tuple[Prefixes, int]:
    """(prefixes that are lengthened, number of groups). shown: one in `share` suffixes. A prefix of more than an eighth of a
    group's rows is lengthened; there are fewer than 4 * MOST_GROUPS of a length, which come to the driver."""
    total = share * shown.count()
    group_rows = max(group_rows, 2 * total // MOST_GROUPS)
    large: Prefixes = []
    for k in range(1, DEPTH):
        keys = ["lang", *_WORDS[:k]]
        rows = shown.where(F.col(_WORDS[k - 1]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") * share > group_rows / 8)
        large.append({(r[0], *(w.encode() for w in r[1:])) for r in rows.select(*keys).collect()})
        if not large[-1]:
            break
    return large, max(1, -(-2 * total // group_rows))


def phrase_counts(texts: DataFrame, least: int = 30, group_rows: int = GROUP_ROWS, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n), (lang, n)): phrases of up to DEPTH words that occur `least` times, stored, and how many
    words each language has. texts: (lang, text)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, most_bits, (size // 8).bit_length()))
    width = (1 << bits) // RANGES // 8

    kind = "range int, lang string, n long, data binary"

    def counted(short: bytes | None) -> DataFrame:
        packed = texts.mapInArrow(_hashed_counts(bits, least, short), kind)
        return stored(packed.repartition(RANGES, "range").mapInArrow(_frequent_bits(bits, least), kind), "frequent-runs")

    def frequent(found: DataFrame) -> bytes:
        whole = bytearray(1 << bits >> 3)  # 64 MB at most
        for r, data in found.where("range >= 0").select("range", "data").collect():
            whole[r * width : r * width + len(data)] = data
        return bytes(whole)

    found = counted(None)
    words = found.where("range < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    short = frequent(found)
    long = frequent(counted(short))
    shown = texts.where(F.pmod(F.xxhash64("text"), F.lit(SHOWN)) == 0).mapInArrow(_suffixes(bits, short, long, [], 1), _SUFFIX_KIND)
    large, groups = _prefixes(stored(shown, "shown"), SHOWN, group_rows)
    suffixes = texts.mapInArrow(_suffixes(bits, short, long, large, groups), _SUFFIX_KIND)
    ordered = suffixes.repartition(groups, "part").sortWithinPartitions("part", "lang", *_WORDS).select("lang", *_WORDS, "n", "deep")
    nodes = ordered.mapInArrow(_subtrees(least), "lang string, phrase string, words int, n long")
    counts = nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stored(counts, "phrases"), words


def collocations(docs: DataFrame, least: int = 30, covered_percent: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", group_rows: int = GROUP_ROWS, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to 4 words.

    Texts are lower-cased in A-Z, cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs.
    a is how often the phrase occurs within pieces, `least` times or more; l and r are the counts of its first words and of the
    rest at the cut of the lowest score, 2,000,000 * a / (l + r) rounded down, and of equal ones after the fewest words. A
    phrase within a longer one that has covered_percent of its count is left out. n is the number of words of the language. Order:
    score and a falling, then phrase. Null texts are empty, a null language is `und`, languages without words and empty tables
    give no rows. Repeated rows count each; other columns are not looked at.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") > 0)
    counts, words = phrase_counts(texts, least, group_rows, most_bits)
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    # Each cut of a phrase meets the counts of its two parts; both are frequent, as the phrase is.
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("*", k)
    split = F.split("phrase", " ")
    sides = cuts.select("*", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    scored = sides.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    lowest = scored.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.first("a").alias("a"))
    # Longer candidates tell the phrases within them how frequent they are.
    within = [F.struct(F.lit(i).alias("i"), F.lit(n).alias("m")) for n in range(2, DEPTH) for i in range(1, DEPTH - n + 2)]
    inner = candidates.where("words > 2").select("lang", "words", F.col("a").alias("longer"), split.alias("w"), F.explode(F.array(*within)).alias("at")).where("at.m < words and at.i + at.m - 1 <= words")
    cover = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at.i"), F.col("at.m")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = lowest.join(cover, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first of each of some parts, and of these the first of all, so that no task orders all of a language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = rows.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
