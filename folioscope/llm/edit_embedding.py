"""Fingerprints by a randomised edit embedding (Chakraborty, Goldenberg and Koucky, 2016).

A walk over a text's characters writes down, at each step, the character that it stands at and then stays or goes on by one, as
a random function of the step and the character says. All texts share that function, so texts that differ by few edits are
written alike but for a few steps: edit distance becomes Hamming distance. A fingerprint holds the written characters of
SAMPLES steps from each doubling of the number of steps, the same steps for all texts; runs of them are the bands by
which near texts meet, and an exact edit distance decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import batches, stored

#: Steps that are sampled of each doubling, and the classes of characters, a power of two.
SAMPLES, CLASSES = 32, 64
#: Doublings: 2^36 steps are more than any text has.
LEVELS = 36
#: Samples in a band.
BAND = 4
#: Edit similarity from which on texts are near.
LEAST = 0.8
#: Characters and rows that are walked together; rows of which few are left are walked one by one.
WALK_CHARS, WALK_ROWS, FEW_ROWS = 16 << 20, 8192, 24
#: Steps between looks at which rows have ended.
STRIDE = 512
#: Bytes of text in a part of the ordered rows, on average, while parts are fewer than MOST_PARTS.
PART_BYTES, MOST_PARTS = 4 << 20, 10_000
#: Ids for each part, or so, that a hash draws to find the parts' bounds.
DRAWN = 64
#: What a sample of each class is written as.
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_SEED = 0x5EED

Batches = Iterator[pa.RecordBatch]


def sampled_steps() -> list[np.ndarray]:
    """Steps of each level in rising order: level k has steps 2^k - 1 to 2^(k+1) - 2, all of them where these are no more than SAMPLES."""
    draw = np.random.default_rng(_SEED)
    out = []
    for k in range(LEVELS):
        first, width = (1 << k) - 1, 1 << k
        out.append(first + (np.arange(width) if width <= SAMPLES else np.sort(draw.integers(0, width // SAMPLES, SAMPLES) + np.arange(SAMPLES) * (width // SAMPLES))))
    return out


_STEPS = np.concatenate(sampled_steps())
#: Of each sample, the steps that it stands for.
_SHARE = np.concatenate([np.full(len(s), (1 << k) / len(s)) for k, s in enumerate(sampled_steps())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _moves(first: int, last: int) -> np.ndarray:
    """Of each step a bit for each class: whether the walk goes on."""
    return _mixed(np.arange(first, last, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_SEED))


def classes(text: str) -> np.ndarray:
    """Classes of the characters (code points)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return (_mixed(points + np.uint64(_SEED)) >> np.uint64(58)).astype(np.uint8)


def _walk_one(text: np.ndarray, at: int, step: int, known: list[int]) -> bytes:
    """The rest of a text's samples, from a place and a step on; known are the moves from that step on, and are added to."""
    chars, end, first = text.tolist(), len(text), step
    out = bytearray()
    for wanted in _STEPS[np.searchsorted(_STEPS, step) :].tolist():
        while len(known) <= wanted - first:
            known += _moves(first + len(known), first + len(known) + 65536).tolist()
        for move in known[step - first : wanted - first]:
            if at >= end:
                return bytes(out)
            at += move >> chars[at] & 1
        if at >= end:
            return bytes(out)
        out.append(SYMBOLS[chars[at]])
        step = wanted
    return bytes(out)


def walk(texts: list[np.ndarray]) -> list[bytes]:
    """Fingerprints of texts given as classes: samples up to the end of the walk."""
    out: list[bytes] = [b""] * len(texts)
    live = np.array(sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: len(texts[i])), np.int64)
    written: list[list[bytes]] = [[] for _ in texts]
    if len(live) > FEW_ROWS:
        # An end is a class of its own, from which no move goes on.
        flat = np.concatenate([x for i in live for x in (texts[i], [CLASSES])]).astype(np.uint8)
        sizes = np.array([len(texts[i]) for i in live])
        starts = np.cumsum(sizes + 1) - sizes - 1
        at, ends = starts.copy(), starts + sizes
    step = 0
    symbol = np.frombuffer(SYMBOLS + b"\0", np.uint8)
    while len(live) > FEW_ROWS:
        moves = (_moves(step, step + STRIDE)[:, None] >> np.arange(CLASSES, dtype=np.uint64) & np.uint64(1)).astype(np.int64)
        moves = np.c_[moves, np.zeros(STRIDE, np.int64)]
        wanted = set(_STEPS[np.searchsorted(_STEPS, step) : np.searchsorted(_STEPS, step + STRIDE)].tolist())
        seen = []
        for k, move in enumerate(moves, step):
            here = flat.take(at)
            if k in wanted:
                seen.append(symbol[here])
            at += move.take(here)
        step += STRIDE
        if seen:
            for i, row in zip(live.tolist(), np.array(seen).T, strict=True):
                written[i].append(row.tobytes())
        going = at < ends
        if not going.all():
            live, at, starts, ends = live[going], at[going], starts[going], ends[going]
    known: list[int] = []
    for n, i in enumerate(live.tolist()):
        begin = int(at[n] - starts[n]) if step else 0
        written[i].append(_walk_one(texts[i], begin, step, known))
    for i, parts in enumerate(written):
        out[i] = b"".join(parts).rstrip(b"\0")
    return out


def fingerprints(texts: list[str]) -> list[bytes]:
    """Fingerprints of texts, walked together in parts of bounded size."""
    out, rows, held = [], [], 0
    for text in texts:
        rows.append(classes(text))
        held += len(text)
        if held >= WALK_CHARS or len(rows) >= WALK_ROWS:
            out += walk(rows)
            rows, held = [], 0
    return out + walk(rows)


def likeness(a: bytes, b: bytes) -> float:
    """The estimated share of steps at which two texts are written alike, of the steps of the longer: 1 for equal fingerprints
    and for two empty ones, 0 for an empty one and another."""
    both, most = min(len(a), len(b)), max(len(a), len(b))
    if not most:
        return 1.0
    same = np.frombuffer(a, np.uint8, both) == np.frombuffer(b, np.uint8, both)
    return float(_SHARE[:both][same].sum() / _SHARE[:most].sum())


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def edited(text: str, following: str) -> str:
    """The text, its last half replaced by as many characters of the following one, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(parts: Batches) -> Iterator[tuple[int | None, str, str]]:
    """(id, text, next text) of rows (part, guest, id, text) in order; each part ends with a guest, the row after it."""
    last: tuple[int, int | None, str] | None = None
    for part in parts:
        for where, guest, i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
            text = text.as_py() or ""
            if last is not None and last[0] == where:
                yield last[1], last[2], text
            last = None if guest else (where, i, text)


def _prints(parts: Batches) -> Batches:
    def done(rows: list[tuple[int | None, str, str]]) -> Iterator[tuple]:
        new = [edited(text, after) for _, text, after in rows]
        # A row's next text is mostly the text of the row after it.
        tails = [after for k, (_, _, after) in enumerate(rows) if k + 1 == len(rows) or rows[k + 1][1] is not after]
        found = fingerprints([text for _, text, _ in rows] + new + tails)
        own, other, rest = found[: len(rows)], found[len(rows) : 2 * len(rows)], iter(found[2 * len(rows) :])
        for k, (i, text, after) in enumerate(rows):
            following = own[k + 1] if k + 1 < len(rows) and rows[k + 1][1] is after else next(rest)
            digest = hashlib.sha256(new[k].encode("utf-8", "surrogatepass")).hexdigest()
            yield i, len(text), digest, own[k].decode(), other[k].decode(), likeness(own[k], other[k]), likeness(own[k], following)

    def rows() -> Iterator[tuple]:
        kept, held = [], 0
        for row in _pairs(parts):
            kept.append(row)
            held += len(row[1])
            if 2 * held >= WALK_CHARS or 2 * len(kept) >= WALK_ROWS:
                yield from done(kept)
                kept, held = [], 0
        if kept:
            yield from done(kept)

    return batches(rows(), _ROW)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """((part, guest, doc_id, text), number of parts): rows in parts of falling ids, and at the end of each part, as a guest, the
    row that follows it; after the last part follows the first row of all."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n_rows, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, min(MOST_PARTS, n_rows, -(-(size or 0) // part_bytes)))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_rows // (DRAWN * n)))) == 0).select("doc_id").where("doc_id is not null")
    drawn = sorted((r[0] for r in some.collect()), reverse=True) if n > 1 else []  # some DRAWN * n ids
    bounds = sorted({drawn[k * len(drawn) // n] for k in range(1, n)} if drawn else set(), reverse=True)
    # A row's part is how many bounds are larger than its id: of every step-th one first, then of those up to the next.
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]

    def larger(of: Column) -> Column:
        return F.size(F.filter(of, lambda b: b > F.col("doc_id")))

    part: Column = F.lit(0)
    if bounds:
        block = F.greatest(larger(F.array(*[F.lit(b[0]) for b in blocks])), F.lit(1))
        part = (block - 1) * step + larger(F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(part).cast("int")
    dealt = rows.select(part.alias("part"), "doc_id", "text")
    own = dealt.select("part", F.lit(False).alias("guest"), "doc_id", "text")
    tops = sorted((r["part"], r["top"]) for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect())  # a number for each part
    if not tops:
        return own, 1
    # The first row of each part, the first of the rows of its largest id, is a guest of the part before.
    to = [(p, top, tops[k - 1][0]) for k, (p, top) in enumerate(tops)]
    table = rows.sparkSession.createDataFrame(to, "part int, top long, to int")
    first = dealt.join(F.broadcast(table), "part").where(F.col("doc_id").eqNullSafe(F.col("top")))
    order = F.coalesce("text", F.lit(""))
    guests = first.groupBy("to", "doc_id").agg(F.max(order).alias("text")).select(F.col("to").alias("part"), F.lit(True).alias("guest"), "doc_id", "text")
    return own.unionByName(guests), len(tops)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    The edited text is `edited` of a text and that of the next row of a falling id, after the last that of the first. Rows that
    repeat an id follow each other by their texts, falling; null ids come last. Null texts are empty; an empty text has an empty
    fingerprint. Equal texts have equal fingerprints. An empty table gives no rows; other columns are not looked at."""
    rows, n = with_next(docs, id_col, text_col, part_bytes)
    ordered = rows.repartition(n, "part").sortWithinPartitions("part", "guest", F.desc("doc_id"), F.desc(F.coalesce("text", F.lit(""))))
    return ordered.mapInArrow(_prints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_BANDED = pa.schema([("text_key", pa.string()), ("fingerprint", pa.string()), ("bands", pa.list_(pa.int64()))])


def bands(fingerprint: bytes) -> list[int]:
    """Keys of the runs of BAND samples from one level, beyond the levels that all steps of are sampled, each with its place."""
    whole = sum(1 << k for k in range(LEVELS) if 1 << k <= SAMPLES)
    begin = 0 if len(fingerprint) < whole + SAMPLES else whole
    cuts = range(begin, len(fingerprint) - BAND + 1, BAND)
    return [int.from_bytes(hashlib.blake2b(c.to_bytes(4, "little") + fingerprint[c : c + BAND], digest_size=8).digest(), "little", signed=True) for c in cuts] or [-len(fingerprint)]


def _banded(parts: Batches) -> Batches:
    for part in parts:
        keys = part.column(0).to_pylist()
        found = fingerprints([t.as_py() or "" for t in part.column(1)])
        for low in range(0, len(keys), 1024):
            cut = slice(low, low + 1024)
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut], pa.string()), pa.array([f.decode() for f in found[cut]], pa.string()), pa.array([bands(f) for f in found[cut]], pa.list_(pa.int64()))], schema=_BANDED)


def near_texts(docs: DataFrame, queries: DataFrame, least: float = LEAST, least_bands: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, distance int, similarity double): rows of docs near those of a stated set of queries.

    Texts are near when 1 - edit distance / longer length is `least` or more. Candidates share least_bands bands of a text's
    fingerprint, or one where it has fewer than eight; each is confirmed by its exact edit distance, bounded by what `least`
    allows. Equal texts are compared once and then stand for all their rows; a row is near itself. Null texts are empty, and
    empty ones near each other; null ids stay. The index is approximate: texts of few edits share most bands, and the tests
    measure its recall against brute force. Empty tables give no rows; other columns are not looked at."""
    def own(rows: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        return rows.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text.cast("binary"), 256).alias("text_key"), text.alias("text"))

    every, asked = stored(own(docs), "texts"), stored(own(queries), "queries")

    def index(rows: DataFrame, name: str) -> DataFrame:
        distinct = rows.groupBy("text_key").agg(F.first("text").alias("text"))
        return stored(distinct.mapInArrow(_banded, "text_key string, fingerprint string, bands array<long>"), name)

    left, right = index(asked, "query-bands"), index(every, "bands")
    a = left.select(F.col("text_key").alias("q"), F.size("bands").alias("n_bands"), F.explode("bands").alias("band"))
    b = right.select(F.col("text_key").alias("d"), F.explode("bands").alias("band"))
    shared = a.join(b, "band").groupBy("q", "d").agg(F.count("*").alias("n"), F.first("n_bands").alias("n_bands"))
    met = shared.where(F.col("n") >= F.when(F.col("n_bands") < 8, 1).otherwise(least_bands)).select("q", "d")
    texts = every.groupBy("text_key").agg(F.first("text").alias("text")), asked.groupBy("text_key").agg(F.first("text").alias("text"))
    both = met.join(texts[1].select(F.col("text_key").alias("q"), F.col("text").alias("q_text")), "q").join(texts[0].select(F.col("text_key").alias("d"), F.col("text").alias("d_text")), "d")
    longer = F.greatest(F.length("q_text"), F.length("d_text"))
    allowed = F.floor((1 - least) * longer + 1e-9).cast("int")
    near = both.where(F.abs(F.length("q_text") - F.length("d_text")) <= allowed)
    # A distance of more than `allowed` comes back as -1.
    exact = near.withColumn("longer", longer).withColumn("distance", F.expr(f"levenshtein(q_text, d_text, cast(floor({1 - least!r} * greatest(length(q_text), length(d_text)) + 1e-9) as int))"))
    found = exact.where("distance >= 0").select("q", "d", "distance", F.when(F.col("longer") == 0, 1.0).otherwise(1 - F.col("distance") / F.col("longer")).alias("similarity"))
    names = asked.select(F.col("text_key").alias("q"), F.col("id").alias("query_id")), every.select(F.col("text_key").alias("d"), F.col("id").alias("doc_id"))
    return found.join(names[0], "q").join(names[1], "d").select("query_id", "doc_id", "distance", "similarity")
