"""Removal of repeated passages by suffix arrays.

Every byte goes that a string of WINDOW bytes covers which also starts elsewhere in the table. Each window belongs to its
minimiser, the least hashed of its short grams, so equal windows belong to equal keys wherever they are. A stretch of
windows with one minimiser is a segment. Segments whose key is found once are unique. The others are dealt into shards by
key; each shard sorts the suffixes of its segments (Larsson and Sadakane 2007, in numpy), takes their common prefixes
(Kasai et al. 2001) and so finds equal windows. A key with very many segments is dealt into several shards, whose sorted
windows are then merged by binary search.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import batches, stored, utf8

WINDOW, GRAM = 200, 32
#: Bytes of segments in one shard, about.
SHARD_BYTES = 1 << 20
#: Segments of one key in one shard; a key with more is dealt into several.
KEY_SEGMENTS = 4096
#: Windows that are merged together, about.
MERGED = 20_000
#: Bytes of distinct segments that a task counts before the shuffle.
COMBINED = 32 << 20
#: Windows that are looked at together; with the overlap they are fewer than POSITIONS.
CHUNK = 1 << 18
POSITION_BITS = 20

_RUNS = pa.schema([("key", pa.int64()), ("tid", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])
_SEGMENTS = pa.schema([("key", pa.int64()), ("tid", pa.binary()), ("start", pa.int64()), ("digest", pa.binary()), ("segment", pa.binary()), ("n", pa.int64()), ("runs", pa.int64())])
_PLACES = pa.schema([("key", pa.int64()), ("tid", pa.binary()), ("start", pa.int64()), ("digest", pa.binary())])
_CUT = pa.schema([("tid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def words_at(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on, as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    raw, out = padded.tobytes(), np.empty(len(data) + 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(raw, order, (len(raw) - o) // 8, o)
        out[o::8] = part[: len(out[o::8])]
    return out[: len(data)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a multiple of 8) from each position on."""
    at = words_at(data)
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        out = (out + at[k : k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return _mix(out)


def minimiser_runs(data: np.ndarray, window: int, gram: int, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends) of the stretches of windows whose minimiser is the same gram at the same position.

    ends are of the last window's start. breaks: starts of texts in data, at which stretches end too.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    at = (least & mask).astype(np.int64)
    new = np.empty(n, bool)
    new[0], new[1:] = True, at[1:] != at[:-1]
    if breaks is not None:
        new[breaks[breaks < n]] = True
    starts = np.flatnonzero(new)
    return hashes[at[starts]].view(np.int64), starts, np.append(starts[1:] - 1, n - 1)


def text_runs(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(which text, keys, starts, ends), several texts at a time; a long text comes in several parts."""

    def together(some: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        offsets = np.cumsum([0, *(len(texts[t]) for t in some)])
        data = np.frombuffer(b"".join(texts[t] for t in some), np.uint8)
        keys, starts, ends = minimiser_runs(data, window, gram, offsets[:-1])
        bounds = np.searchsorted(starts, offsets)
        for k, t in enumerate(some):
            part = slice(bounds[k], bounds[k + 1])
            own = starts[part] - offsets[k]
            last = np.minimum(ends[part] - offsets[k], len(texts[t]) - window)  # windows over the text's end are none
            good = own <= last
            if good.any():
                yield t, keys[part][good], own[good], last[good]

    some, held = [], 0
    for t, data in enumerate(texts):
        if len(data) < window:
            continue
        if len(data) > CHUNK:
            for begin in range(0, len(data) - window + 1, CHUNK):
                piece = np.frombuffer(data[begin : begin + CHUNK + window - 1], np.uint8)
                keys, starts, ends = minimiser_runs(piece, window, gram)
                yield t, keys, starts + begin, ends + begin
            continue
        some.append(t)
        held += len(data)
        if held > CHUNK:
            yield from together(some)
            some, held = [], 0
    if some:
        yield from together(some)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the text from them on, exact to `depth` bytes at least.

    The first sort is by eight bytes. Then groups that are still of more than one suffix are refined by the group that stands
    h bytes on, and h doubles. Suffixes alone in their group are not touched again.
    """
    n = len(data)
    first = words_at(data, ">u8")
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1]), np.arange(n), 0)) + 1 if n else 0
    h = 8
    while h < depth:
        ranks = rank[order]
        alone = np.append(True, ranks[1:] != ranks[:-1]) & np.append(ranks[1:] != ranks[:-1], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        own = order[places]
        ahead = np.where(own + h < n, rank[np.minimum(own + h, n - 1)], 0)
        keys = (rank[own].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        sorted_by = np.argsort(keys, kind="stable")
        order[places] = own[sorted_by]
        keys = keys[sorted_by]
        # A group's rank is the place of its first member; a refined group starts where its key does.
        fresh = np.append(True, keys[1:] != keys[:-1])
        rank[own[sorted_by]] = np.maximum.accumulate(np.where(fresh, places, 0)) + 1
        h *= 2
    return order


def common_prefixes(data: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray, most: int = 1024) -> np.ndarray:
    """Length of the common prefix of the suffixes at before[i] and after[i], for distinct after.

    By Kasai's lemma: if the pair one byte to the left is a pair too, its prefix is longer by one. So only pairs without
    such a left neighbour, and those at `starts`, are compared (up to `most` bytes); the rest follow.
    """
    n = len(data)
    phi = np.full(n + 1, -2, np.int64)
    phi[after] = before
    held = np.flatnonzero(phi[:n] >= 0)
    if not len(held):
        return np.empty(0, np.int64)
    head = np.append(True, (held[1:] != held[:-1] + 1) | (phi[held[1:]] != phi[held[:-1]] + 1))
    head |= np.isin(held, starts)
    left = held[~head] - 1
    cut = np.zeros(len(held), bool)
    cut[~head] = data[left] != data[phi[left]]  # the left pair's prefix is empty and says nothing
    head |= cut
    at = words_at(data)
    at = np.append(at, np.zeros(most + 8, np.uint64))
    p, q = held[head], phi[held[head]]
    length, live = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(live):
        x = at[p[live] + length[live]] ^ at[q[live] + length[live]]
        same = (x == 0) & (length[live] + 8 <= most)
        differ = live[~same]
        low = x[~same] & (~x[~same] + np.uint64(1))  # the lowest bit that differs; the first byte is the lowest
        length[differ] += np.where(low > 0, np.frexp(low.astype(np.float64))[1] - 1, 64) // 8
        length[live[same]] += 8
        live = live[same]
    of = np.cumsum(head) - 1
    plcp = np.zeros(n, np.int64)
    plcp[held] = np.maximum(0, length[of] - (held - held[head][of]))
    return plcp[after]


def equal_windows(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, group) of every window of the segments, in the order of the suffix array; equal windows have one
    group, which is numbered from 0."""
    sizes = np.array([len(s) for s in segments])
    offsets = np.cumsum([0, *(sizes + 1)])[:-1]
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    left = offsets[owner] + sizes[owner] - np.arange(len(data))
    order = suffix_array(data, window)
    order = order[left[order] >= window]
    prefix = np.minimum(common_prefixes(data, order[:-1], order[1:], offsets), np.minimum(left[order[:-1]], left[order[1:]]))
    group = np.append(0, np.cumsum(prefix < window)) if len(order) else np.empty(0, np.int64)
    return owner[order], order - offsets[owner[order]], group


def _spans(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches that windows at sorted offsets cover."""
    breaks = np.flatnonzero(offsets[1:] > offsets[:-1] + window) + 1
    for part in np.split(offsets, breaks):
        yield int(part[0]), int(part[-1]) + window


def _shard(window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """From a shard's distinct segments: marks (win null) of what repeats inside it; of a key that is split, its windows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        crowded = rows["key"].map(rows["key"].value_counts()) > 1
        rows = rows[crowded | (rows["parts"] > 1)].sort_values(["key", "digest"]).reset_index(drop=True)
        if len(rows):
            segments = list(rows["segment"])
            owner, offset, group = equal_windows(segments, window)
            repeated = np.bincount(group)[group] > 1
            keys, digests, once, split = rows["key"].to_numpy(), rows["digest"], (rows["n"] == 1).to_numpy(), (rows["parts"] > 1).to_numpy()
            marked = repeated & once[owner]
            at = np.lexsort((offset[marked], owner[marked]))
            owners, offsets = owner[marked][at], offset[marked][at]
            for part in np.split(np.arange(len(owners)), np.flatnonzero(np.diff(owners)) + 1) if len(owners) else []:
                s = owners[part[0]]
                out += [(keys[s], digests[s], lo, hi, None, False) for lo, hi in _spans(offsets[part], window)]
            first = np.append(True, group[1:] != group[:-1]) & split[owner]
            for s, o, known in zip(owner[first], offset[first], (repeated | ~once[owner])[first], strict=True):
                out.append((keys[s], digests[s], int(o), int(o) + window, segments[s][o : o + window], bool(known)))
        return pd.DataFrame(out, columns=["key", "digest", "lo", "hi", "win", "known"])

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Marks windows that several shards of a key have: each shard's sorted windows are searched in those merged so far."""
    out: list[tuple] = []
    merged: list[tuple[bytes, int]] = []  # window, row of a shard that has it
    noted: set[int] = set()
    rows = rows.sort_values(["part", "win"]).reset_index(drop=True)
    keys, digests, los, his, known = (rows[c].tolist() for c in ("key", "digest", "lo", "hi", "known"))

    def mark(r: int) -> None:
        if not known[r] and r not in noted:
            noted.add(r)
            out.append((keys[r], digests[r], los[r], his[r]))

    for _, part in rows.groupby("part", sort=True):
        new = []
        for r, win in zip(part.index, part["win"], strict=True):
            at = bisect_left(merged, (win, -1))
            if at < len(merged) and merged[at][0] == win:
                mark(r)
                mark(merged[at][1])
            else:
                new.append((win, r))
        merged = sorted([*merged, *new])
    return pd.DataFrame(out, columns=["key", "digest", "lo", "hi"])


def _emit_runs(window: int, gram: int, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, tid, start, end) of (tid, text); counted: once for each key of a text, start is then the number of its runs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tids = part.column(0).to_pylist()
            for begin in range(0, len(tids), 256):
                texts = [utf8(t.as_py()) for t in part.column(1)[begin : begin + 256]]
                got = list(text_runs(texts, window, gram))
                if not got:
                    continue
                owner = np.concatenate([np.full(len(k), t) for t, k, _, _ in got])
                key, start, end = (np.concatenate([g[c] for g in got]) for c in (1, 2, 3))
                if counted:
                    pairs, n = np.unique(np.stack([owner, key]), axis=1, return_counts=True)
                    owner, key, start, end = pairs[0], pairs[1], n, n
                names = pa.array(tids[begin : begin + 256], pa.binary()).take(pa.array(owner))
                for o in range(0, len(key), 65536):
                    cut = slice(o, o + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut], pa.int64()), names[cut], pa.array(start[cut], pa.int64()), pa.array(end[cut], pa.int64())], schema=_RUNS)

    return run


def _emit_segments(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, tid, start, digest, segment, n, runs) of (tid, text, spans): distinct segments with their count. Those that
    repeat inside a partition are counted before the shuffle, as far as COMBINED bytes of them are held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[tuple[int, bytes], list] = {}
            size = 0
            for part in parts:
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    data = utf8(text.as_py())
                    for s in spans.as_py():
                        segment = data[s["start"] : s["end"] + window]
                        name = (s["key"], xxhash.xxh3_128_digest(segment))
                        if name in held:
                            held[name][1] += 1
                            continue
                        held[name] = [segment, 1, s["runs"]]
                        size += len(segment) + 400
                    if size > COMBINED:
                        yield from ((key, None, None, digest, *rest) for (key, digest), rest in held.items())
                        held, size = {}, 0
            yield from ((key, None, None, digest, *rest) for (key, digest), rest in held.items())

        yield from batches(rows(), _SEGMENTS)

    return run


def _emit_places(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, tid, start, digest) of every segment of (tid, text, spans)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for tid, text, spans in zip(*(part.column(k) for k in range(3)), strict=True):
                    tid, data = tid.as_py(), utf8(text.as_py())
                    for s in spans.as_py():
                        yield s["key"], tid, s["start"], xxhash.xxh3_128_digest(data[s["start"] : s["end"] + window])

        yield from batches(rows(), _PLACES)

    return run


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for tid, text, marks in zip(*(part.column(k) for k in range(3)), strict=True):
                data, at, pieces, spans = utf8(text.as_py()), 0, [], 0
                for m in sorted(marks.as_py(), key=lambda m: (m["lo"], m["hi"])):
                    if m["lo"] > at or not spans:
                        pieces.append(data[at : m["lo"]])
                        spans += 1
                    at = max(at, m["hi"])
                pieces.append(data[at:])
                kept = b"".join(pieces)
                yield tid.as_py(), len(data) - len(kept), spans, kept

    yield from batches(rows(), _CUT)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, key_segments: int = KEY_SEGMENTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary), a row for each row of docs; kept is null where nothing
    is removed.

    Texts are UTF-8 bytes, null is empty. A byte goes if any string of `window` bytes over it also starts anywhere else
    in the table, in the same text too. Of rows that repeat a text each is another place. Removal may split a character,
    so what is kept is bytes. Null and repeated ids have rows of their own; an empty table gives none; other columns are
    not read. `window` is at least `gram`, a multiple of 8.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("tid"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    pairs = rows.where(F.col("n_bytes") >= window).select("tid", "text")
    seen = pairs.mapInArrow(_emit_runs(window, gram, True), "key long, tid binary, start long, end long")
    brief = F.xxhash64("tid")
    keys = seen.groupBy("key").agg(F.min(brief).alias("low"), F.max(brief).alias("high"), F.max("start").alias("most"), F.sum("start").alias("runs"))
    keys = stored(keys.where("low <> high or most > 1").select("key", "runs"), "keys")
    runs = pairs.mapInArrow(_emit_runs(window, gram, False), "key long, tid binary, start long, end long")
    held = runs.join(keys, "key").groupBy("tid").agg(F.collect_set(F.struct("key", "start", "end", "runs")).alias("spans"))
    # Only texts with a segment that may repeat are needed again.
    touched = stored(pairs.dropDuplicates(["tid"]).join(held, "tid").select("tid", "text", "spans"), "touched")
    total = touched.select(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"] + window))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    schema = "key long, tid binary, start long, digest binary, segment binary, n long, runs long"
    distinct = touched.mapInArrow(_emit_segments(window), schema)
    parts = F.ceil(F.col("runs") / key_segments).cast("int")
    dealt = distinct.withColumn("parts", parts).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("digest"), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    dealt = dealt.withColumn("shard", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))))
    dealt = dealt.select("key", "digest", "segment", "n", "parts", "part", "shard")
    inside = dealt.groupBy("shard", "part").applyInPandas(_with_part(_shard(window)), "key long, digest binary, lo int, hi int, win binary, known boolean, part int, whole boolean")
    results = stored(inside, "marks")
    marks = results.where("win is null").select("key", "digest", "lo", "hi")
    windows = results.where("win is not null")
    if n_windows := windows.count():
        # Equal windows meet in one group; groups are of some thousand windows.
        merged = windows.groupBy(F.pmod(F.xxhash64("key", "win"), F.lit(-(-n_windows // MERGED)))).applyInPandas(_merge, "key long, digest binary, lo int, hi int")
        marks = marks.unionByName(merged)

    places = touched.mapInArrow(_emit_places(window), "key long, tid binary, start long, digest binary")
    spans = places.join(marks, ["key", "digest"]).select("tid", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    marked = spans.groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    cut = touched.select("tid", "text").join(marked, "tid").mapInArrow(_cut, "tid binary, n_removed long, n_spans long, kept binary")
    copies = rows.groupBy("tid").agg(F.count("*").alias("copies"))
    known = rows.select("id", "tid", "n_bytes").join(copies, "tid").join(cut, "tid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    kept = F.when(whole, F.lit(b"")).otherwise(F.col("kept"))
    return known.select(
        "id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(kept.isNull(), F.lower(F.hex("tid"))).otherwise(F.sha2(kept, 256)).alias("kept_sha256"), kept.alias("kept"),
    )


def _with_part(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Adds the shard's part, and marks for segments that are in several places as a whole."""

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        rows = rows.groupby(["key", "digest"], as_index=False).agg({"segment": "first", "n": "sum", "parts": "first"})
        several = rows[rows["n"] > 1]
        whole = pd.DataFrame({"key": several["key"], "digest": several["digest"], "lo": 0, "hi": several["segment"].map(len), "win": None, "known": False, "whole": True})
        found = run(rows)
        found["whole"] = False
        out = pd.concat([x for x in (whole, found) if len(x)]) if len(whole) or len(found) else found
        return out.assign(part=part)[["key", "digest", "lo", "hi", "win", "known", "part", "whole"]]

    return both
