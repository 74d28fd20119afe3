"""Text features and linear models on them, shared by the quality classifier and the mixer.

Features are computed where the texts are; the driver only gets those of a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import alnum_words, batches, utf8

#: Buckets that words are hashed to.
BUCKETS = 1 << 14
#: Style features, before the constant one.
STYLE = 18

_CLASS = np.zeros(256, np.uint8)  # of bytes: other, letter, capital, digit, punctuation, space, newline, beyond ASCII
_CLASS[33:127] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 5, 6


def style(data: bytes) -> list[float]:
    """Shape of a text: lengths, shares of sorts of characters, repetition. All are of order 1."""
    n = max(1, len(data))
    of = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / n
    words = data.split()
    m = max(1, len(words))
    lines = data.split(b"\n")
    lowered = data.lower().split()
    repeated = sum(a == b for a, b in zip(lowered, lowered[1:], strict=False)) / m
    odd = sum(1 for w in words if len(w) > 2 and w[-1] == w[-2] and not w[-1:].isalnum() and w[-1] < 128) / m
    bare = sum(1 for w in words if len(w) < 3 and not w[:1].isalnum() and w[:1] < b"\x80") / m
    letters = of[1] + of[2]
    return [
        np.log1p(m) / 5, np.log1p(len(data) / m), of[1], of[2], of[2] / max(letters, 1e-9), 4 * of[3], 4 * of[4], of[5], 10 * of[6], of[7],
        len(set(lowered)) / m, repeated, odd, bare, len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0)) / 3,
        1.0 if m < 20 else 0.0, len(lowered[0]) / 10 if lowered else 0.0,
    ]


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the text's words: 1 + log of the count, of Euclidean length 1, times 4."""
    words = alnum_words(text)
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = np.bincount(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    weights = 1 + np.log(counts[at])
    return at.astype(np.int32), (4 * weights / np.sqrt(weights @ weights)).astype(np.float32)


@dataclass
class Sample:
    """Features of some documents: style rows, and words in compressed rows."""

    dense: np.ndarray
    index: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    label: np.ndarray

    def __len__(self) -> int:
        return len(self.label)

    def part(self, chosen: np.ndarray) -> Sample:
        """The rows where `chosen` is true."""
        new, words = np.cumsum(chosen) - 1, chosen[self.row]
        return Sample(self.dense[chosen], self.index[words], self.weight[words], new[self.row[words]], self.label[chosen])

    def dealt(self, size: int, seed: int = 5) -> list[tuple[np.ndarray, Sample]]:
        """(numbers of rows, the rows) of parts of at most `size` rows, dealt at random; one part at least."""
        n = max(1, -(-len(self) // size))
        of = np.random.default_rng(seed).permutation(np.arange(len(self)) % n)
        return [(np.flatnonzero(of == k), self.part(of == k)) for k in range(n)]


@dataclass
class Linear:
    """k linear functions of the features; the last dense weight is of the constant 1."""

    dense: np.ndarray
    words: np.ndarray
    centre: np.ndarray = field(default_factory=lambda: np.zeros(STYLE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(STYLE))

    @classmethod
    def zero(cls, k: int, sample: Sample) -> Linear:
        scale = sample.dense.std(0) if len(sample) else np.ones(STYLE)
        centre = sample.dense.mean(0) if len(sample) else np.zeros(STYLE)
        return cls(np.zeros((STYLE + 1, k)), np.zeros((BUCKETS, k)), centre, np.where(scale > 1e-6, scale, 1.0))

    def shaped(self, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.centre) / self.scale, -6, 6)
        return np.concatenate([z, np.ones((len(dense), 1))], axis=1)

    def of(self, sample: Sample) -> np.ndarray:
        out = self.shaped(sample.dense) @ self.dense
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(sample.row, self.words[sample.index, j] * sample.weight, minlength=len(sample))
        return out

    def one(self, text: str | None) -> np.ndarray:
        at, weight = hashed(text)
        return (self.shaped(np.array([style(utf8(text))])) @ self.dense)[0] + weight @ self.words[at]

    def gradients(self, sample: Sample, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a sum over the sample, from the gradients `each` of its terms by the functions' values."""
        words = np.stack([np.bincount(sample.index, each[sample.row, j] * sample.weight, minlength=BUCKETS) for j in range(each.shape[1])], 1)
        return self.shaped(sample.dense).T @ each, words


def fit(model: Linear, sample: Sample, slope: Callable[[np.ndarray, np.ndarray], np.ndarray], rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4, size: int = 1024) -> Linear:
    """Adam, in each round on a part of the sample; on all of it where it is small.

    slope: from the functions' values at some rows and those rows' numbers, to the gradient by each value of the loss that
    the rows estimate."""
    weights, parts = [model.dense, model.words], sample.dealt(size)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, rounds + 1):
        rows, part = parts[t % len(parts)]
        for k, g in enumerate(model.gradients(part, slope(model.of(part), rows))):
            g = g + ridge * weights[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            weights[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


_FEATURES = pa.schema([("label", pa.int32()), ("key", pa.binary()), ("dense", pa.list_(pa.float64())), ("index", pa.list_(pa.int16())), ("weight", pa.list_(pa.float32()))])


def _featurise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for part in parts:
            for label, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                at, weight = hashed(text)
                yield label, xxhash.xxh3_128_digest(utf8(text)), style(utf8(text)), at.astype(np.int16), weight

    yield from batches(rows(), _FEATURES, max_rows=256)


def bounded(rows: DataFrame, most: int, key: Column) -> DataFrame:
    """About `most` of the rows, drawn by the hash of a key, or all if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(77), key), F.lit(1 << 30)) < (1 << 30) * most / n)


def collect_sample(labelled: DataFrame) -> Sample:
    """Features of a bounded table (label int, text), on the driver; in a fixed order, by label, shape and the text's digest.

    What arrives stays in flat arrays: no object is made for a number, and each array is copied once."""
    got = labelled.select(F.col("label").cast("int"), "text").mapInArrow(_featurise, "label int, key binary, dense array<double>, index array<short>, weight array<float>").toArrow()

    def flat(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of a column of lists, and where each row's begin."""
        chunks = got.column(name).chunks
        sizes = np.concatenate([np.empty(0, np.int64), *(pc.list_value_length(c).to_numpy() for c in chunks)])
        return np.concatenate([np.empty(0, kind), *(c.flatten().to_numpy() for c in chunks)]), np.append(0, np.cumsum(sizes))

    label, dense = got.column("label").to_numpy(), flat("dense", np.float64)[0].reshape(-1, STYLE)
    keys = np.frombuffer(b"".join(got.column("key").to_pylist()), ">u8").reshape(-1, 2)
    order = np.lexsort((*keys.T[::-1], *dense.T[::-1], label))

    def sorted_by(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        numbers, begin = flat(name, kind)
        return np.concatenate([np.empty(0, kind), *(numbers[begin[k] : begin[k + 1]] for k in order)]), np.diff(begin)[order]

    index, sizes = sorted_by("index", np.int16)
    return Sample(dense[order], index, sorted_by("weight", np.float32)[0], np.repeat(np.arange(len(order), dtype=np.int32), sizes), label[order])
