"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table predicts how much of each document belongs to each domain. Nonnegative document
rates, within bounds, are then fitted by projected-gradient least squares, so that the expected tokens of the domains meet
their targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import alnum_words, free_name, quoted, stored
from folioscope.llm.features import Linear, collect_sample, fit

#: Labelled texts of each domain that the classifier is fitted on, about; of more, a hash draws these.
MOST_LABELLED = 3000
#: Relative length of a projected step up to which the rates have settled.
SETTLED = 3e-4
#: Rounds with the matrix of the rows between their bounds, after which the matrix of all rows holds.
SCALED_ROUNDS = 40
#: Steps after which the rates are stored, so that a row does not go through all steps in each round.
STORED_STEPS = 24


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_domains(labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", most: int = MOST_LABELLED) -> Linear:
    """Softmax regression on (id, text, domain). Domains are weighted by how many labelled texts they have, so that
    posteriors follow the labels' shares although a bounded number of each is used. Unknown domains are ignored."""
    counts = dict(labelled.where(F.col(domain_col).isin(domains)).groupBy(domain_col).count().collect())
    share = np.array([counts.get(d, 0) for d in domains])
    own, key = free_name(labelled, "drawn_id"), F.col(f"`{id_col}`")
    number = F.array_position(F.array(*map(F.lit, domains)), F.col(domain_col)).cast("int")
    chance = F.array(*[F.lit(min(1.0, most / max(1, n))) for n in share.tolist()])
    draw = F.pmod(F.xxhash64(F.lit(77), key.cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = (number > 0) & (draw < F.element_at(chance, F.greatest(number, F.lit(1))))
    # Ids first, `most` for each domain or so, so that the other texts stay where they are.
    ids = labelled.where(chosen).select(key.alias(own)).distinct()
    rows = labelled.join(F.broadcast(ids), key.eqNullSafe(F.col(own)), "left_semi").where(chosen)
    sample = collect_sample(rows.select((number - 1).alias("label"), F.col(f"`{text_col}`").alias("text")))
    here = np.maximum(1, np.bincount(sample.label, minlength=len(domains)))
    weight = (share / max(1, share.sum()) / here)[sample.label][:, None]
    wanted = np.eye(len(domains))[sample.label]

    def slope(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return len(sample) / max(1, len(at)) * weight[at] * (_softmax(values) - wanted[at])

    return fit(Linear.zero(len(domains), sample), sample, slope)


_POSTERIORS = pa.schema([("rid", pa.int64()), ("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])


def _posteriors(model: Linear) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [text.as_py() for text in part.column(1)]
            rows = [_softmax(model.one(text)).tolist() for text in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(alnum_words(t)) for t in texts], pa.int64()), pa.array(rows, pa.list_(pa.float64()))], schema=_POSTERIORS)

    return run


def domain_posteriors(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, n_tokens, posterior array<double>): rid is the id; tokens are lower-cased words. Null texts have none."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("rid"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_posteriors(model), "rid long, n_tokens long, posterior array<double>")


#: A step: the prices, and how far the next one begins beyond it; None begins again where the last step ended.
Step = tuple[np.ndarray, float] | None


def _state(part: pa.RecordBatch, steps: list[Step], least: np.ndarray, most: float) -> tuple[np.ndarray, ...]:
    """(n_tokens, posteriors, least, most, rate, start of the next step) of rows (n_tokens, posterior, rate, start) after steps; without
    the last two they begin at 1, or at the bound next to it."""
    k = len(least)
    n = part.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
    p = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    low = least[p.argmax(1)] if len(p) else np.zeros(0)
    high = np.maximum(most, low)
    rate, start = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)) if part.num_columns > 2 else [np.clip(np.ones(len(n)), low, high)] * 2
    for step in steps:
        if step is None:
            start = rate
        else:
            new = np.clip(start - p @ step[0], low, high)
            rate, start = new, new + step[1] * (new - rate)
    return n, p, low, high, rate, start


def fit_rates(
    members: DataFrame, weights: list[float], total: float | None = None, total_factor: float = 1.0, least_rate: float | list[float] = 0.0, most_rate: float | None = None, rounds: int = 500, tolerance: float = 1e-3
) -> tuple[DataFrame, list[dict]]:
    """(members with `rate`, figures of each domain).

    members: (n_tokens, posterior), of any number of rows. The rates r minimise the squared error of the domains' expected
    tokens, the sum of r * n_tokens * posterior, against their targets, within least_rate <= r <= most_rate; errors are weighed by
    the inverse of the Gram matrix, the sum of n_tokens * posterior * posterior'. A domain's target is its weight times `total`
    tokens (by default total_factor times all tokens). least_rate may be a list: then a row's least rate is that of the domain
    that leads its posterior, the first of equal ones; most_rate None is no bound.

    All rates begin at 1, or at the bound next to it. A step moves each rate against its gradient, posterior * prices, and
    projects it on its bounds: r := clip(r - step * posterior * prices). The prices are the error times an inverse of the k x k
    Gram matrix: first that of the rows between their bounds, by which a step of 1 goes the whole way unless more rows meet theirs,
    halved while the error does not fall. If that does not meet the targets, the matrix of all rows holds, for which a step
    of 1 is never too long, with momentum that begins again when the error grows. Each round is one pass over the rows that
    sums, for the rates that a step would give, the tokens, the lengths of rates and step and the matrix: k (k + 3) / 2 + 2 numbers
    come to the driver. It ends when every target is met within `tolerance`, or when a projected step hardly moves
    the rates: then the bounds keep a target out of reach, and the error is the least. Figures say which: (tokens, target,
    expected, met). Raises if the rates do not settle within `rounds` rounds.
    """
    k = len(weights)
    least = np.array([float(x) for x in least_rate] if isinstance(least_rate, list) else [float(least_rate)] * k)
    most = float("inf") if most_rate is None else float(most_rate)
    upper = np.triu_indices(k)
    names = [f"s{j}" for j in range(k + 2 + len(upper[0]))]
    sums_schema = pa.schema([(c, pa.float64()) for c in names])

    kind = "n_tokens long, posterior array<double>, rate double, start double"
    now_rows = members.select("n_tokens", "posterior")
    steps: list[Step] = []

    def look(ahead: np.ndarray | None) -> tuple[np.ndarray, float, float, np.ndarray]:
        """After a further step of prices `ahead`: tokens, squared lengths of the rates and the step, matrix of rows between bounds.
        None: of no step, and the matrix of all rows."""
        done = list(steps)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total_sums = np.zeros(len(names))
            for part in parts:
                n, p, low, high, rate, start = _state(part, done, least, most)
                new = rate if ahead is None else np.clip(start - p @ ahead, low, high)
                inside = np.ones(len(n), bool) if ahead is None else (new > low) & (new < high)
                gram = (p * (n * inside)[:, None]).T @ p
                total_sums += np.r_[(n * new) @ p, (n * new * new).sum(), (n * (new - start) ** 2).sum(), gram[upper]]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total_sums], schema=sums_schema)

        got = now_rows.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
        sums = np.array([float(x or 0) for x in got])
        gram = np.zeros((k, k))
        gram[upper] = sums[k + 2 :]
        return sums[:k], sums[k], sums[k + 1], gram + np.triu(gram, 1).T

    def inverse(gram: np.ndarray) -> np.ndarray:
        size, axes = np.linalg.eigh(gram)
        kept = size > 1e-9 * max(size.max(initial=0.0), 1e-300)
        return (axes[:, kept] / size[kept]) @ axes[:, kept].T

    def error(now: np.ndarray, metric: np.ndarray) -> float:
        return float((now - target) @ metric @ (now - target)) / 2

    def missed(now: np.ndarray) -> np.ndarray:
        return np.abs(now - target) > tolerance * np.maximum(target, 1e-3 * max(tokens, 1.0))

    got = members.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.element_at("posterior", j + 1)) for j in range(k)]).first()
    tokens, at_one = float(got[0] or 0), np.array([float(x or 0) for x in got[1:]])
    share = np.array(weights, float) / max(sum(weights), 1e-12)
    target = share * (tokens * total_factor if total is None else total)
    now, _, _, whole = look(None)
    all_rows, free, left = inverse(whole), whole, rounds

    def take(step: Step) -> None:
        nonlocal now_rows, steps
        steps.append(step)
        if len(steps) >= STORED_STEPS:
            done = list(steps)

            def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    *_, rate, start = _state(part, done, least, most)
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(rate), pa.array(start)], names=["n_tokens", "posterior", "rate", "start"])

            now_rows, steps = stored(now_rows.mapInArrow(run, kind), "rates"), []
        every.append(step)

    every: list[Step] = []
    part = 1.0
    while tokens and np.any(missed(now)) and rounds - left < SCALED_ROUNDS and left:  # the matrix of the rows between bounds
        metric = inverse(free + 1e-6 * whole)
        prices = part * (metric @ (now - target))
        left -= 1
        then, length, moved, inside = look(prices)
        if moved <= SETTLED**2 * length or part < 1e-3:
            break
        if error(then, metric) > error(now, metric) - 1e-4 * moved / part:
            part /= 2
            continue
        take((prices, 0.0))
        now, free, part = then, inside, 1.0
    # The matrix of all rows. `start` is where the next step begins, and its tokens.
    start, pace = now, 1.0
    while tokens and np.any(missed(now)):
        if not left:
            raise RuntimeError(f"rates did not settle in {rounds} rounds")
        left -= 1
        prices = all_rows @ (start - target)
        then, length, moved, _ = look(prices)
        if error(then, all_rows) > error(now, all_rows) and start is not now:
            take(None)
            start, pace = now, 1.0
            continue
        pace, last = (1 + (1 + 4 * pace * pace) ** 0.5) / 2, pace
        beyond = (last - 1) / pace
        take((prices, beyond))
        start, now = then + beyond * (then - now), then
        if moved <= SETTLED**2 * length:
            break
    figures = [{"tokens": float(a), "target": float(t), "expected": float(x), "met": bool(not m)} for a, t, x, m in zip(at_one, target, now, missed(now), strict=True)]
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])
    columns, at = members.columns, [members.columns.index(c) for c in ("n_tokens", "posterior")]

    def rated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = pa.RecordBatch.from_arrays([part.column(c) for c in at], names=["n_tokens", "posterior"])
            *_, rate, _ = _state(own, every, least, most)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rate)], names=[*columns, "rate"])

    return members.mapInArrow(rated, schema), figures


def fitted_mixture(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, total_factor: float = 1.0, least_rate: float | dict[str, float] = 0.0, most_rate: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): mixture (rid, n_tokens, posterior, rate), a row for each row of docs; posteriors in the order of `weights`.
    report (domain, tokens, target, expected, wanted_share, share, met): a row for each domain, which says what the fit reached.

    Null and empty texts have no tokens and still a posterior and rate. Repeated rows get the same rate; null ids stay.
    Without labelled rows posteriors are even. An empty table gives no rows. least_rate may name a
    least rate for the rows that each domain leads, 0 for others. Warns of domains whose target cannot be met within the bounds.
    """
    domains = list(weights)
    model = fit_domains(labelled, domains, id_col, text_col, domain_col)
    members = stored(domain_posteriors(docs, model, id_col, text_col), "members")
    least = [least_rate.get(d, 0.0) for d in domains] if isinstance(least_rate, dict) else least_rate
    rated, figures = fit_rates(members, list(weights.values()), total, total_factor, least, most_rate)
    wanted, reached = sum(x["target"] for x in figures) or 1.0, sum(x["expected"] for x in figures) or 1.0
    rows = [(d, x["tokens"], x["target"], x["expected"], x["target"] / wanted, x["expected"] / reached, x["met"]) for d, x in zip(domains, figures, strict=True)]
    for name, _, target, expected, _, _, met in rows:
        if not met and abs(expected - target) > 0.01 * target:
            warnings.warn(f"mixture: {name} has {expected:.0f} expected tokens, its target is {target:.0f}", stacklevel=2)
    return rated, docs.sparkSession.createDataFrame(rows, "domain string, tokens double, target double, expected double, wanted_share double, share double, met boolean")


def mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options: object) -> DataFrame:
    """The mixture of fitted_mixture without its report."""
    return fitted_mixture(docs, labelled, weights, **options)[0]


def copies(rate: Column, key: Column, seed: int = 3) -> Column:
    """A whole number whose expected value is the rate, by the hash of a key."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", seed: int = 3, **options: object) -> DataFrame:
    """docs with each row repeated, or left out, by its rate. Rows that repeat an id are one in the draw. With most_rate, which
    bounds the rates inside the fit, no row is repeated more often than that, rounded up."""
    rated = mixture(docs, labelled, weights, id_col=id_col, text_col=text_col, **options)
    own, n = free_name(docs, "mixed_id"), free_name(docs, "n_copies")
    times = rated.select(F.col("rid").alias(own), copies(F.col("rate"), F.col("rid"), seed).alias(n)).groupBy(own).agg(F.max(n).alias(n)).where(F.col(n) > 0)
    joined = docs.join(times, F.col(f"`{id_col}`").eqNullSafe(F.col(own)))
    again = free_name(docs, "again")
    return joined.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*quoted(docs.columns))
