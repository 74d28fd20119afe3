"""Secret scan, in DataFrame operations only.

Base patterns find assigned values, access keys and long hex runs. Besides them, two character Markov models, of random
strings and of ordinary identifiers, are compared on every long token by their log-likelihood ratio. They are trained on
labelled samples, and the threshold is fitted on samples held out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import match_spans
from folioscope.llm.common import free_name, stored

# The base patterns, their kinds in order, and the least length of a match (of group 2 for `assign`).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex")

#: Tokens that the Markov models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_TOKEN = 20
#: Shorter tokens that the model of ordinary identifiers also learns from.
IDENTIFIER = r"[A-Za-z0-9+/_=-]{3,}"
#: Least log-likelihood ratio for each step between characters, where none is fitted.
LEAST_RATIO = 1.0
#: The models' states; each separator has its own, and one more is for all other characters.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: What is added to each state's count, and how many counts its overall chance has in a step's.
SMOOTHING, BACKING = 0.5, 20.0
#: One distinct sample in so many is held out, for the threshold.
HELD_OUT = 5
#: How many missed random tokens a wrongly found ordinary one costs, in shares of each.
WRONG_COST = 100.0

_SPAN = "array<struct<start: int, end: int>>"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; matches that are too short are dropped after matching, as they still use their text up."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(F.zip_with(match_spans(text, ASSIGN), F.transform(values, F.length), lambda s, n: F.struct(s["start"].alias("start"), s["end"].alias("end"), n.alias("n"))), lambda s: s["n"] >= LEAST_ASSIGNED)
    assigned = F.when(text.rlike(ASSIGN), F.transform(assigned, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast(_SPAN))
    return {"assign": assigned, "access": match_spans(text, ACCESS), "hex": match_spans(text, HEX)}


def state(char: Column) -> Column:
    """The models' state of a character, from 0, which is that of characters outside ALPHABET."""
    return F.instr(F.lit(ALPHABET), char)


#: Any base match of the kinds without a value.
ACCESS_OR_HEX = f"{ACCESS}|{HEX}"


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, label, n): distinct training samples, and how often they were met. All documents are counted.

    Label 1, random strings: values of 16 characters or more that the base patterns find, and for each document strings
    that are random by their making: digests in base 64, in letters and digits, and in capitals and digits.
    Label 0, ordinary identifiers: all other tokens of the texts; identifiers made from each of their words in the usual
    ways of writing (snake, constant, kebab, camel, path; some with a number); and for each document an identifier of the form of a UUID.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text"))
    found = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS_OR_HEX), F.lit(0)))
    values = texts.select(F.explode(found).alias("token")).where(F.length("token") >= 16).groupBy("token").agg(F.count("*").alias("n"))
    met = texts.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    met = met.where(~F.col("token").rlike(ACCESS_OR_HEX)).join(values.select("token"), "token", "left_anti")
    w, first = F.lower("token"), F.initcap(F.lower("token"))
    number = F.pmod(F.xxhash64("token"), F.lit(100)).cast("string")
    written = [
        F.concat_ws("_", w, w), F.upper(F.concat_ws("_", w, w, number)), F.concat_ws("-", w, number, w), F.concat(w, first), F.concat(first, first, number), F.concat_ws("/", w, w, F.concat(w, number), w),
    ]
    styled = met.where(F.col("token").rlike("^[A-Za-z]{3,15}$")).select(F.explode(F.array(*written)).alias("token"), "n")

    def digest(salt: str) -> Column:
        return F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(salt), "id", F.xxhash64("text").cast("string")), 256)))

    uuid = F.regexp_replace(F.md5(F.concat_ws(":", F.lit("uuid"), "id", F.xxhash64("text").cast("string")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    made = F.array(
        F.struct(digest("whole").alias("token"), F.lit(1).alias("label")), F.struct(F.translate(digest("alnum"), "+/=", "").alias("token"), F.lit(1).alias("label")),
        F.struct(F.upper(F.translate(digest("capitals"), "+/=", "")).alias("token"), F.lit(1).alias("label")), F.struct(uuid.alias("token"), F.lit(0).alias("label")),
    )
    built = texts.select(F.explode(made).alias("m")).select("m.token", "m.label", F.lit(1).cast("long").alias("n"))
    parts = [values.select("token", F.lit(1).alias("label"), "n"), met.select("token", F.lit(0).alias("label"), "n"), styled.select("token", F.lit(0).alias("label"), "n"), built]
    return reduce(DataFrame.unionByName, parts)


def _states(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), state)


def fit_models(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each step between two states: STATES * STATES numbers.

    samples: (token, label), and n if they are weighted. A step's chance is backed by its second state's overall chance with
    BACKING counts, and that by an even chance with SMOOTHING each, so without samples of a sort its model is uniform.
    A step from a character to itself says nothing, and has the ratio 0: so rules and padding are never random.
    """
    n = F.col("n").cast("double") if "n" in samples.columns else F.lit(1.0)
    states = samples.select("label", n.alias("n"), _states(F.col("token")).alias("s")).where(F.size("s") > 1)
    both = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: a * STATES + b)
    steps = states.select("label", "n", F.explode(F.filter(both, lambda x: x % (STATES + 1) != 0)).alias("step"))
    counts = {0: [[0.0] * STATES for _ in range(STATES)], 1: [[0.0] * STATES for _ in range(STATES)]}
    for label, at, n in steps.groupBy("label", "step").agg(F.sum("n")).collect():  # at most 2 * STATES * STATES rows
        counts[label][at // STATES][at % STATES] = n

    def logs(rows: list[list[float]]) -> list[float]:
        overall = [sum(row[t] for row in rows) + SMOOTHING for t in range(STATES)]
        total = sum(overall)
        return [math.log((n + BACKING * o / total) / (sum(row) + BACKING)) for row in rows for n, o in zip(row, overall, strict=True)]

    table = [a - b for a, b in zip(logs(counts[1]), logs(counts[0]), strict=True)]
    return [0.0 if k % (STATES + 1) == 0 else x for k, x in enumerate(table)]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's steps."""
    weights = F.array(*[F.lit(round(x, 6)) for x in table])
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, s: Column) -> Column:
        weight = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.element_at(weights, acc["last"] * STATES + s + 1))
        return F.struct(s.alias("last"), (acc["sum"] + weight).alias("sum"))

    return F.aggregate(_states(token), start, step)["sum"] / F.greatest(F.length(token) - 1, F.lit(1))


def held_out() -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(HELD_OUT)) == 0


def error_rates(samples: DataFrame, table: list[float], bins: int = 50) -> list[tuple[float, float, float]]:
    """(cut, share of random tokens below it, share of ordinary tokens from it on), by distinct tokens of LEAST_TOKEN or more
    characters. Cuts are 1 / bins apart; only a count for each of them comes to the driver."""
    at = F.greatest(F.lit(-10 * bins), F.least(F.lit(10 * bins), F.floor(ratio(F.col("token"), table) * bins))).cast("int")
    got = samples.where(F.length("token") >= LEAST_TOKEN).select("label", at.alias("at")).groupBy("label", "at").count().collect()
    counts = {label: [0] * (20 * bins + 1) for label in (0, 1)}
    for label, k, n in got:
        counts[label][k + 10 * bins] = n
    total = {label: max(1, sum(c)) for label, c in counts.items()}
    out, missed, wrong = [], 0, sum(counts[0])
    for k in range(20 * bins + 1):
        out.append((k / bins - 10, missed / total[1], wrong / total[0]))
        missed, wrong = missed + counts[1][k], wrong - counts[0][k]
    return out


def fit_threshold(samples: DataFrame, table: list[float]) -> float:
    """The cut with the least cost of both error rates on samples that the models have not seen; of several alike the middle
    one. LEAST_RATIO if there are no samples of a sort."""
    rates = error_rates(samples, table)
    if rates[-1][1] == 0 or rates[0][2] == 0:
        return LEAST_RATIO
    best = min(m + WRONG_COST * w for _, m, w in rates)
    cuts = [c for c, m, w in rates if m + WRONG_COST * w == best]
    return (cuts[0] + cuts[-1]) / 2


def fit_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], float]:
    """(ratios of the steps, threshold): the models of most samples, and the threshold by the others."""
    samples = stored(labelled_samples(docs, id_col, text_col), "samples")
    table = fit_models(samples.where(~held_out()))
    return table, fit_threshold(samples.where(held_out()), table)


def _blank(text: Column, pattern: str, value: Column | None = None) -> Column:
    """The text with its matches blanked, of the same length; of those with a value, only where it is long enough."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spaces = F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m)))
    if value is not None:
        spaces = F.zip_with(F.arrays_zip(found.alias("m"), spaces.alias("blank")), value, lambda x, v: F.when(F.length(v) >= LEAST_ASSIGNED, x["blank"]).otherwise(x["m"]))
    whole = F.array_join(F.zip_with(gaps, spaces, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _of_kind(n: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))


def scan_secrets(docs: DataFrame, table: list[float], text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """docs with a column `spans`: array<struct<start, kind, end>>, by start and then by kind.

    Kinds assign, access and hex are the base patterns'; `markov` are tokens of 20 characters or more, of the text with its
    base matches blanked, whose steps are on average likelier by least_ratio under the model of random strings. Null and
    empty texts have none. Places are in code points, the end exclusive. A column of the name spans is replaced. Other
    columns, null ids and repeated rows pass as they are. One pass without a shuffle.
    """
    text, rest, tokens, base, judged = (free_name(docs, n) for n in ("scanned", "rest", "tokens", "base", "judged"))
    # In separate steps, so that each pattern runs once for each text.
    step = docs.drop("spans").withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    found = base_spans(F.col(text))
    step = step.withColumn(base, F.concat(*[F.transform(found[kind], _of_kind(n)) for n, kind in enumerate(KINDS)]))
    values = F.regexp_extract_all(F.col(text), F.lit(ASSIGN), F.lit(2))
    blanked = _blank(_blank(_blank(F.col(text), ASSIGN, values), ACCESS), HEX)
    step = step.withColumn(rest, F.when(F.size(base) > 0, blanked).otherwise(F.col(text)))
    step = step.withColumn(tokens, match_spans(F.col(rest), TOKEN))
    # Tokens in the order of their spans; a text without them is not looked at again.
    each = F.zip_with(tokens, F.regexp_extract_all(F.col(rest), F.lit(TOKEN), F.lit(0)), lambda t, x: F.struct(t["start"].alias("start"), t["end"].alias("end"), x.alias("token")))
    likely = F.when(F.size(tokens) > 0, F.filter(each, lambda t: ratio(t["token"], table) >= least_ratio))
    step = step.withColumn(judged, F.coalesce(F.transform(likely, _of_kind(len(KINDS))), F.array().cast("array<struct<start: int, kind: int, end: int>>")))
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])
    spans = F.transform(F.array_sort(F.concat(base, judged)), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return step.withColumn("spans", spans).drop(text, rest, tokens, base, judged)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
